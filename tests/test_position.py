"""The place of rows in a sorted table, and the query that returns it for all alerts."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from vigilog.session import with_position


def test_positions_follow_the_order_over_many_parts(spark):
    rows = spark.range(0, 20_000, 1, 7).select((F.col("id") * 7919 % 20_000).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = with_position(rows.orderBy("v"))
        assert got.where("position <> v + 1").count() == 0 and got.count() == 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert with_position(rows.where("v < 0").orderBy("v")).count() == 0


def test_all_alerts_have_their_place(spark):
    rows = entry.queries()["t3_alerts_by_severity"](spark, "/root/testdata/sf0.001").collect()
    want = sorted(rows, key=lambda r: (-r.rank, -r.us, r.alert_id))
    assert [r.position for r in want] == list(range(1, len(rows) + 1))
