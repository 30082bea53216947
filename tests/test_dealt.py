"""Events are dealt to tasks before they are parsed, however few row groups their file has."""

from pyspark.sql import functions as F

from vigilog.session import dealt
from workload.base import log_lines, table


def test_lines_of_one_row_group_are_parsed_by_several_tasks(spark):
    lines = log_lines(spark, "/root/testdata/sf0.1")
    sizes = [r["count"] for r in lines.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 100_000 and max(sizes) < 30_000


def test_all_rows_are_dealt_and_an_empty_table_too(spark):
    rows = table(spark, "/root/testdata/sf0.001", "events")
    assert sorted(dealt(rows, "event_id", 100).collect()) == sorted(rows.collect())
    assert dealt(rows.where("false"), "event_id").collect() == []
