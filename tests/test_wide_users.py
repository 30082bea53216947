"""Queries against their SQL where users go beyond the numbers that make addresses."""

import os

import __spark_entry__ as entry
import duckdb
import pytest
from compare import TABLES, check, duck

from vigilog.operators.enrich import enrich_by_network

SMALL = "/root/testdata/sf0.001"
NAMES = ["a3_fixed_stats", "a4_alert_stats", "f14_filter_alerts", "f16_select_alerts", "g1_nodes", "g2_edges", "g5_component",
         "j10_exclude_false_positives", "j4_ip_enrichment", "j4_network_enrichment", "j6_fresh_enrichment", "j7_distinct_ips",
         "x20_event_json", "x6_confidence"]


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """The events three times: users as they are, across the border at 64,000, and beyond it."""
    folder = str(tmp_path_factory.mktemp("shifted"))
    for name in set(TABLES) - {"events"}:
        os.symlink(f"{SMALL}/{name}.parquet", f"{folder}/{name}.parquet")
    duckdb.sql(f"""COPY (SELECT e.* REPLACE (event_id + 1000 * k AS event_id, user_id + [0, 63995, 80000][k + 1] AS user_id)
      FROM '{SMALL}/events.parquet' e, range(3) t(k)) TO '{folder}/events.parquet'""")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_the_sql(spark, shifted, name):
    problem, n = check(spark, duck(shifted), name, entry.queries()[name], entry.oracle_sql()[name], shifted)
    assert problem is None and n > 0


def test_no_address_has_no_row(spark):
    ips = spark.createDataFrame([("10.0.0.1",), (None,)], "ip string")
    nets = spark.createDataFrame([("10.0.0.0/8",)], "cidr string")
    assert [tuple(r) for r in enrich_by_network(ips, nets).collect()] == [("10.0.0.1", "10.0.0.0/8")]
