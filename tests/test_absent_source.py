"""A source that raised no alert is no node: nothing is reached from it."""

import os

import __spark_entry__ as entry
import duckdb
from compare import TABLES, check, duck

SMALL = "/root/testdata/sf0.001"


def test_component_of_an_absent_source_is_empty(spark, tmp_path):
    for name in set(TABLES) - {"events"}:
        os.symlink(f"{SMALL}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    duckdb.sql(f"COPY (SELECT * FROM '{SMALL}/events.parquet' WHERE user_id <> 3) TO '{tmp_path}/events.parquet'")
    name = "g5_component"
    assert check(spark, duck(str(tmp_path)), name, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path)) == (None, 0)
