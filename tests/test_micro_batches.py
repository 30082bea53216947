"""Micro-batches of several files: no task writes or reads a whole one, and the results stay."""

import glob
import os

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F
from compare import TABLES, check, duck
from workload import streams
from workload.base import table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """A folder of its own: tables on the way are kept per folder."""
    folder = str(tmp_path_factory.mktemp("small"))
    for name in TABLES:
        os.symlink(f"{SMALL}/{name}.parquet", f"{folder}/{name}.parquet")
    return folder


def test_each_micro_batch_has_as_many_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(streams, "ROWS_PER_FILE", 60)
    rows, path = table(spark, SMALL, "events"), str(tmp_path / "rows")
    files = streams.write_micro_batches(rows, [F.col("event_id") % 3 == k for k in range(3)], path)
    assert files == 5
    written = sorted(glob.glob(path + "/*.parquet"), key=os.path.getmtime)
    assert len(written) == 15
    for k in range(3):
        ids = [r[0] for r in spark.read.parquet(*written[5 * k:5 * k + 5]).select("event_id").collect()]
        assert sorted(ids) == list(range(k, 1000, 3))


@pytest.mark.parametrize("name", ["r7_rule_refresh", "r4_streaming_dedup", "r2_streaming_sequences"])
def test_rows_equal_the_sql(spark, monkeypatch, small, name):
    monkeypatch.setattr(streams, "ROWS_PER_FILE", 60)
    problem, n = check(spark, duck(small), name, entry.queries()[name], entry.oracle_sql()[name], small)
    assert problem is None and n > 0
