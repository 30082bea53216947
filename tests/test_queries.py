"""Every registered query against its SQL on the smallest scale."""

import os

import pytest
from compare import check, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    problem, _ = check(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
