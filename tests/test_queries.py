"""Every registered query against its SQL in DuckDB; those without SQL must give rows."""

import pytest

import __spark_entry__ as entry
from testbed.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    problem, n = compare(spark, con, entry.queries()[name], SQL.get(name), SF_DIR)
    assert problem is None
    assert n > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
