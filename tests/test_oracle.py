"""Every query with SQL gives the same rows as DuckDB on the smallest tables; the others give rows."""

import os

import pytest

import __spark_entry__ as contract
from tests.compare import connect, difference

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).limit(1).count() == 1


def test_entry(spark):
    assert contract.entry(spark).columns == [
        "user_id", "total_swipes", "right_swipe_rate", "left_swipe_rate", "sessions_count", "events_seen"]
