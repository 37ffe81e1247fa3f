"""Every registered query against its SQL on the smallest tables."""

import pytest

from oracle import compare, connect
from shiftcast.plans.registry import all_queries, all_sql

SF_DIR = "/root/testdata/sf0.001"
SQL = all_sql()
ROWS_ONLY = sorted(set(all_queries()) - set(SQL))


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert compare(all_queries()[name](spark, SF_DIR), con, SQL[name]) == ""


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_yields_rows(spark, name):
    assert all_queries()[name](spark, SF_DIR).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(all_queries())


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
