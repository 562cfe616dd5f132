"""Every query with a DuckDB twin gives the same types and rows; the others give rows."""

import pytest
from conftest import SF
from oracle import connect, differences

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
SLOW = {"v4_subword_vocabulary"}  # covered on a smaller corpus in test_vocabulary


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF), duck, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["column1", "column2", "part", "x", "y"]
