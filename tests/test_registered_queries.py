"""Every registered query gives exactly the rows of its SQL twin on the smallest supplied tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as driver_entry
from tallyscope.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver_entry.queries())


def test_entry_has_rows(spark):
    assert driver_entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, folder, name):
    assert compare(QUERIES[name](spark, folder), con, ORACLE[name]) is None
