"""Every registered query against its SQL, and the flagship query."""

import pytest

import __spark_entry__
from saltmarsh.plans import catalogue
from tests.oracle import assert_same, views


@pytest.fixture(scope="module")
def con(data):
    return views(data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, data, con, name):
    assert_same(catalogue.QUERIES[name](spark, data), con, catalogue.ORACLES[name])


def test_entry_ranks_candidates(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and [r["salience"] for r in rows] == sorted((r["salience"] for r in rows), reverse=True)


def test_all_queries_are_callable():
    assert all(map(callable, __spark_entry__.queries().values()))
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
