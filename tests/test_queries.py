import importlib

import pytest

import __spark_entry__ as entry

from .oracle import assert_same, connect

PLANS = [importlib.import_module(f"siltstone.plans.{m}") for m in ("reference", "annotated", "splits", "measures", "files")]
QUERIES = {k: f for m in PLANS for k, f in m.QUERIES.items()}
SQL = {k: s for m in PLANS for k, s in m.SQL.items()}


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, data, duck, name):
    assert_same(QUERIES[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_are_not_repeated():
    assert len(QUERIES) == sum(len(m.QUERIES) for m in PLANS)
