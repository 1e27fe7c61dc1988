import pytest

import __spark_entry__ as entry
from lexmill.plans import queries as core
from lexmill.plans.oracle import oracle_sql
from tests.comparing import assert_same, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, data, con, name):
    assert_same(core.queries()[name](spark, data), con, oracle_sql()[name])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_docstring_items_of_the_tables(spark, data):
    kinds = {r["kind"] for r in core.docstring_items(spark, data).select("kind").distinct().collect()}
    assert {"class", "function", "method", "error"} <= kinds


def test_training_queries_are_added_only_with_their_package(monkeypatch):
    monkeypatch.setattr(entry, "_training", lambda: None)
    assert not [q for q in entry.queries() if q[0] == "p" and q[1].isdigit()]
