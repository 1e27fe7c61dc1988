import pytest

from lexmill.llm import queries as q
from tests.comparing import assert_same, connect


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    assert_same(q.queries()[name](spark, data), connect(data), q.oracle_sql()[name])


KEYS = {"p1_found": ["file_id", "line_no"], "p2_found": ["item_id"], "p3_found": ["id_a", "id_b"], "p4_found": ["file_id"], "p5_found": ["id", "line_no"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query_runs_on_the_small_tables(spark, data, name):
    df = q.queries()[name](spark, data)
    if name in KEYS:
        assert df.columns == KEYS[name]
        key = [c for c in df.columns if c != "ids"]
        rows = df.select(*key).collect()
        assert len(rows) == len(set(rows)) and rows
    else:
        assert df.count() > 0
