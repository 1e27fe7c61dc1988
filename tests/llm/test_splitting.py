import random
import time

import pytest

from lexmill.llm import splitting


def pieces(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, text string, size_limit int, size_overlap int")
    out = {i: [] for i in range(len(rows))}
    for r in splitting.split_items(df).orderBy("k", "piece_no").collect():
        out[r["k"]].append((r["start"], r["piece"]))
    return out


def test_pieces_keep_the_limit_overlap_and_join_to_the_text(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(150):
        n = rng.randrange(0, 400)
        t = "".join(rng.choices(["word", " ", ". ", "\n", "\n\n", "é", "😀", "。", ", ", "x" * 30], k=n // 3))
        rows.append((t, rng.choice([1, 2, 5, 20, 50, 90]), rng.choice([None, 0, 1, 3, 19, 60, -4])))
    got = pieces(spark, rows)
    for i, (t, limit, overlap) in enumerate(rows):
        over = max(0, min(overlap or 0, limit - 1))
        joined = ""
        for k, (start, p) in enumerate(got[i]):
            assert 0 < len(p) <= limit and t[start : start + len(p)] == p
            if k:
                assert start == max(0, len(joined) - over)
            joined = joined[:start] + p
        assert joined == t


def test_boundaries_from_strong_to_weak(spark):
    got = pieces(spark, [("aaaa bbb.\n\ncccc ddd eee", 16, 0), ("aaaa bbbb.\ncccc dddd", 14, 0), ("One two. Three four five", 14, 0), ("aaa bbb ccc ddd", 10, 0), ("abcdefghij", 4, 1)])
    assert [p for _, p in got[0]] == ["aaaa bbb.\n\n", "cccc ddd eee"]
    assert [p for _, p in got[1]] == ["aaaa bbbb.\n", "cccc dddd"]
    assert [p for _, p in got[2]][0] == "One two. "
    assert [p for _, p in got[3]] == ["aaa bbb ", "ccc ddd"]
    assert [p for _, p in got[4]] == ["abc", "cdef", "fghi", "ij"]


@pytest.mark.parametrize("limit", [None, 0, -5])
def test_no_limit_gives_one_piece(spark, limit):
    assert [p for _, p in pieces(spark, [("x" * 500, limit, 10)])[0]] == ["x" * 500]


def test_null_and_empty_texts_and_a_very_long_one(spark):
    got = pieces(spark, [(None, 5, 1), ("", 5, 1), ("ab " * 100_000, 1000, 100)])
    assert got[0] == got[1] == [] and len(got[2]) > 300


def test_time_grows_with_the_length_and_not_its_square(spark):
    """A million characters in pieces of 300, at most a small multiple of the time of a quarter of them."""
    text = "One word, some more. " * 48_000
    took = []
    for n in (1000, 250_000, 1_000_000):
        began = time.perf_counter()
        got = pieces(spark, [(text[:n], 300, 50)])[0]
        took.append(time.perf_counter() - began)
        assert sum(len(p) for _, p in got) - 50 * (len(got) - 1) == n
    assert took[2] < 6 and took[2] < 8 * took[1] + 2


def test_items_without_id_are_kept_apart_by_their_text(spark):
    chunks, parents, cats = tables(spark)
    more = chunks.where("id = 'a'").selectExpr("CAST(NULL AS string) AS id", "category", "'abcdefgh' AS text", "size_limit", "piece")
    made = splitting.corpus_pieces(more.unionByName(more).unionByName(chunks.where("id IS NULL")), parents, cats).where("item_id IS NULL AND item_kind = 'chunk'")
    assert made.where("piece_no = 0").count() == 2


def tables(spark):
    cats = spark.createDataFrame(
        [("h", "heading", 10, 4, 2, 1), ("n", "heading", 10, None, None, None), ("z", "char", 10, 0, 3, 9), ("w", "whole_file", 3, 2, 0, 0), ("o", "char", 0, None, 1, None)],
        "category string, chunk_strategy string, chunk_size int, child_chunk_size int, chunk_overlap int, child_overlap int",
    )
    chunks = spark.createDataFrame(
        [("a", "h", "12345"), ("a", "h", "12345"), ("b", "h", "1234"), ("c", "n", "12345678901"), ("d", "z", "12345678901"), ("e", "w", "x" * 99), ("f", "o", "x" * 99), ("g", None, "x" * 99), ("i", "h", None), ("j", "unknown", "x" * 99), (None, "h", "x" * 99), ("k", "h", "😀😀😀😀")],
        "id string, category string, text string",
    ).selectExpr("*", "1 AS size_limit", "2 AS piece")
    parents = spark.createDataFrame([("p", "h", "12345678901"), ("p", "h", "12345678901"), ("q", "h", "1234567890")], "parent_id string, category string, text string")
    return chunks, parents, cats


def test_oversized_items_by_their_category(spark):
    assert sorted(r[0] for r in splitting.oversized(*tables(spark)).collect()) == ["a", "c", "d", "p"]


def test_corpus_pieces_come_once(spark):
    rows = splitting.corpus_pieces(*tables(spark)).where("item_id IN ('a', 'p')").orderBy("item_id", "piece_no").collect()
    assert [(r["item_id"], r["piece"]) for r in rows if r["item_id"] == "a"] == [("a", "123"), ("a", "345")]
    assert all(len(r["piece"]) <= r["size_limit"] for r in rows)


def test_empty_tables(spark):
    chunks, parents, cats = tables(spark)
    assert splitting.oversized(chunks.where("false"), parents.where("false"), cats.where("false")).count() == 0
