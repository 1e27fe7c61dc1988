import math
import re
from collections import Counter

import numpy as np
import pytest

from lexmill.operators import fusion, lexical, vector, vector_index

DOCS = [
    ("a", "x", "the cat sat on the mat"),
    ("b", "x", "the dog sat"),
    ("c", "y", "a cat and a dog and the end"),
    ("d", "y", "nothing in common here"),
    ("e", "y", ""),
    ("f", "x", "the dog sat"),
]


def bm25(docs, query, only=None, k1=1.5, b=0.75, eps=0.25):
    toks = {i: re.findall(r"\w+", t.lower()) for i, _, t in docs}
    n, avgdl = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: eps * mean if v < 0 else v for w, v in raw.items()}
    out = {}
    for i, cat, _ in docs:
        if only and cat != only:
            continue
        tf = Counter(toks[i])
        s = sum(idf.get(q, 0) * tf[q] * (k1 + 1) / (tf[q] + k1 * (1 - b + b * len(toks[i]) / avgdl)) for q in re.findall(r"\w+", query.lower()) if tf[q])
        if round(s, 6) > 0:
            out[i] = round(s, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.fixture(scope="module")
def index(spark):
    return lexical.build_index(spark.createDataFrame(DOCS, "id string, category string, text string"))


@pytest.mark.parametrize("query,only", [("cat", None), ("cat dog dog", None), ("the", None), ("the cat", "y"), ("absent", None), ("", None), ("CAT, sat!", "x")])
def test_bm25_equals_the_formula(spark, index, query, only):
    q = spark.createDataFrame([(1, query)], "query_id bigint, query string")
    got = [(r["id"], r["score"]) for r in lexical.bm25_search(index, q, 20, only).orderBy("rank").collect()]
    want = bm25(DOCS, query, only)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got, want))


def test_an_empty_corpus_gives_an_empty_index(spark):
    index = lexical.build_index(spark.createDataFrame([], "id string, category string, text string"))
    q = spark.createDataFrame([(1, "x")], "query_id bigint, query string")
    assert lexical.bm25_search(index, q).count() == 0


def test_cosine_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 16)).astype("float32")
    m[5] = m[7]  # a tie
    rows = [(i, m[i].tolist()) for i in range(300)] + [(900, None), (901, [0.0] * 16), (902, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(5)
    q = df.where("id % 50 = 0 OR id = 7").selectExpr("id AS query_id", "embedding")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in vector.cosine_topk(df, q, 6).collect()}
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    for k in [0, 7, 50, 100, 150, 200, 250]:
        s = np.round(u @ u[k], 6)
        best = sorted(range(300), key=lambda i: (-s[i], i))[:6]
        assert [got[k, r][0] for r in range(1, 7)] == best


def test_more_wanted_than_there_are(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id bigint, embedding array<float>")
    assert vector.cosine_topk(df, df.selectExpr("id AS query_id", "embedding"), 50).count() == 4


def ranking(spark, ids, q=1):
    return spark.createDataFrame([(q, i, 0.0, k) for k, i in enumerate(ids, 1)], "query_id bigint, id string, score double, rank int")


def rrf(a, b, k=60):
    s = {}
    for ids in (a, b):
        for r, i in enumerate(ids):
            s[i] = s.get(i, 0) + 1 / (k + r + 1)
    return sorted(s, key=lambda i: -s[i])


@pytest.mark.parametrize("a,b", [("abc", "cbd"), ("abc", ""), ("", "xy"), ("abcdef", "fedcba"), ("ab", "cd"), ("", "")])
def test_rrf_equals_the_sum_with_stable_ties(spark, a, b):
    got = [r["id"] for r in fusion.rrf(ranking(spark, a), ranking(spark, b)).orderBy("rank").collect()]
    assert got == rrf(list(a), list(b))


def test_parents_come_first_by_hits_and_merge_their_children(spark):
    hits = [(1, 1, "c1", "t1", "flat", None), (1, 2, "c2", "t2", "p", "P1"), (1, 3, "c3", "t3", "p", "P2"), (1, 4, "c4", "t4", "p", "P2"), (1, 5, "c5", "t5", "p", "gone")]
    df = spark.createDataFrame([(*h[:3], h[3], h[4], "s", "sp", "m", h[5]) for h in hits], "query_id bigint, rank int, id string, text string, category string, source string, source_path string, module string, parent_id string")
    parents = spark.createDataFrame([("P1", "one"), ("P2", "two"), ("P2", "two")], "parent_id string, text string")
    got = [(r["text"], r["hits"]) for r in fusion.resolve_parents(df, parents).orderBy("rank").collect()]
    assert got == [("two", 2), ("one", 1), ("t1", 1), ("t5", 1)]


def test_rendering(spark):
    q = spark.createDataFrame([(1, "cat"), (2, "none")], "query_id bigint, query string")
    res = spark.createDataFrame([(1, 1, "x" * 2100, "docs", "a.md", "mod"), (1, 2, "short", "web", "b.md", "")], "query_id bigint, rank int, text string, category string, source string, module string")
    got = {r["query_id"]: r["rendered"] for r in fusion.render_results(res, q).collect()}
    lines = got[1].split("\n")
    assert lines[0] == 'Found 2 result(s) for: "cat"' and lines[2] == "--- Result 1 | [docs] (mod) | a.md ---"
    assert lines[3] == "x" * 2000 and lines[4] == "... [truncated]" and "--- Result 2 | [web] | b.md ---" in lines
    assert got[2].startswith('No results found for: "none"')


def test_argument_clamps():
    assert [fusion.wanted_results(n) for n in (-1, 0, 3, 99)] == [1, 1, 3, 15]
    assert [fusion.fetch_size(n) for n in (1, 8, 15)] == [3, 24, 30]


def test_inverted_file_of_vectors(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(30, 24))
    m = np.repeat(base, 40, axis=0) + rng.normal(size=(1200, 24)) * 0.4
    rows = [(i, m[i].tolist()) for i in range(1200)] + [(9000, None), (9001, [1.0, 2.0]), (9002, [0.0] * 24)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>").selectExpr("*", "1 AS cell").repartition(4)
    q = df.where("id % 100 = 0 OR id = 9000").selectExpr("id AS query_id", "embedding")
    centres = vector_index.fit_centres(df, 40)
    index = vector_index.packed(vector_index.assign(df, centres))
    key = lambda x: {(r["query_id"], r["rank"], r["id"], r["score"]) for r in x.collect()}
    exact = key(vector.cosine_topk(df, q, 10))
    assert key(vector_index.search(index, centres, q, 10, probes=40)) == exact  # all cells open
    pair = lambda x: {(a, c) for a, _, c, _ in x}
    near = pair(key(vector_index.search(index, centres, q, 10, probes=8)))
    assert len(near & pair(exact)) / len(exact) >= 0.9


def test_an_empty_inverted_file(spark):
    df = spark.createDataFrame([], "id bigint, embedding array<double>")
    centres = vector_index.fit_centres(df)
    index = vector_index.packed(vector_index.assign(df, centres))
    q = spark.createDataFrame([(1, [1.0])], "query_id bigint, embedding array<double>")
    assert vector_index.search(index, centres, q).count() == 0


def test_only_parents_of_hits_are_read(spark):
    hits = spark.createDataFrame([(1, 1, "c1", "t", "", "", "", "", "p1")], "query_id bigint, rank int, id string, text string, category string, source string, source_path string, module string, parent_id string")
    parents = spark.createDataFrame([("p1", "old"), ("p1", "older"), ("p2", "x")], "parent_id string, text string")
    got = fusion.resolve_parents(hits, parents).collect()
    assert [(r["text"], r["parent_id"]) for r in got] == [("older", "p1")]


@pytest.mark.parametrize("n,block", [(3, 4096), (20, 7), (1, 64)])
def test_many_queries_rank_as_one_by_one(spark, monkeypatch, n, block):
    """Equal texts, terms in most texts, query words twice, and blank, null and unknown queries; blocks of few texts."""
    from lexmill.operators import lexical_batch

    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(f"d{i:03d}", "x", " ".join(["the", *rng.choice(words, rng.integers(0, 30), p=np.arange(60, 0, -1) / 1830)]) if i % 9 else "") for i in range(300)]
    docs += [(f"e{i}", "x", docs[i][2]) for i in range(100)]
    asked = [(k, " ".join(rng.choice([*words, "the", "the", "absent"], rng.integers(1, 6)))) for k in range(40)] + [(40, ""), (41, None), (42, "absent"), (43, "the"), (44, "w1 w1 w1 the")]
    df, q = spark.createDataFrame(docs, "id string, category string, text string").repartition(5), spark.createDataFrame(asked, "query_id bigint, query string")
    monkeypatch.setattr(lexical_batch, "QUERY_TERMS", block)
    got = sorted(map(tuple, lexical_batch.bm25_many(df, q, n).collect()))
    assert got == sorted(map(tuple, lexical.bm25_search(lexical.build_index(df), q, n).collect())) and len(got) > 40
    assert lexical_batch.bm25_many(df.where("false"), q, n).count() == 0 == lexical_batch.bm25_many(df, q.where("false"), n).count()


def test_a_batch_shuffles_no_pairs_of_queries_and_texts(spark):
    """What reaches the last shuffle is n rows of each query and task, however many texts match."""
    from lexmill.plans import queries

    docs = spark.range(2000).selectExpr("cast(id as string) AS id", "'x' AS category", "concat('same w', id % 50) AS text")
    q = spark.range(100).selectExpr("id AS query_id", "concat('w', id % 50, ' w', id % 7) AS query")
    found = queries.lexical_batch.bm25_many(docs, q, 2)
    assert found.count() == 200 and not any(x in found._jdf.queryExecution().executedPlan().toString() for x in ("SortMergeJoin", "HashAggregate(keys=[query_id"))
