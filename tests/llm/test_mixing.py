import numpy as np
import pytest

from lexmill.llm import mixing

pytest.importorskip("public_tokenizers")


def test_quotas_keep_shares_and_caps():
    shares, reps = {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}, {"a": 1, "b": 2, "c": 3, "d": 9}
    q = mixing.quotas({"a": 1000, "b": 1000, "c": 1000, "d": 5}, shares, reps, 1000)
    assert q == {"a": 500, "b": 300, "c": 200, "d": 0}
    q = mixing.quotas({"a": 1000, "b": 50, "c": 1000}, shares, reps, 1000)
    assert q["b"] == 100 and abs(q["a"] / q["c"] - 2.5) < 0.01 and sum(q.values()) == 1000
    assert sum(mixing.quotas({"a": 10, "b": 10, "c": 10}, shares, reps, 10**9).values()) == 10 + 20 + 30
    assert sum(mixing.quotas({}, shares, reps).values()) == 0 == sum(mixing.quotas({"a": 5}, {}, {}).values())


def test_splitting_tree_is_exact_and_even():
    counts = {"a": 1000, "b": 30, "c": 1, "d": 0}
    out = mixing.split_blocks(counts, 7)
    assert {s: int(v.sum()) for s, v in out.items()} == counts
    per = sum(out.values())
    assert per.max() - per.min() <= 1 and all((v >= 0).all() for v in out.values())


def test_splitting_tree_draws_hypergeometrically():
    first = np.array([mixing.split_blocks({"a": 60, "b": 40}, 4, seed)["a"] for seed in range(800)])
    assert np.allclose(first.mean(axis=0), 15, atol=0.3)
    # Variance of the hypergeometric: n K/N (1 - K/N) (N - n) / (N - 1).
    assert np.allclose(first.var(axis=0), 25 * 0.6 * 0.4 * 75 / 99, rtol=0.25)


def test_a_corpus_of_a_trillion_tokens_has_a_mixture_in_every_shard():
    """250,000 shards of 4 M tokens and 11 sources of shares from 0.1 to 50 %."""
    shares = [0.5, 0.2, 0.1, 0.08, 0.05, 0.03, 0.02, 0.01, 0.005, 0.004, 0.001]
    shards = 250_000
    have = np.full(len(shares), mixing.SHARD_BLOCKS * shards, np.int64)
    top = list(mixing.split_tree(have, 0, shards, shards, int(have.sum()), 1, mixing.TOP))
    assert len(top) <= 2 * mixing.TOP and sum(h - l for l, h, _, _ in top) == shards
    assert np.array_equal(sum(n for _, _, n, _ in top), have) and np.array_equal(top[-1][2] + top[-1][3], have)
    for low, high, n, _ in top[:: len(top) // 8]:
        got = np.array([x[2] for x in mixing.split_tree(n, low, high, shards, int(have.sum()), 1)])
        assert np.array_equal(got.sum(axis=0), n) and got.min() > 0  # every shard has some of every source
        assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 1 and abs(got.mean() - mixing.SHARD_BLOCKS) < 1


def test_more_blocks_than_a_draw_can_handle_stay_exact():
    have = np.array([6_000_000_001, 7, 900_000_000_000, 0], np.int64)
    got = mixing.draw(have.copy(), 300_000_000_000, np.random.default_rng(1))
    assert got.sum() == 300_000_000_000 and (got >= 0).all() and (got <= have).all()
    assert abs(got[0] / have[0] - 300_000_000_000 / have.sum()) < 0.01


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 65_537])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 3).tolist()) == list(range(n))


def test_the_end_of_a_quota_is_found_in_ever_smaller_cells(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FILL_TOKENS", 3)
    rng = np.random.default_rng(5)
    places = rng.choice(1 << 34, 3000, replace=False).tolist()
    last = spark.createDataFrame([("a", int(p), 2) for p in places] + [("b", int(p), 1) for p in places[:10]], "source string, place bigint, n_tokens bigint")
    ends = mixing._ends(last, {"a": 1001, "b": 10, "c": 4})
    low, high, allowed = ends["a"]
    assert sum(p < low for p in places) * 2 + allowed == 1001 and allowed < sum(low <= p < high for p in places) * 2 <= 3
    assert ends["b"] == (1 << mixing.PLACE_BITS, 1 << mixing.PLACE_BITS, 0) and ends["c"][2] == 4


def test_a_document_delivered_again_is_drawn_once(spark):
    d, t = tables(spark)
    again = d.unionByName(d.where("doc_id < 50"))
    rows = mixing.mix(again, t, shard_tokens=500)[0].collect()
    assert len({(r["doc_id"], r["repeat_no"]) for r in rows}) == len(rows)
    assert {tuple(r) for r in rows} == {tuple(r) for r in mixing.mix(d, t, shard_tokens=500)[0].collect()}


def test_every_shard_is_a_mixture(spark):
    d, t = tables(spark)
    by = {}
    for r in mixing.mix(d, t, shard_tokens=300)[0].collect():
        by.setdefault(r["shard"], set()).add(r["source"])
    assert len(by) > 4 and all({"big", "mid"} <= s for s in by.values())


def tables(spark, n=400):
    docs = [(i, " Big" if i % 2 else "BIG ", "alpha beta gamma " * (1 + i % 5)) for i in range(n)]
    docs += [(10_000 + i, "small", "one two three") for i in range(5)]
    docs += [(20_000, None, "x"), (20_001, "other", "x"), (20_002, "big", None), (20_003, "big", ""), (20_004, "mid", "word " * 9)]
    docs += [(30_000 + i, "mid", "some words here") for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string").selectExpr("*", "1 AS n_tokens", "2 AS block", "3 AS shard")
    t = spark.createDataFrame([("big", 0.6, 1), ("Small ", 0.1, 3), ("mid", 0.3, 4), ("none", 0.0, 2), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    return d, t


def test_mixture(spark):
    d, t = tables(spark)
    drawn, report = mixing.mix(d, t, shard_tokens=500)
    rows = drawn.collect()
    rep = {r["source"]: r for r in report.collect()}
    assert len({(r["doc_id"], r["repeat_no"]) for r in rows}) == len(rows)
    assert max(r["repeat_no"] for r in rows if r["source"] == "small") == 3 and rep["small"]["exhausted"] and rep["absent"]["exhausted"]
    assert not {r["doc_id"] for r in rows} & {20_000, 20_001, 20_002, 20_003}
    assert all(r["repeat_no"] <= rep[r["source"]]["max_repeats"] for r in rows)
    assert abs(rep["big"]["actual_share"] / rep["mid"]["actual_share"] - 2) < 0.1 and abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-6
    assert rep["big"]["drawn_rows"] == sum(r["source"] == "big" for r in rows)
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r["position"])
    assert len(shards) > 2 and all(sorted(p) == list(range(1, len(p) + 1)) for p in shards.values())
    again = {tuple(r) for r in mixing.mix(d, t, shard_tokens=500)[0].collect()}
    assert again == {tuple(r) for r in rows}
    other = {tuple(r) for r in mixing.mix(d, t, shard_tokens=500, seed=4)[0].collect()}
    assert other != again


def test_order_in_a_shard_is_shuffled(spark):
    d, t = tables(spark)
    ids = [r["doc_id"] for r in mixing.mix(d, t)[0].where("source = 'big'").orderBy("shard", "position").collect()]
    assert ids != sorted(ids)


def test_a_stated_size_is_met(spark):
    d, t = tables(spark)
    _, report = mixing.mix(d, t, total=300)
    assert abs(sum(r["drawn_tokens"] for r in report.collect()) - 300) < 40


def test_nothing_to_mix(spark):
    d, t = tables(spark)
    for x, y in ((d.where("false"), t), (d, t.where("false"))):
        drawn, report = mixing.mix(x, y)
        assert drawn.count() == 0 and report.count() == y.count()
