import random

import numpy as np
import pytest

from lexmill.llm import neardup


def corpus(seed, n=120, copies=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        base = rng.choices(vocab, k=rng.choice([20, 21, 25, 40, 80, 300]))
        out.append(base)
        for _ in range(rng.randrange(copies)):
            x = list(base)
            for _ in range(rng.randrange(0, max(2, len(x) // 12))):
                k, what = rng.randrange(len(x)), rng.random()
                if what < 0.4:
                    x[k] = rng.choice(vocab)
                elif what < 0.7 and len(x) > 21:
                    x.pop(k)
                else:
                    x.insert(k, rng.choice(vocab))
            out.append(x)
    return [(f"{i:04d}", rng.choice([" ", "  ", "\n", ", "]).join(x)) for i, x in enumerate(out)]


def brute(rows, least=20, similarity=0.6, size=3):
    sets = {i: neardup.shingle_set(t, size) for i, t in rows if t is not None and len(neardup._WORDS(t.lower())) >= least}
    ids, out = sorted(sets), {}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            s = both / (len(sets[a]) + len(sets[b]) - both)
            if s >= similarity:
                out[a, b] = s
    return out


@pytest.mark.parametrize("seed,parts,limits", [(1, 1, {}), (2, 7, {"node": 1}), (3, 3, {"node": 2, "cell": 2}), (1, 3, {"hot": 1, "cell": 3})])
def test_pairs_equal_brute_force(spark, seed, parts, limits):
    """Small blocks, large ones through trees, in cells, and all shingles taken for hot ones."""
    rows = corpus(seed)
    rows += [rows[0], (rows[1][0] + "copy", rows[1][1].upper()), ("n", None), ("short", "too few words here"), ("empty", "")]
    df = spark.createDataFrame(rows, "id string, text string").selectExpr("*", "1 AS sig", "2 AS part", "3 AS similarity").repartition(3)
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in neardup.similar_pairs(df, parts=parts, **limits).collect()}
    want = brute(dict(rows).items())
    assert set(got) == set(want) and len(want) > 50
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_a_third_of_all_rows_in_one_family(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = corpus(4, 40, 1)
    for i in range(20):
        x = list(base)
        x[rng.randrange(60)] = f"z{i}"
        rows.append((f"f{i:02d}", " ".join(x)))
    got = {(r["id_a"], r["id_b"]) for r in neardup.similar_pairs(spark.createDataFrame(rows, "id string, text string")).select("id_a", "id_b").collect()}
    assert got == set(brute(rows)) and len([p for p in got if p[0][0] == p[1][0] == "f"]) == 190


def test_parts_of_a_class_meet_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CLASS_PART", 4)
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(f"a{i:02d}", text) for i in range(23)] + [(f"b{i}", text + " more") for i in range(9)]
    got = [(r["id_a"], r["id_b"]) for r in neardup.similar_pairs(spark.createDataFrame(rows, "id string, text string")).collect()]
    assert len(got) == len(set(got)) == 32 * 31 // 2 and all(a < b for a, b in got)


def test_points_are_packed_without_loss():
    import pyarrow as pa

    x = np.random.default_rng(2).integers(0, 16, (50, neardup.GROUPS)).astype(np.uint8)
    x[::7, 3] = 200
    assert np.array_equal(neardup._unpack_points(pa.array(neardup._pack_points(x), pa.binary())), x)


def test_tree_finds_every_pair_that_the_bound_allows():
    rng = np.random.default_rng(1)
    base = rng.integers(1, 4, (40, neardup.GROUPS)) * (rng.random((40, neardup.GROUPS)) < 0.3)
    points = np.minimum(np.repeat(base, 40, axis=0) + (rng.random((1600, neardup.GROUPS)) < 0.02), 255).astype(np.uint8)
    sizes = points.sum(axis=1, dtype=np.int64) + rng.integers(0, 2, 1600)
    need = neardup._Need(0.6)
    got = set()
    for i, j in neardup.PointTree(points, sizes, need).pairs():
        got |= set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist()))
    for a in range(0, 1600, 37):
        shared = np.minimum(points[a], points).sum(axis=1, dtype=np.int64) + np.minimum(sizes[a] - points[a].sum(dtype=np.int64), sizes - points.sum(axis=1, dtype=np.int64))
        ok = (shared >= need.overlap(sizes[a], sizes)) & (np.minimum(sizes[a], sizes) >= need.ratio * np.maximum(sizes[a], sizes))
        assert all((min(a, b), max(a, b)) in got for b in np.flatnonzero(ok).tolist() if b != a)
    assert len(got) < 1600 * 1599 // 20


def test_five_word_shingles_at_four_fifths(spark):
    rows = corpus(6, 60)
    got = {(r["id_a"], r["id_b"]) for r in neardup.similar_pairs(spark.createDataFrame(rows, "id string, text string"), similarity=0.8, shingle=5).collect()}
    assert got == set(brute(rows, similarity=0.8, size=5)) and got


def test_groups_are_connected_components_of_classes(spark):
    pairs = spark.createDataFrame([("a", "b", 0.7), ("b", "c", 0.7), ("c", "d", 0.7), ("d", "e", 0.7), ("x", "y", 0.7)], "id_a string, id_b string, similarity double")
    members = spark.createDataFrame([(c, c) for c in "abcdexyzw"] + [("b", "b2"), ("b", "b3"), ("z", "z2")], "class_id string, id string")
    got = {r["id"]: (r["class_id"], r["group_id"], r["n_links"]) for r in neardup.groups(pairs, members).collect()}
    assert got == {
        "a": ("a", "a", 3), "b": ("b", "a", 4), "b2": ("b", "a", 4), "b3": ("b", "a", 4), "c": ("c", "a", 4), "d": ("d", "a", 2), "e": ("e", "a", 1), "x": ("x", "x", 1), "y": ("y", "x", 1), "z": ("z", "z", 1), "z2": ("z", "z", 1),
    }


def test_links_of_groups_equal_the_pairs(spark):
    rows = corpus(8, 50)
    rows += [(f"copy{i}", rows[i % 3][1]) for i in range(9)]
    df = spark.createDataFrame(rows, "id string, text string")
    want = {}
    for a, b in brute(rows):
        want[a], want[b] = want.get(a, 0) + 1, want.get(b, 0) + 1
    assert {r["id"]: r["n_links"] for r in neardup.groups(*neardup.class_pairs(df)).collect()} == want


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([("a", None), (None, "x " * 50), ("b", "few")], "id string, text string")
    assert neardup.similar_pairs(df).count() == 0
    assert neardup.similar_pairs(df.where("false")).count() == 0


def test_a_very_long_text(spark):
    t = " ".join(f"w{i % 5000}" for i in range(200_000))
    df = spark.createDataFrame([("a", t), ("b", t + " end of it"), ("c", "one two " * 30)], "id string, text string")
    assert [(r["id_a"], r["id_b"]) for r in neardup.similar_pairs(df).collect()] == [("a", "b")]


def test_members_without_a_pair_go_no_further(spark, monkeypatch):
    """Of many texts only those that are like another one are written for the pairing of classes."""
    written, real = {}, neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name: written.setdefault(name, real(df, name)))
    rows = corpus(12, 80, 2)
    rows += [("copy", rows[0][1])]
    got = neardup.similar_pairs(spark.createDataFrame(rows, "id string, text string")).collect()
    assert {(r["id_a"], r["id_b"]) for r in got} == set(brute(rows))
    like = {i for r in got for i in (r["id_a"], r["id_b"])}
    assert {r["id"] for r in written["placed"].collect()} == like and len(like) < len(rows)


@pytest.mark.parametrize("kind,most", [("uint8", 250), ("uint16", 250), ("uint32", 250), ("uint64", 1 << 40), ("int64", 1 << 62)])
def test_numbers_are_packed_without_their_zero_bytes(kind, most):
    x = np.random.default_rng(3).integers(0, most, 5000).astype(kind)
    packed = neardup._pack(x)
    assert np.array_equal(neardup._unpack(packed, len(x), kind), x) and neardup._unpack(neardup._pack(x[:0]), 0, kind).dtype == x.dtype
    assert len(packed) < len(x) * np.log2(most) / 8 * 1.07 + 60


def test_blocks_that_fit_a_task_are_not_sent_on(spark, monkeypatch):
    written, real = {}, neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name: written.setdefault(name, real(df, name)))
    rows = corpus(5, 60)
    got = {(r["id_a"], r["id_b"]) for r in neardup.similar_pairs(spark.createDataFrame(rows, "id string, text string"), node=1).collect()}
    assert got == set(brute(rows)) and got
    assert written["entries"].count() >= len(got) and written["entries"].where("block IS NOT NULL").count() == 0


def test_points_do_not_multiply_with_the_partitions_of_a_shuffle(spark, monkeypatch):
    used, real = [], neardup._second_pass
    monkeypatch.setattr(neardup, "_second_pass", lambda *args: used.append(args[1]) or real(*args))
    rows = corpus(7, 30)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        neardup.similar_pairs(spark.createDataFrame(rows, "id string, text string"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert used == [spark.sparkContext.defaultParallelism]


@pytest.mark.parametrize("limits", [{}, {"hot": 1, "cell": 5}])
def test_shingles_that_fall_together_lose_no_pair(spark, monkeypatch, limits):
    """Blocks named by so few bits that each holds many shingles, several of one text as well."""
    monkeypatch.setattr(neardup, "SPARE_BITS", -8)
    rows = corpus(10, 60)
    got = {(r["id_a"], r["id_b"]) for r in neardup.similar_pairs(spark.createDataFrame(rows, "id string, text string"), **limits).collect()}
    assert got == set(brute(rows)) and got


def test_points_of_a_task_take_half_a_byte_a_count():
    x = np.random.default_rng(4).integers(0, 16, (90, neardup.GROUPS)).astype(np.uint8)
    x[[3, 40, 89], 5], x[41] = 16, 255
    rows = neardup._PointRows(90)
    for at in (0, 30, 60):
        rows.put(at, x[at : at + 30])
    some = np.array([89, 3, 3, 40, 0, 41, 88])
    assert np.array_equal(rows[np.arange(90)], x) and np.array_equal(rows[some], x[some]) and rows[some[:0]].shape == (0, neardup.GROUPS)
    assert rows.half.nbytes == x.nbytes // 2 and len(rows.large) == 4


@pytest.mark.parametrize("limits", [{}, {"node": 2, "cell": 3}])
def test_a_partition_in_slices_finds_the_same(spark, monkeypatch, limits):
    rows = corpus(11, 60)
    monkeypatch.setattr(neardup, "SLICE", 40)
    got = {(r["id_a"], r["id_b"]) for r in neardup.similar_pairs(spark.createDataFrame(rows, "id string, text string"), parts=2, **limits).collect()}
    assert got == set(brute(rows)) and got
