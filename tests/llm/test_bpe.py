import random

import pytest

from lexmill.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module", params=["byte_bpe_50k", "byte_bpe_multi_50k"])
def both(request):
    path = bpe.vocabulary_path(request.param)
    own = bpe.TextEncoder(path)
    return own, tiktoken.Encoding("own", pat_str=bpe.split_pattern(), mergeable_ranks=own.packed.pieces.ranks, special_tokens={})


TEXTS = ["", " ", "\n\n  \t", "it's we'll I'M", "a" * 3000, "<|endoftext|> <|im_start|>", "中文字符测试" * 50, "😀👩‍👩‍👧 é́", "x" * 500 + " " * 500, "foo_bar(baz)==1234567", "​﻿\x00\x1f", "ﬁne ﬂow", "\r\n" * 40]


def test_equals_the_reference_encoder(both):
    own, ref = both
    rng = random.Random(2)
    words = ["the", " a", "Zeit", "12", "é", "😀", "\n", "  ", "'s", "-", "qz", "ing", "\u3000"]
    for t in [*TEXTS, *("".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(400))]:
        assert own.encode(t) == ref.encode_ordinary(t)
        assert ref.decode(own.encode(t)) == t
        assert own.count(t) == len(own.encode(t))


def test_every_prefix_is_encoded_by_its_last_tokens(both):
    own, ref = both
    p = own.packed.pieces
    for piece in (b"internationalisation", "größenordnungen".encode(), b"aaaaaaaaaaaaaaaaaaab", b"zqxjkvbpwm"):
        last = p.extend([], piece, 0)
        for n in range(1, len(piece) + 1):
            assert p.read_back(last[:n]) == ref._encode_single_piece(piece[:n])


def test_append_and_edit_equal_encoding_anew(both):
    p = both[0].packed.pieces
    rng = random.Random(5)
    for _ in range(100):
        a, b = (bytes(rng.choices(b"abcdefgtheing", k=rng.randrange(1, 25))) for _ in range(2))
        last = p.extend([], a, 0)
        assert p.append(last, a, b) == p.extend([], a + b, 0)
        at = rng.randrange(len(a))
        changed, new = p.edit(last, a, at, 2, b)
        assert changed == a[:at] + b + a[at + 2 :] and new == p.extend([], changed, 0)


def test_an_edited_text_keeps_the_ids_beside_the_edit(both):
    own = both[0]
    rng = random.Random(8)
    parts = ["a", "the ", "don't", "'s ", " ", "  ", "\n", "\n\n", "123", "45", ".", ", ", "é", "你好", "x" * 9, "🙂", "\t", "'"]
    for _ in range(600):
        t = "".join(rng.choices(parts, k=rng.randrange(1, 60)))
        at = rng.randrange(len(t) + 1)
        gone, new = rng.randrange(min(6, len(t) - at) + 1), "".join(rng.choices(parts, k=rng.randrange(3)))
        changed, ids = own.replace(t, own.encode(t), at, gone, new)
        assert changed == t[:at] + new + t[at + gone :] and ids == own.encode(changed)


def test_known_pairs_are_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 20)
    p = bpe.PrefixEncoder(both[0].packed.pieces.ranks)
    p.extend([], b"an ordinary piece of text that is long enough", 0)
    assert len(p.pairs) <= 20


def test_cache_is_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    own = bpe.TextEncoder(bpe.vocabulary_path())
    own.encode(" ".join(f"w{i}" for i in range(100)))
    assert len(own.packed) <= 11


def test_column_of_ids(spark):
    rows = [(1, "hello world", "k"), (2, None, None), (3, "", "k"), (3, "", "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = bpe.encode_column(df, keep=["doc_id"])
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted((r["doc_id"], r["ids"]) for r in got.collect()) == [(1, [31373, 995]), (2, []), (3, []), (3, [])]
    assert bpe.count_tokens(df, keep=["doc_id"]).agg({"n_tokens": "sum"}).first()[0] == 2
    assert bpe.encode_column(df.where("false")).count() == 0
    assert bpe.encode_column(df).columns == ["doc_id", "ids"]
