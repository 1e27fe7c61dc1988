"""Near-duplicate texts by word shingles, verified by their exact Jaccard similarity.

Shingles are hashed into groups; the counts per group are a text's point, and
the sum over the groups of the smaller count bounds how many shingles two texts
can share.  Texts that could be similar meet in blocks:

1. one pass names each text by its shingles and sums a sketch of fixed size of
   how often shingles occur;
2. a second pass sorts each text's shingles from rare to frequent by that
   sketch (any common order is exact, this one keeps blocks small) and sends
   the leading ones, enough that two similar texts must share one, to the block
   of the shingle, with the text's size and point; those that occur in one text
   only are left out.  A block is named by no more bits of its shingle's hash
   than keep shingles apart at this size of the corpus; two that fall together
   make one larger block;
3. in small blocks pairs pass by size, by position of the shared shingle and by
   the bound of summed minima; large blocks go through an R-tree over their
   points in the same task, blocks of more than ``CELL`` texts are sent on in
   cells of pairs of their parts, so that no task holds more than two parts;
4. surviving pairs are verified on the texts.

Texts with equal shingles are one class (copies of a text reach a block at most
once a task).  Texts of fewer than ``least_words`` words, null texts and null
ids take no part.  A row delivered again counts once.  Nothing is capped.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import materialize

SIMILARITY = 0.6
SHINGLE = 3
LEAST_WORDS = 20

HASH_BITS = 44
RANK_BITS = 8
SKETCH_BITS = 23  # counters of the sketch: its size does not grow with the data
SKETCH_PARTS = 256
GROUPS = 128
LEAF = 16
#: Blocks up to this size (two leaves) are compared at once, larger ones through a tree.
NODE = 2 * LEAF
#: Texts of a block that go through one tree; larger blocks are compared part by part.
CELL = 4096
#: A shingle that the sketch says is in more texts than this (beside what other shingles add to its counter) does not gather in one task.
HOT = 8192
#: Groups of blocks that such shingles' entries pass through unsorted.
HOT_PARTS = 64
#: Shingles of the texts whose leading ones go to one block partition: the larger a partition, the fewer of them a text's point goes to.
PART_SHINGLES = 8_000_000
#: Entries of a block partition that are sorted at once, on average.
SLICE = 500_000
#: Bits of a block's name beyond those that number all shingles: one in 2^SPARE_BITS meets another one at most.
SPARE_BITS = 6
#: Words kept with their hash in a worker.
WORD_CACHE = 500_000
#: Most buckets (as a power of 2) of the filter in front of the verification: 8 MB of bits.
FILTER_BITS = 26
#: Entries of large blocks that are gathered in one group on average, so that a group is not one small block.
TREE_ENTRIES = 20_000
#: Members of a class that are paired with each other in one task.
CLASS_PART = 2000

_WORDS = re.compile(r"\w+").findall
_MASK = np.uint64((1 << HASH_BITS) - 1)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _shingle_hashes(text: str, hashes: dict, size: int) -> np.ndarray:
    """A 44-bit hash of each shingle of the text, in order."""
    words = _WORDS(text.lower())
    a = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(a) < size:
        return a[:0]
    h = a[: len(a) - size + 1].copy()
    for k in range(1, size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[k : len(a) - size + 1 + k]
    return _mix(h) >> np.uint64(64 - HASH_BITS)


class _Batch:
    """The texts of one batch as one array of (text, order, hash), sorted and without repeats."""

    def __init__(self, texts: list, hashes: dict, size: int, least: int, ranks: np.ndarray | None = None):
        rows, parts = [], []
        for k, t in enumerate(texts):
            if t is None:
                continue
            h = _shingle_hashes(t, hashes, size)
            if len(h) + size - 1 >= least and len(h):
                rows.append(k)
                parts.append(h)
        self.rows = np.array(rows, np.int64)
        if not rows:
            self.doc = self.hash = self.rank = self.size = self.sig = np.zeros(0, np.uint64)
            return
        hash_ = np.concatenate(parts)
        doc = np.repeat(np.arange(len(rows), dtype=np.uint64), [len(p) for p in parts])
        # One sort of one integer: text (12 bits), rank (8 bits), hash (44 bits).
        rank = np.zeros(len(hash_), np.uint64) if ranks is None else ranks[hash_ >> np.uint64(HASH_BITS - SKETCH_BITS)].astype(np.uint64)
        key = np.sort((doc << np.uint64(HASH_BITS + RANK_BITS)) | (rank << np.uint64(HASH_BITS)) | hash_)
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        self.doc = (key >> np.uint64(HASH_BITS + RANK_BITS)).astype(np.int64)
        self.hash = key & _MASK
        self.rank = ((key >> np.uint64(HASH_BITS)) & np.uint64((1 << RANK_BITS) - 1)).astype(np.int64)
        self.size = np.bincount(self.doc, minlength=len(rows))
        self.starts = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.sig = np.add.reduceat(_mix(self.hash + np.uint64(0x5851F42D4C957F2D)), self.starts).view(np.int64)


MOST_TEXTS = 1 << 12


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for b in batches:
        for at in range(0, b.num_rows, MOST_TEXTS):
            part = b.slice(at, MOST_TEXTS)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def _pack(x: np.ndarray) -> bytes:
    """Byte by byte of the numbers: their first bytes, then their second ones; those that are zero take no room."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(pa.decompress(data, n * kind.itemsize, codec="zstd", asbytes=True), np.uint8).reshape(kind.itemsize, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _points(b: _Batch) -> np.ndarray:
    flat = np.bincount(b.doc * GROUPS + (b.hash & np.uint64(GROUPS - 1)).astype(np.int64), minlength=len(b.rows) * GROUPS)
    return np.minimum(flat, 255).astype(np.uint8).reshape(-1, GROUPS)


def _pack_points(points: np.ndarray) -> list[bytes]:
    """Two counts a byte where all are small."""
    small = (points < 16).all(axis=1)
    half = points[:, ::2] << 4 | points[:, 1::2] & 15
    return [h.tobytes() if s else p.tobytes() for s, h, p in zip(small, half, points)]


def _unpack_points(column) -> np.ndarray:
    out = np.zeros((len(column), GROUPS), np.uint8)
    lengths = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
    values = column.to_pylist()
    if len(small := np.flatnonzero(lengths == GROUPS // 2)):
        half = np.frombuffer(b"".join(values[k] for k in small), np.uint8).reshape(-1, GROUPS // 2)
        out[small, ::2], out[small, 1::2] = half >> 4, half & 15
    if len(large := np.flatnonzero(lengths == GROUPS)):
        out[large] = np.frombuffer(b"".join(values[k] for k in large), np.uint8).reshape(-1, GROUPS)
    return out


class _PointRows:
    """Points of many texts, two counts a byte; the few with larger counts are kept beside them."""

    def __init__(self, n: int):
        self.half, self.large, self.whole = np.zeros((n, GROUPS // 2), np.uint8), np.zeros(0, np.int64), np.zeros((0, GROUPS), np.uint8)

    def put(self, at: int, points: np.ndarray) -> None:
        """Rows come in order."""
        self.half[at : at + len(points)] = points[:, ::2] << 4 | points[:, 1::2] & 15
        if len(large := np.flatnonzero((points > 15).any(axis=1))):
            self.large, self.whole = np.append(self.large, large + at), np.concatenate([self.whole, points[large]])

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out, half = np.empty((len(rows), GROUPS), np.uint8), self.half[rows]
        out[:, ::2], out[:, 1::2] = half >> 4, half & 15
        if len(self.large):
            at = np.minimum(np.searchsorted(self.large, rows), len(self.large) - 1)
            hit = self.large[at] == rows
            out[hit] = self.whole[at[hit]]
        return out


_FIRST = "sig bigint, id string, part int, counts binary"


def _first_pass(size: int, least: int):
    """Rows (sig, id) of the texts and rows (part, counts) of the sketch."""

    def run(batches):
        hashes, sketch = _WordHashes(), np.zeros(1 << SKETCH_BITS, np.uint32)
        for ids, texts in _slices(batches):
            b = _Batch(texts, hashes, size, least)
            if n := len(b.rows):
                at, times = np.unique((b.hash >> np.uint64(HASH_BITS - SKETCH_BITS)).astype(np.int64), return_counts=True)
                sketch[at] += times.astype(np.uint32)
                own = pa.array([ids[k] for k in b.rows], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(b.sig), own, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["sig", "id", "part", "counts"])
        if sketch.any():
            yield _sketch_rows({k: x for k, x in enumerate(np.split(sketch, SKETCH_PARTS)) if x.any()}, ["sig", "id"])

    return run


def _sketch_rows(parts: dict[int, np.ndarray], nulls: list[str] = []) -> pa.RecordBatch:  # noqa: B006 - read only
    kinds = {"sig": pa.int64(), "id": pa.string()}
    packed = pa.array([_pack(x.astype(np.uint32)) for x in parts.values()], pa.binary())
    return pa.RecordBatch.from_arrays([*(pa.nulls(len(parts), kinds[c]) for c in nulls), pa.array(list(parts), pa.int32()), packed], names=[*nulls, "part", "counts"])


def _add_sketches(batches) -> dict[int, np.ndarray]:
    """Adds up partial sketches as they stream by; holds at most one whole sketch."""
    sums: dict[int, np.ndarray] = {}
    width = (1 << SKETCH_BITS) // SKETCH_PARTS
    for b in batches:
        for part, counts in zip(b.column(0).to_pylist(), b.column(1)):
            x = _unpack(counts.as_py(), width, np.uint32).astype(np.uint64)
            sums[part] = sums[part] + x if part in sums else x
    return sums


def _combine_sketches(batches):
    """Sums of what one split holds, in front of the shuffle; a counter that would not fit stays at its most."""
    if sums := _add_sketches(batches):
        yield _sketch_rows({p: np.minimum(x, np.uint64(2**32 - 1)) for p, x in sums.items()})


def _rank(count: float) -> int:
    return min((1 << RANK_BITS) - 1, math.floor(5 * math.log2(max(count, 1))))


def _sum_sketch(batches):
    if sums := _add_sketches(batches):
        ranks = [np.minimum((1 << RANK_BITS) - 1, np.floor(5 * np.log2(np.maximum(s, 1)) + 1e-9)).astype(np.uint8) for s in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([_pack(r) for r in ranks], pa.binary()), pa.array([int(s.sum()) for s in sums.values()], pa.int64())], names=["part", "ranks", "total"]
        )


def _second_pass(ranks_of, parts: int, size: int, least: int, similarity: float, hot: int, bits: int):
    """For each block partition the leading shingles of the batch's texts, with the texts' sizes.

    Entries of shingles of rank ``hot`` or more go to partitions behind the others.  The last ``bits`` bits of a hash name the block.
    """
    name = np.uint64((1 << bits) - 1)

    def run(batches):
        hashes, ranks, sent = _WordHashes(), np.frombuffer(ranks_of.value, np.uint8), set()
        for _, texts in _slices(batches):
            b = _Batch(texts, hashes, size, least, ranks)
            if not len(b.rows):
                continue
            new = np.zeros(len(b.rows), bool)
            for k, s in enumerate(b.sig.tolist()):
                if s not in sent:
                    new[k] = True
                    sent.add(s)
            if len(sent) > 2_000_000:  # forgetting only repeats work
                sent.clear()
            points, place = _points(b), np.arange(len(b.doc)) - b.starts[b.doc]
            # Rank 0 is a counter of 1: no other text has the shingle.
            lead = (place <= b.size[b.doc] - np.ceil(similarity * b.size[b.doc] - 1e-9)) & new[b.doc] & (b.rank > 0)
            doc, token, place, rank = b.doc[lead], b.hash[lead] & name, place[lead], b.rank[lead]
            part = np.where(rank >= hot, parts + doc % HOT_PARTS, (token % np.uint64(parts)).astype(np.int64))
            order = np.argsort(part, kind="stable")
            doc, token, place, part = doc[order], token[order], place[order], part[order]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            rows = []
            for low, high in zip(cuts, [*cuts[1:], len(part)]):
                s = slice(low, high)
                own, local = np.unique(doc[s], return_inverse=True)
                # The partition says the rest of the division.
                short = token[s] // np.uint64(parts) if part[low] < parts else token[s]
                rows.append((int(part[low]), len(token[s]), len(own), *map(_pack, (short, local.astype(np.uint16), place[s].astype(np.uint32), b.sig[own], b.size[own].astype(np.uint32), points[own]))))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6])], names=["part", "n_tokens", "n_docs", "token", "local", "place", "sig", "size", "points"]
                )

    return run


_BLOCKS = "part int, n_tokens bigint, n_docs bigint, token binary, local binary, place binary, sig binary, size binary, points binary"


class PointTree:
    """A packed R-tree over count vectors, joined with itself.

    Points are packed in order of size and then of their coordinates; a node
    keeps the largest count of each coordinate and the range of its sizes, which bound the overlap
    of anything below it with anything below another node.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, need: _Need):
        self.order = np.lexsort([*(points[:, k] for k in np.argsort(points.var(axis=0))[-6:]), np.floor(np.log(np.maximum(sizes, 1)) * 8)])
        self.points, self.sizes, self.need = points[self.order], sizes[self.order], need
        self.slack = self.sizes - self.points.sum(axis=1, dtype=np.int64)
        at = np.arange(0, len(sizes), LEAF)
        self.levels = []
        top, low, high, slack = self.points, self.sizes, self.sizes, self.slack
        while True:
            top, low, high, slack = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)
            self.levels.append((top, low, high, slack))
            if len(low) <= LEAF:
                break
            at = np.arange(0, len(low), LEAF)

    def _could(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        top, low, high, slack = self.levels[level]
        out = np.zeros(len(a), bool)
        for s in range(0, len(a), 4096):
            x, y = a[s : s + 4096], b[s : s + 4096]
            shared = np.minimum(top[x], top[y]).sum(axis=1, dtype=np.int64) + np.minimum(slack[x], slack[y])
            fits = (high[x] >= self.need.ratio * low[y]) & (high[y] >= self.need.ratio * low[x])
            out[s : s + 4096] = fits & (shared >= self.need.overlap(low[x], low[y]))
        return out

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions whose points could be similar, a leaf with a leaf at a time."""
        n = len(self.levels[-1][1])
        a, b = np.triu_indices(n)
        for level in range(len(self.levels) - 1, -1, -1):
            ok = self._could(level, a, b)
            a, b = a[ok], b[ok]
            if level:
                below = len(self.levels[level - 1][1])
                x, y = np.meshgrid(np.arange(LEAF), np.arange(LEAF), indexing="ij")
                a2, b2 = (a[:, None] * LEAF + x.ravel()).ravel(), (b[:, None] * LEAF + y.ravel()).ravel()
                ok = (a2 < below) & (b2 < below) & (a2 <= b2)
                a, b = a2[ok], b2[ok]
        top, low, _, slack = self.levels[0]
        at = np.arange(LEAF)
        for s in range(0, len(a), 512):
            # Points of one leaf against the box of the other, then against its points.
            i, b_ = (a[s : s + 512, None] * LEAF + at).ravel(), np.repeat(b[s : s + 512], LEAF)
            ok = i < len(self.sizes)
            i, b_ = i[ok], b_[ok]
            shared = np.minimum(self.points[i], top[b_]).sum(axis=1, dtype=np.int64) + np.minimum(self.slack[i], slack[b_])
            ok = shared >= self.need.overlap(self.sizes[i], low[b_])
            i, b_ = i[ok], b_[ok]
            j, i = (b_[:, None] * LEAF + at).ravel(), np.repeat(i, LEAF)
            ok = (j < len(self.sizes)) & (i < j)
            i, j = i[ok], j[ok]
            for t in range(0, len(i), 8192):
                x, y = i[t : t + 8192], j[t : t + 8192]
                shared = np.minimum(self.points[x], self.points[y]).sum(axis=1, dtype=np.int64) + np.minimum(self.slack[x], self.slack[y])
                ok = shared >= self.need.overlap(self.sizes[x], self.sizes[y])
                yield self.order[x[ok]], self.order[y[ok]]


class _Need:
    """What two texts of given sizes must share."""

    def __init__(self, similarity: float):
        self.ratio = similarity - 1e-9
        self.share = similarity / (1 + similarity)

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.ceil(self.share * (a + b) - 1e-9)


_ENTRIES = "sig_a bigint, sig_b bigint, block bigint, size bigint, place bigint, point binary"


def _through_tree(points: np.ndarray, size: np.ndarray, place: np.ndarray, need: _Need) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in a block that its tree, their sizes and places allow."""
    for a, b in PointTree(points, size, need).pairs():
        ok = np.minimum(size[a], size[b]) >= need.ratio * np.maximum(size[a], size[b])
        ok &= np.minimum(size[a] - place[a], size[b] - place[b]) >= need.overlap(size[a], size[b])
        yield a[ok], b[ok]


def _block_pairs(similarity: float, parts: int, node: int, cell: int):
    """(sig_a, sig_b) of the pairs in blocks of up to ``cell`` texts; the entries (sig_a, block, size, place, point) of larger ones."""
    need = _Need(similarity)

    def result(a, b, sig, block, size, place, points) -> pa.Table:
        n, m = len(a), len(sig)
        both = lambda x, y: pa.concat_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())])
        none, nothing = pa.nulls(n, pa.int64()), pa.nulls(m, pa.int64())
        packed = pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(_pack_points(points), pa.binary())])
        return pa.table({"sig_a": both(a, sig), "sig_b": both(b, nothing), "block": both(none, block), "size": both(none, size), "place": both(none, place), "point": packed})

    def blocks(doc, token, place, size, point):
        """Pairs of small blocks by size and place, pairs of larger ones that their tree lets through, and the entries of those that are too large."""
        n = len(size)
        # Of a text's shingles that fall together the first one counts.
        order = np.lexsort((place, doc, size[doc], token))
        doc, token, place = doc[order], token[order], place[order]
        kept = np.concatenate([[True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])])
        doc, token, place = doc[kept], token[kept], place[kept]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(starts, len(token)))
        found, passed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        last = np.repeat(starts + length, length)
        now = np.flatnonzero(np.repeat((length > 1) & (length <= node), length))
        step = 1
        while len(now):
            now = now[now + step < last[now]]
            # Sizes rise within a block: once the partner is too long, so are all after it.
            now = now[size[doc[now]] >= need.ratio * size[doc[now + step]]]
            a, b = doc[now], doc[now + step]
            ok = np.minimum(size[a] - place[now], size[b] - place[now + step]) >= need.overlap(size[a], size[b])
            if ok.any():
                found.append(np.unique(np.minimum(a, b)[ok] * n + np.maximum(a, b)[ok]))
            step += 1
        for low, m in zip(starts[middle := (length > node) & (length <= cell)], length[middle]):
            own = doc[low : low + m]
            for a, b in _through_tree(point(own), size[own], place[low : low + m], need):
                passed.append(np.minimum(own[a], own[b]) * n + np.maximum(own[a], own[b]))
        large = np.flatnonzero(np.repeat(length > max(node, cell), length))
        return np.unique(np.concatenate(found)), np.unique(np.concatenate(passed)), (doc[large], token[large], place[large])

    def run(table: pa.Table) -> pa.Table:
        tokens, docs, places, sigs, sizes, base = [], [], [], [], [], 0
        points = _PointRows(sum(table.column("n_docs").to_pylist()))
        for k in range(table.num_rows):
            r = {c: table.column(c)[k].as_py() for c in table.column_names}
            n, m = r["n_tokens"], r["n_docs"]
            short = _unpack(r["token"], n, np.uint64)
            tokens.append(short * np.uint64(parts) + np.uint64(r["part"]) if r["part"] < parts else short)
            docs.append(_unpack(r["local"], n, np.uint16).astype(np.int32) + np.int32(base))
            places.append(_unpack(r["place"], n, np.uint32))
            sigs.append(_unpack(r["sig"], m, np.int64))
            sizes.append(_unpack(r["size"], m, np.uint32))
            points.put(base, _unpack(r["points"], m * GROUPS, np.uint8).reshape(-1, GROUPS))
            base += m
        none = np.zeros(0, np.int64)
        sig, first, same = np.unique(np.concatenate(sigs), return_index=True, return_inverse=True)
        size, point = np.concatenate(sizes)[first].astype(np.int64), lambda own: points[first[own]]
        doc, token, place = same[np.concatenate(docs)], np.concatenate(tokens), np.concatenate(places).astype(np.int64)
        del tokens, docs, places, sigs, sizes, same
        if table.column("part")[0].as_py() >= parts:
            return result(none, none, sig[doc], token.astype(np.int64), size[doc], place, point(doc))
        n = len(sig)
        found, passed, rest = [none], [none], [(none, none.astype(np.uint64), none)]
        # All entries of a block are in one slice, so that only a slice at a time is sorted.
        slices = -(-len(token) // SLICE)
        of = (token // np.uint64(parts) % np.uint64(slices)).astype(np.int32)
        for one in range(slices):
            own = np.flatnonzero(of == one)
            if len(own):
                for to, x in zip((found, passed, rest), blocks(doc[own], token[own], place[own], size, point)):
                    to.append(x)
        code, fits = np.unique(np.concatenate(found)), [np.zeros(0, bool)]
        for s in range(0, len(code), 8192):
            a, b = code[s : s + 8192] // n, code[s : s + 8192] % n
            x, y = point(a), point(b)
            shared = np.minimum(x, y).sum(axis=1, dtype=np.int64) + np.minimum(size[a] - x.sum(axis=1, dtype=np.int64), size[b] - y.sum(axis=1, dtype=np.int64))
            fits.append(shared >= need.overlap(size[a], size[b]))
        code = np.unique(np.concatenate([code[np.concatenate(fits)], *passed]))
        doc, token, place = map(np.concatenate, zip(*rest))
        return result(*_ordered(sig[code // n], sig[code % n]), sig[doc], token.astype(np.int64), size[doc], place, point(doc))

    return run


def _ordered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(a, b), np.maximum(a, b)


def _tree_pairs(similarity: float):
    """Pairs of the cells of one group, each through its own tree.

    A cell of two parts of a block finds pairs between them only; those within a part are found where it meets itself.
    """
    need = _Need(similarity)

    def run(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_numpy() for c in ("block", "i", "j", "own", "sig", "size", "place")}
        points = _unpack_points(table.column("point").combine_chunks())
        order = np.lexsort((cols["j"], cols["i"], cols["block"]))
        block, i, j, own, sig, size, place = (cols[c][order] for c in ("block", "i", "j", "own", "sig", "size", "place"))
        points = points[order]
        starts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        out_a, out_b = [], []
        for low, high in zip(starts, [*starts[1:], len(block)]):
            s = slice(low, high)
            found = [np.zeros(0, np.int64)]
            for a, b in _through_tree(points[s], size[s], place[s], need):
                a, b = a + low, b + low
                if i[low] != j[low]:
                    ok = own[a] != own[b]
                    a, b = a[ok], b[ok]
                found.append(a * len(sig) + b)
            code = np.concatenate(found)
            a, b = _ordered(sig[code // len(sig)], sig[code % len(sig)])
            out_a.append(a)
            out_b.append(b)
        return pa.table({"sig_a": pa.array(np.concatenate(out_a)), "sig_b": pa.array(np.concatenate(out_b))})

    return run


def shingle_set(text: str, size: int = SHINGLE) -> frozenset:
    w = _WORDS(text.lower())
    return frozenset(zip(*(w[k:] for k in range(size))))


def _verified(size: int, similarity: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep, known = [], {}
            for a, b, x, y in zip(f["id_a"], f["id_b"], f["text_a"], f["text_b"]):
                for i, t in ((a, x), (b, y)):
                    if i not in known:
                        if len(known) > 4000:
                            known.clear()
                        known[i] = shingle_set(t, size)
                p = known[a] if a in known else shingle_set(x, size)
                q = known[b]
                both = len(p & q)
                keep.append((s := both / (len(p) + len(q) - both)) >= similarity and s)
            yield f[["id_a", "id_b"]].assign(similarity=keep)[[k is not False for k in keep]]

    return run


def class_pairs(
    items: DataFrame, id_column: str = "id", text_column: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, least_words: int = LEAST_WORDS, parts: int | None = None, hot: int = HOT, cell: int = CELL, node: int = NODE
) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): texts of equal shingles are one class, named by its smallest id.

    pairs: id_a < id_b and similarity of classes at least that similar; members: class_id, id.
    """
    spark = items.sparkSession
    texts = items.select(F.col(f"`{id_column}`").cast("string").alias("id"), F.col(f"`{text_column}`").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    first = materialize(texts.mapInArrow(_first_pass(shingle, least_words), _FIRST), "shingles")
    named = first.where("sig IS NOT NULL")
    classes = named.groupBy("sig").agg(F.min("id").alias("class_id"))
    members = named.select("sig", "id").distinct().join(classes, "sig").select("class_id", "id")
    partial = first.where("part IS NOT NULL").select("part", "counts").mapInArrow(_combine_sketches, "part int, counts binary")
    ranks = partial.repartition(SKETCH_PARTS // 8, "part").mapInArrow(_sum_sketch, "part int, ranks binary, total bigint").collect()  # 8 MB at most, whatever the data
    total = sum(r["total"] for r in ranks)
    # A text's point goes to each partition that has a shingle of it, so there are no more partitions than are needed.
    parts = parts or max(spark.sparkContext.defaultParallelism, math.ceil(total / PART_SHINGLES))
    bits = min(HASH_BITS, max(1, math.ceil(math.log2(total + 1)) + SPARE_BITS))
    width = (1 << SKETCH_BITS) // SKETCH_PARTS
    by_part = {r["part"]: _unpack(bytes(r["ranks"]), width, np.uint8).tobytes() for r in ranks}
    ranks_of = spark.sparkContext.broadcast(b"".join(by_part.get(p, bytes(width)) for p in range(SKETCH_PARTS)))  # 8 MB
    # What other shingles add to a counter does not make a shingle hot.
    blocks = texts.mapInArrow(_second_pass(ranks_of, parts, shingle, least_words, similarity, _rank(hot + 4 * total / (1 << SKETCH_BITS)), bits), _BLOCKS)
    entries = materialize(blocks.groupBy("part").applyInArrow(_block_pairs(similarity, parts, node, cell), _ENTRIES), "entries")
    found = entries.where("block IS NULL").select("sig_a", "sig_b").unionByName(_large_blocks(entries, similarity, cell)).distinct()
    likely = found.join(classes.toDF("sig_a", "class_a"), "sig_a").join(classes.toDF("sig_b", "class_b"), "sig_b").select(F.least("class_a", "class_b").alias("id_a"), F.greatest("class_a", "class_b").alias("id_b"))
    return _verify(texts, materialize(likely, "likely"), shingle, similarity), members


def _large_blocks(entries: DataFrame, similarity: float, cell: int) -> DataFrame:
    """Pairs of the blocks that are too large for one task; a block of n texts is cut into n / cell parts."""
    # A text comes once to a block from each task that met it.
    large = entries.where("block IS NOT NULL")
    groups = math.ceil(large.count() / TREE_ENTRIES)
    if not groups:
        return large.select("sig_a", "sig_b")
    large = large.groupBy("block", "sig_a").agg(F.min("place").alias("place"), F.any_value("size").alias("size"), F.any_value("point").alias("point"))
    sizes = large.groupBy("block").agg(F.ceil(F.count("*") / cell).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("sig_a"), F.col("n")).cast("int")
    placed = large.join(sizes, "block").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    some = placed.select("block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", F.col("sig_a").alias("sig"), "size", "place", "point")
    # Many blocks are small, so that a group takes several; a cell is never cut by it.
    group = F.when(F.col("i") == F.col("j"), F.pmod(F.xxhash64("block", "i"), F.lit(groups))).otherwise(F.xxhash64("block", "i", "j"))
    return some.groupBy(group.alias("group")).applyInArrow(_tree_pairs(similarity), "sig_a bigint, sig_b bigint")


def _bitmap(bits: int):
    """Rows (piece, bitmap) of the buckets of one partition; a piece is 2^17 buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for b in batches:
            x = b.column(0).to_numpy()
            for p in np.unique(x >> 17):
                pieces.setdefault(int(p), np.zeros(1 << min(bits, 17), bool))[x[x >> 17 == p] & ((1 << 17) - 1)] = True
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array([np.packbits(x).tobytes() for x in pieces.values()], pa.binary())], names=["piece", "bits"])

    return run


def _in_bitmap(bitmap_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(bitmap_of.value, np.uint8)
        for b in batches:
            x = b.column(2).to_numpy()
            yield b.filter(pa.array((bitmap[x >> 3] >> (7 - (x & 7)).astype(np.uint8) & 1).astype(bool))).select(["id", "text"])

    return run


def _verify(texts: DataFrame, likely: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Only texts of some pair go on: a bitmap of their ids' buckets, eight for each id up to 2^FILTER_BITS."""
    spark = texts.sparkSession
    bits = min(FILTER_BITS, max(17, math.ceil(math.log2(16 * likely.count() + 1))))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    wanted = likely.select(bucket("id_a").alias("bucket")).union(likely.select(bucket("id_b"))).distinct()
    pieces = wanted.repartition(F.shiftright("bucket", 17)).mapInArrow(_bitmap(bits), "piece int, bits binary").collect()  # 8 MB at most
    bitmap = np.zeros(max(1, 1 << (bits - 17)) * (1 << 14), np.uint8)
    for r in pieces:
        bitmap[r["piece"] << 14 : (r["piece"] + 1) << 14] |= np.frombuffer(r["bits"], np.uint8)
    bitmap_of = spark.sparkContext.broadcast(bitmap.tobytes())
    some = texts.select("id", "text", bucket("id").alias("bucket")).mapInArrow(_in_bitmap(bitmap_of), "id string, text string").dropDuplicates(["id"])
    left, right = some.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), some.select(F.col("id").alias("id_b"), F.col("text").alias("text_b"))
    return likely.join(left, "id_a").join(right, "id_b").mapInPandas(_verified(shingle, similarity), "id_a string, id_b string, similarity double")


def similar_pairs(
    items: DataFrame, id_column: str = "id", text_column: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, least_words: int = LEAST_WORDS, parts: int | None = None, **limits
) -> DataFrame:
    """id_a < id_b and similarity of all pairs of items with at least that Jaccard similarity, copies written out.

    Members of large classes are paired part by part, so no key gathers a class.
    """
    pairs, members = class_pairs(items, id_column, text_column, similarity, shingle, least_words, parts, **limits)
    pairs, members = materialize(pairs, "pairs"), materialize(members, "members")
    # Most classes have one member and no pair; they go no further.
    paired = pairs.select("id_a").union(pairs.select("id_b")).toDF("class_id").distinct().withColumn("paired", F.lit(True))
    counts = members.groupBy("class_id").agg(F.count("*").alias("n"), F.ceil(F.count("*") / CLASS_PART).cast("int").alias("parts"))
    counts = materialize(counts.join(paired, "class_id", "left").where("n > 1 OR paired").drop("paired"), "counts")
    placed = materialize(members.join(counts, "class_id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), "placed")
    cut = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    side = lambda x, y: placed.select(F.col("class_id").alias(f"class_{x}"), F.col("own").alias(f"own_{x}"), F.col("id").alias(y))
    parted = lambda x: counts.select(F.col("class_id").alias(f"class_{x}"), F.col("parts").alias(f"parts_{x}"))
    between = pairs.toDF("class_a", "class_b", "similarity").join(parted("a"), "class_a").join(parted("b"), "class_b")
    between = between.withColumn("own_a", cut("parts_a")).withColumn("own_b", cut("parts_b")).join(side("a", "x"), ["class_a", "own_a"]).join(side("b", "y"), ["class_b", "own_b"]).select("x", "y", "similarity")
    twins = placed.where("n > 1").withColumn("other", cut("parts"))
    low, high = twins.where("own <= other").select("class_id", F.col("own").alias("i"), F.col("other").alias("j"), F.col("id").alias("x")), twins.where("own >= other").select("class_id", F.col("other").alias("i"), F.col("own").alias("j"), F.col("id").alias("y"))
    within = low.join(high, ["class_id", "i", "j"]).where("i < j OR x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    return between.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """id, class_id, group_id, n_links of every item that is similar to another one.

    ``pairs`` and ``members`` are those of class_pairs, so copies are counted and not written out as pairs.  A group is
    a connected component, named by its smallest class; n_links counts similar items, copies too.
    """
    sizes = materialize(members.groupBy("class_id").agg(F.count("*").alias("n")), "sizes")
    links = materialize(pairs.select("id_a", "id_b").union(pairs.select("id_b", "id_a")).toDF("id", "other").distinct(), "links")
    degree = links.join(sizes.toDF("other", "n"), "other").groupBy("id").agg(F.sum("n").alias("linked"))
    label = materialize(links.groupBy("id").agg(F.least("id", F.min("other")).alias("group_id")), "label")
    while True:
        near = links.join(label.toDF("other", "g"), "other").groupBy("id").agg(F.min("g").alias("g"))
        # Follow the label of the label as well, so that long chains halve with each round.
        jump = label.toDF("group_id", "g2")
        new = materialize(label.join(near, "id").join(jump, "group_id", "left").select("id", F.least("group_id", "g", "g2").alias("new_id"), "group_id"), "label")
        done = new.where("new_id <> group_id").isEmpty()
        label = new.select("id", F.col("new_id").alias("group_id"))
        if done:
            break
    whole = sizes.join(label.withColumnRenamed("id", "class_id"), "class_id", "left").join(degree.withColumnRenamed("id", "class_id"), "class_id", "left")
    whole = whole.where("n > 1 OR group_id IS NOT NULL").select("class_id", F.coalesce("group_id", "class_id").alias("group_id"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return members.join(whole, "class_id").select("id", "class_id", "group_id", "n_links")
