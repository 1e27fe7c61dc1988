"""Byte-pair encoding of whole corpora by prefix dynamic programming.

Every byte prefix of a piece of text has exactly one valid last token: the
token t that ends there and that byte-pair merging would keep next to the last
token of the prefix before t.  Storing that token per prefix gives the encoding
by walking back from the end, makes appending exact (old prefixes never
change) and limits re-encoding after an edit to the bytes from the edit on.

Null and empty texts encode to an empty list.
"""

from __future__ import annotations

import base64
import importlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "byte_bpe_50k"
#: Pieces kept with their ids in each worker; the memory bound of the cache.
CACHE_PIECES = 400_000
#: Pairs of tokens of which a worker knows whether they may stand side by side.
CACHE_PAIRS = 1_000_000
#: Longer pieces are rare and not worth keeping.
CACHE_CHARS = 64


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Place of ``name``.tiktoken in the installed tokenizer files; a path stays as it is."""
    if "/" in name:
        return name
    return importlib.import_module("public_tokenizers").path(f"{name}.tiktoken")


def split_pattern() -> str:
    return importlib.import_module("public_tokenizers").PATTERN


class PrefixEncoder:
    """Encoder of single pieces; ``ranks`` maps token bytes to id, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        # Every ending of a token, to know when no longer token can end here.
        self.endings = {b[k:] for b in ranks for k in range(len(b))}
        self.longest = max(map(len, ranks), default=0)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.own: dict[int, bool] = {}

    @classmethod
    def from_file(cls, path: str) -> PrefixEncoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _merge(self, piece: bytes) -> list[int]:
        """Plain merging, used only to learn whether two tokens may stand side by side."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(
                ((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None),
                default=None,
            )
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _stands(self, token: int) -> bool:
        if (known := self.own.get(token)) is None:
            known = self.own[token] = self._merge(self.tokens[token]) == [token]
        return known

    def _fits(self, left: int, right: int) -> bool:
        key = (left, right)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def extend(self, last: list[int], piece: bytes, start: int) -> list[int]:
        """Append to ``last`` the last token of each prefix of ``piece`` longer than ``start`` bytes."""
        ranks, endings = self.ranks, self.endings
        for end in range(start + 1, len(piece) + 1):
            found, begin = -1, end - 1
            while begin >= 0 and (part := piece[begin:end]) in endings:
                token = ranks.get(part)
                if token is not None and (self._fits(last[begin - 1], token) if begin else self._stands(token)):
                    found = token
                    break
                begin -= 1
            if found < 0:
                raise ValueError("vocabulary without all single bytes")
            last.append(found)
        return last

    def read_back(self, last: list[int]) -> list[int]:
        out, at = [], len(last)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(self.tokens[token])
        out.reverse()
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None and self._stands(whole):
            return [whole]
        return self.read_back(self.extend([], piece, 0))

    def append(self, last: list[int], piece: bytes, more: bytes) -> list[int]:
        """Last tokens of ``piece + more`` from those of ``piece``; the old ones hold."""
        return self.extend(list(last), piece + more, len(piece))

    def edit(self, last: list[int], piece: bytes, at: int, gone: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace ``gone`` bytes at ``at`` by ``new``.

        Prefixes up to ``at`` keep their last tokens.  Behind the edit prefixes are computed again until as many in a
        row as the longest token has bytes come out as before: what follows depends on those alone.
        """
        changed, shift = piece[:at] + new + piece[at + gone :], len(new) - gone
        out, same = self.extend(last[:at], changed[: at + len(new)], at), 0
        for end in range(at + len(new), len(changed)):
            if same >= self.longest:
                return changed, out + last[end - shift :]
            self.extend(out, changed[: end + 1], end)
            same = same + 1 if out[end] == last[end - shift] else 0
        return changed, out


class _Packed(dict):
    """Piece -> its ids as packed 32-bit integers; emptied when full, so its memory is bounded."""

    def __init__(self, pieces: PrefixEncoder):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, piece: str) -> bytes:
        # Parquet holds no lone surrogates; replace keeps other callers alive.
        ids = array("i", self.pieces.encode_piece(piece.encode("utf-8", "replace"))).tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class TextEncoder:
    """Whole texts: split by the vocabulary's pattern, pieces by prefix programming, with a bounded cache."""

    def __init__(self, path: str):
        import regex

        self.packed = _Packed(PrefixEncoder.from_file(path))
        self.pattern = regex.compile(split_pattern())
        self.split = self.pattern.findall

    def encode_packed(self, text: str | None) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.split(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return list(memoryview(self.encode_packed(text)).cast("i"))

    def count(self, text: str | None) -> int:
        return len(self.encode_packed(text)) // 4


    def decode(self, ids: list[int] | np.ndarray) -> str:
        tokens = self.packed.pieces.tokens
        return b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace")

    def replace(self, text: str, ids: list[int], at: int, gone: int, new: str) -> tuple[str, list[int]]:
        """The text with ``gone`` characters at ``at`` replaced by ``new``, and its ids; pieces that did not change keep theirs.

        Pieces in front of the one before the edit stay.  Behind it they are split again until a piece starts where
        an old one did; as the split looks one piece ahead at most, what follows is as before.
        """
        changed, shift = text[:at] + new + text[at + gone :], len(new) - gone
        starts = [0]
        for piece in self.split(text):
            starts.append(starts[-1] + len(piece))
        sizes = {s: len(self.packed[text[s:e]]) // 4 for s, e in zip(starts, starts[1:])}
        first = max(0, bisect_right(starts, at) - 3)
        begin = starts[first]
        offset = dict(zip(starts, accumulate([0, *(sizes[s] for s in starts[:-1])])))
        out, place, known = list(ids[: offset[begin]]), begin, set(starts)
        met = 0
        for piece in self.pattern.finditer(changed, begin):
            if place >= at + len(new) and place - shift in known:
                met += 1
                if met > 2:
                    return changed, out + list(ids[offset[place - shift] :])
            else:
                met = 0
            out += memoryview(self.packed[piece[0]]).cast("i").tolist()
            place = piece.end()
        return changed, out


@lru_cache(maxsize=4)
def text_encoder(path: str) -> TextEncoder:
    """One encoder per worker process and vocabulary."""
    return TextEncoder(path)


def _encode_batches(column: str, out: str, path: str, lengths_only: bool, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = text_encoder(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            if lengths_only:
                made = pa.array([enc.count(t.as_py()) for t in texts], pa.int64())
            else:
                packed = [enc.encode_packed(t.as_py()) for t in texts]
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([*kept, made], names=[*keep, out])

    return run


def encode_column(df: DataFrame, column: str = "text", out: str = "ids", keep: list[str] | None = None, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keep`` columns plus ``out`` array<int>, the ids of ``column``; no special tokens, null and empty give []."""
    return _run(df, column, out, keep, vocabulary, False)


def count_tokens(df: DataFrame, column: str = "text", out: str = "n_tokens", keep: list[str] | None = None, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keep`` columns plus ``out`` bigint, the number of ids of ``column``; null and empty count 0."""
    return _run(df, column, out, keep, vocabulary, True)


def _run(df: DataFrame, column: str, out: str, keep: list[str] | None, vocabulary: str, lengths_only: bool) -> DataFrame:
    keep = [c for c in df.columns if c not in (column, out)] if keep is None else keep
    inner = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, column])])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (inner.schema[c] for c in keep))
    made = "bigint" if lengths_only else "array<int>"
    return inner.mapInArrow(_encode_batches(column, out, vocabulary_path(vocabulary), lengths_only, keep), f"{kinds}{', ' if kinds else ''}`{out}` {made}")


def decode_column(df: DataFrame, column: str = "ids", out: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with the text of ``column`` as ``out`` instead of it; null and empty lists give an empty text."""
    path, rest = vocabulary_path(vocabulary), [c for c in df.columns if c not in (column, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = text_encoder(path)
        for b in batches:
            texts = [enc.decode(x.as_py() or ()) for x in b.column(b.schema.get_field_index(column))]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(texts, pa.string())], names=[*rest, out])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in rest)
    return df.mapInArrow(run, f"{kinds}`{out}` string")


def check_edits(df: DataFrame, id_column: str = "doc_id", column: str = "text", new: str = " (see note)", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_column`` and ``equal``: whether the ids of a text with ``new`` for its middle character are those of encoding it anew; null counts as empty."""
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = text_encoder(path)
        for b in batches:
            made = []
            for x in b.column(1):
                text = x.as_py() or ""
                changed, ids = enc.replace(text, enc.encode(text), len(text) // 2, min(1, len(text)), new)
                made.append(ids == enc.encode(changed))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.bool_())], names=[id_column, "equal"])

    return df.select(id_column, column).mapInArrow(run, f"`{id_column}` {df.schema[id_column].dataType.simpleString()}, equal boolean")
