"""BM25 ranking of many queries over texts, without a row for each pair of a query and a text.

Most queries share a word with most texts, so their pairs grow with the square
of the input.  Here texts become blocks of up to ``DOC_BLOCK``, each with its own vocabulary
and, for each term, the texts that have it; every block meets every block of
queries, a task keeps the best n of each query, and only those are shuffled.
A text is scored for a query only where its terms could still bring it among the task's best n
(terms that could not do so together open no texts), which leaves nothing out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import tokens
from lexmill.operators.lexical import DIGITS, EPSILON, K1, B, query_terms, rank, weigh_terms
from lexmill.session import materialize

#: Texts of a block; their numbers within it fit 16 bits.
DOC_BLOCK = 8192
#: Words of queries that are compared with a block of texts at once.
QUERY_TERMS = 20_000
#: Tasks of the comparison for each core: each sends n rows a query.
TASKS = 2


def text_blocks(chunks: DataFrame, id_column: str = "id", text: str = "text") -> DataFrame:
    """ids, lengths of the texts of a block and their number of words; terms, counts: its terms and how many of its texts have each; docs, tfs: these texts, term after term, and how often they have it."""
    id_type = chunks.schema[id_column].dataType.simpleString()
    found = chunks.select(F.col(id_column).alias("id"), tokens(text).alias("words"))
    return found.mapInArrow(_pack_texts, f"ids array<{id_type}>, lengths binary, n_words bigint, terms array<string>, counts array<int>, docs binary, tfs binary")


def _one(x: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, DOC_BLOCK):
            b = whole.slice(at, DOC_BLOCK)
            lengths = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            words = b.column(1).flatten().dictionary_encode()
            key, tf = np.unique(words.indices.to_numpy().astype(np.int64) * DOC_BLOCK + np.repeat(np.arange(b.num_rows), lengths), return_counts=True)
            counts = np.bincount(key // DOC_BLOCK, minlength=len(words.dictionary)).astype(np.int32)
            ids = b.column(0)
            columns = [_one(ids), pa.array([lengths.astype(np.int32).tobytes()], pa.binary()), pa.array([int(lengths.sum())]), _one(words.dictionary), _one(pa.array(counts))]
            columns += [pa.array([(key % DOC_BLOCK).astype(np.uint16).tobytes()], pa.binary()), pa.array([tf.astype(np.int32).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "lengths", "n_words", "terms", "counts", "docs", "tfs"])


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted terms of the queries of a partition, in the order of the queries, as one block."""
    parts = [b for b in batches if b.num_rows]
    if parts:
        t = pa.Table.from_batches(parts).combine_chunks()
        words = t.column("term").combine_chunks().dictionary_encode()
        queries = t.column("query_id").combine_chunks()
        own = queries.dictionary_encode(null_encoding="encode").indices.to_numpy()
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        columns = [_one(queries.take(pa.array(first))), pa.array([first.astype(np.int64).tobytes()], pa.binary()), _one(words.dictionary)]
        columns += [pa.array([words.indices.to_numpy().astype(np.int32).tobytes()], pa.binary()), pa.array([t.column("weight").to_numpy().astype(np.float64).tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["query_ids", "starts", "asked", "codes", "weights"])


class _Columns:
    """The terms of one block of texts that are asked for: the texts that have them and what they add to a score for weight 1."""

    def __init__(self, row: dict, asked: list[str], avgdl: float, k1: float, b: float):
        self.n = len(row["ids"])
        counts, docs, tf = np.array(row["counts"], np.int64), np.frombuffer(row["docs"], np.uint16), np.frombuffer(row["tfs"], np.int32)
        ends = np.cumsum(counts)
        size = k1 * (1 - b + b * np.frombuffer(row["lengths"], np.int32) / avgdl)
        place = {t: k for k, t in enumerate(row["terms"])}
        self.most, self.lists = np.zeros(len(asked)), {}
        for k, t in enumerate(asked):
            if (at := place.get(t)) is not None:
                s = slice(ends[at] - counts[at], ends[at])
                own = docs[s].astype(np.int64)
                value = tf[s] * (k1 + 1) / (tf[s] + size[own])
                self.lists[k] = own, value
                self.most[k] = value.max()
        self.dense: dict[int, np.ndarray] = {}

    def at(self, term: int, docs: np.ndarray) -> np.ndarray:
        own, value = self.lists[term]
        if len(own) * 16 >= self.n:
            if term not in self.dense:
                self.dense[term] = np.zeros(self.n)
                self.dense[term][own] = value
            return self.dense[term][docs]
        place = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        return np.where(own[place] == docs, value[place], 0.0)


class _Best:
    """The best n texts of each query of one block so far."""

    def __init__(self, row: dict, n: int):
        self.n, self.query_ids, self.asked = n, row["query_ids"], row["asked"]
        self.codes, self.weights = np.frombuffer(row["codes"], np.int32), np.frombuffer(row["weights"])
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.ends = np.append(self.starts[1:], len(self.codes))
        # What rounds to nothing is no match.
        self.least = np.full(len(self.starts), 0.5 * 10.0**-DIGITS)
        self.scores: list[np.ndarray | None] = [None] * len(self.starts)
        self.ids: list[np.ndarray | None] = [None] * len(self.starts)

    def meet(self, ids: np.ndarray, columns: _Columns) -> None:
        slack = 10.0**-DIGITS
        could = np.maximum(self.weights, 0) * columns.most[self.codes]
        for q in np.flatnonzero(np.add.reduceat(could, self.starts) >= self.least - slack).tolist():
            s = slice(self.starts[q], self.ends[q])
            order = np.argsort(could[s], kind="stable")
            terms, weights, bounds = self.codes[s][order].tolist(), self.weights[s][order].tolist(), np.cumsum(could[s][order])
            # The terms before this one could not do it without one of those from it on.
            low = int(np.searchsorted(bounds, self.least[q] - slack))
            opened = [columns.lists[t][0] for t in terms[low:] if t in columns.lists]
            if not opened:
                continue
            docs = opened[0] if len(opened) == 1 else np.unique(np.concatenate(opened))
            score = np.zeros(len(docs))
            for t, w in sorted(zip(terms, weights)):
                if t in columns.lists:
                    score += w * columns.at(t, docs)
            score = np.round(score, DIGITS)
            kept = np.flatnonzero(score >= max(self.least[q], 10.0**-DIGITS / 2))
            if len(kept):
                self._keep(q, score[kept], ids[docs[kept]])

    def _keep(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        if self.scores[q] is not None:
            score, ids = np.concatenate([self.scores[q], score]), np.concatenate([self.ids[q], ids])
        if len(score) > self.n:
            if len(score) > 8 * self.n:  # only those at the n-th score or above need an order
                some = score >= np.partition(score, len(score) - self.n)[len(score) - self.n]
                score, ids = score[some], ids[some]
            given = np.array([x is not None for x in ids])
            names = np.array([x if x is not None else type(ids[given][0])() if given.any() else 0 for x in ids])
            best = np.lexsort((names, given, -score))[: self.n]
            score, ids = score[best], ids[best]
        self.scores[q], self.ids[q] = score, ids
        if len(score) == self.n:
            self.least[q] = score.min()

    def rows(self) -> Iterator[pd.DataFrame]:
        found = [k for k, x in enumerate(self.scores) if x is not None]
        for at in range(0, len(found), 1000):
            some = found[at : at + 1000]
            sizes = [len(self.scores[k]) for k in some]
            yield pd.DataFrame({"query_id": np.repeat(np.asarray(self.query_ids)[some], sizes), "id": np.concatenate([self.ids[k] for k in some]), "score": np.concatenate([self.scores[k] for k in some])})


def _compare(n: int, k1: float, b: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[bytes, _Best] = {}
        for f in frames:
            for row in f.to_dict("records"):
                # A block of queries is known by its queries, which no other has.
                key = repr(row["query_ids"][0])
                if key not in best:
                    best[key] = _Best(row, n)
                own = best[key]
                ids = np.array([*row["ids"], None], object)[:-1]
                if len(ids) and len(row["docs"]):
                    own.meet(ids, _Columns(row, own.asked, row["avgdl"], k1, b))
        for own in best.values():
            yield from own.rows()

    return run


def bm25_many(chunks: DataFrame, queries: DataFrame, n: int = 20, id_column: str = "id", text: str = "text", epsilon: float = EPSILON, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, id, score, rank as bm25_search gives them, for any number of (query_id, query)."""
    spark = chunks.sparkSession
    id_type, query_type = chunks.schema[id_column].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    blocks = materialize(text_blocks(chunks, id_column, text), "blocks")
    counted = blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("df"))
    size = blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n_docs"), (F.sum("n_words") / F.sum(F.size("ids"))).alias("avgdl"))
    terms, _ = weigh_terms(counted, size, epsilon)
    weights = query_terms(queries).join(terms.select("term", "idf"), "term").select("query_id", "term", (F.col("idf") * F.col("qtf")).alias("weight"))
    weights = materialize(weights, "weights")
    parts = max(1, math.ceil(weights.count() / QUERY_TERMS))
    asked = weights.repartition(parts, "query_id").sortWithinPartitions("query_id").mapInArrow(_pack_queries, f"query_ids array<{query_type}>, starts binary, asked array<string>, codes binary, weights binary")
    asked = materialize(asked, "asked")
    pairs = blocks.coalesce(TASKS * spark.sparkContext.defaultParallelism).crossJoin(F.broadcast(size.select("avgdl"))).crossJoin(asked)  # one row; the blocks of queries
    return rank(pairs.mapInPandas(_compare(n, k1, b), f"query_id {query_type}, id {id_type}, score double"), n)
