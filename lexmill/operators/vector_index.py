"""An inverted file of vectors: rows lie in the cell of their nearest centre, a search opens the nearest cells.

Centres are fitted on a bounded sample; every row is put into its cell.  The
index trades recall for reading little: with all cells open it gives what
``vector.cosine_topk`` gives, which stays the exact way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.lexical import rank
from lexmill.operators.vector import _best, _pack_with, cosine_topk

#: Most rows the centres are fitted on.
SAMPLE = 20_000
#: Most centres; what the driver holds and sends out grows with them alone.
MOST_CELLS = 4096
ROUNDS = 12
#: Rows of one cell that are multiplied at once.
BLOCK = 4096
#: Queries of one cell that are multiplied at once.
QUERY_BLOCK = 512


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def fit_centres(vectors: DataFrame, cells: int | None = None, vector: str = "embedding", sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Unit centres by spherical k-means on at most ``sample`` rows, chosen by a hash of the vector; by default about the root of the row count."""
    some = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v"))
    n = some.count()
    if not n:
        return np.zeros((0, 0))
    grain = 1 << 40
    rows = some.where(F.pmod(F.xxhash64("v"), F.lit(grain)) < math.ceil(grain * min(1.0, sample / n))).limit(2 * sample).collect()  # about `sample` rows
    width = max((len(r["v"]) for r in rows), default=0)
    x = _unit(np.array(sorted(r["v"] for r in rows if len(r["v"]) == width), np.float64).reshape(-1, max(1, width)))
    k = max(1, min(cells or round(math.sqrt(n)), MOST_CELLS, len(x)))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.bincount(own, minlength=k) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centres = _unit(sums)
    return centres


def assign(vectors: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """``vectors`` with ``cell``, that of the nearest centre; null vectors and those of another length have none (-1)."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # MOST_CELLS rows at most
    own = [c for c in vectors.columns if c != "cell"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for f in frames:
            cell = np.full(len(f), -1, np.int32)
            fits = np.array([v is not None and len(v) == c.shape[1] for v in f[vector]], bool)
            if fits.any():
                cell[fits] = np.argmax(np.array(f[vector][fits].tolist(), np.float64) @ c.T, axis=1)
            yield f.assign(cell=cell)

    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in own)
    return vectors.select(*own).mapInPandas(run, f"{kinds}, cell int")


def packed(assigned: DataFrame, id_column: str = "id", vector: str = "embedding") -> DataFrame:
    """cell, ids, rows, width: the rows of each cell in blocks of up to BLOCK, in the order of the cells; this is what is stored.

    A cell's rows are spread by a hash of their id, so that no cell is one task.
    """
    id_type = assigned.schema[id_column].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for cell, g in f.groupby("cell"):
                for block in _pack_with(iter([g]), "id", "v", ["ids", "rows"], BLOCK):
                    yield block.assign(cell=int(cell)).astype({"cell": "int32"})

    rows = assigned.where("cell >= 0").select("cell", F.col(id_column).alias("id"), F.col(vector).alias("v"))
    spread = rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("cell")
    return spread.mapInPandas(run, f"ids array<{id_type}>, rows binary, width int, cell int")


def probes_for(assigned: DataFrame, centres: np.ndarray, n: int = 20, target: float = 0.95, asked: int = 200, id_column: str = "id", vector: str = "embedding") -> int:
    """How many cells a search must open to find ``target`` of the true best ``n``, measured on about ``asked`` rows as queries against all rows."""
    rows = assigned.where("cell >= 0").select(F.col(id_column).alias("id"), F.col(vector).alias("embedding"), "cell")
    total, grain = rows.count(), 1 << 40
    if not total or not len(centres):
        return 1
    q = rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(grain)) < math.ceil(grain * min(1.0, asked / total))).limit(2 * asked).select(F.col("id").alias("query_id"), "embedding")
    exact = cosine_topk(rows.select("id", "embedding"), q, n)
    found = exact.join(rows.select("id", "cell"), "id").join(q, "query_id").select("cell", "embedding").collect()  # 2 * asked * n rows at most
    order = np.argsort(-(np.array([r["embedding"] for r in found], np.float64) @ centres.T), axis=1, kind="stable")
    places = np.argmax(order == np.array([r["cell"] for r in found])[:, None], axis=1)
    return int(np.quantile(places, target, method="higher")) + 1


def search(index: DataFrame, centres: np.ndarray, queries: DataFrame, n: int = 20, probes: int = 8, vector: str = "embedding") -> DataFrame:
    """query_id, id, score, rank of the best ``n`` rows in the ``probes`` cells nearest to each query (query_id, embedding)."""
    shared = queries.sparkSession.sparkContext.broadcast(centres)
    query_type, id_type = queries.schema["query_id"].dataType.simpleString(), index.schema["ids"].dataType.elementType.simpleString()
    k = min(probes, len(centres))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for f in frames:
            f = f[[v is not None and len(v) == c.shape[1] for v in f["v"]]] if len(c) else f[:0]
            if not len(f):
                continue
            near = np.argsort(-(np.array(f["v"].tolist(), np.float64) @ c.T), axis=1, kind="stable")[:, :k]
            yield pd.DataFrame({"cell": near.ravel().astype(np.int32), "query_id": np.repeat(f["query_id"].to_numpy(), k), "qv": [v for v in f["v"] for _ in range(k)]})

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for cell, g in f.groupby("cell"):
                for block in _pack_with(iter([g]), "query_id", "qv", ["block_ids", "block_vectors"], QUERY_BLOCK):
                    yield block.assign(cell=int(cell)).astype({"cell": "int32"})

    routed = queries.select("query_id", F.col(vector).alias("v")).mapInPandas(route, f"cell int, query_id {query_type}, qv array<double>")
    asked = routed.repartition("cell").sortWithinPartitions("cell").mapInPandas(blocks, f"block_ids array<{query_type}>, block_vectors binary, width int, cell int")
    pairs = index.withColumnRenamed("width", "w").join(asked, "cell")
    return rank(pairs.mapInPandas(_best(n), f"query_id {query_type}, id {id_type}, score double"), n)
