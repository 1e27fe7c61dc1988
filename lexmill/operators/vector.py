"""Vector ranking: exact cosine in blocks, and an embedder that needs no model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.lexical import DIGITS, rank
from lexmill.session import materialize

#: Queries compared at once; with the vectors of a batch it bounds a task's memory.
QUERY_BLOCK = 512
#: Rows of a block.
ROW_BLOCK = 4096
QUERY_PARTITIONS = 8
DIMENSIONS = 64


def cosine_topk(vectors: DataFrame, queries: DataFrame, n: int = 20, id_column: str = "id", vector: str = "embedding") -> DataFrame:
    """query_id, id, score, rank: the ``n`` vectors of highest cosine for each query.

    Queries (query_id, embedding) are packed into blocks; every partition of
    vectors meets every block once and keeps its best ``n`` for each query, so
    what is shuffled is n rows for each query and partition.  Null vectors,
    vectors of another length and zero vectors never match.
    """
    id_type, query_type = vectors.schema[id_column].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    q = queries.select("query_id", F.col(vector).alias("qv")).where("qv IS NOT NULL")
    # Packed once into a table of known size: Spark broadcasts it only below its threshold and
    # otherwise pairs partitions, of which the queries have few.
    packed = materialize(q.repartition(QUERY_PARTITIONS).mapInArrow(_packer("block_ids", "block_vectors", QUERY_BLOCK), f"block_ids array<{query_type}>, block_vectors binary, width int"), "queries")
    corpus = vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).where("v IS NOT NULL").mapInArrow(_packer("ids", "rows", ROW_BLOCK), f"ids array<{id_type}>, rows binary, width int")
    # Blocks against blocks: the stated queries against all rows.
    pairs = corpus.withColumnRenamed("width", "w").crossJoin(packed)
    return rank(pairs.mapInPandas(_best(n), f"query_id {query_type}, id {id_type}, score double"), n)


def _pack_with(frames: Iterator[pd.DataFrame], key: str, value: str, names: list[str], size: int) -> Iterator[pd.DataFrame]:
    for f in frames:
        for width, g in f.groupby(f[value].map(len)):
            for s in range(0, len(g), size):
                part = g.iloc[s : s + size]
                m = np.array(part[value].tolist(), np.float64)
                ok = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
                yield pd.DataFrame({names[0]: [part[key].to_numpy()[ok]], names[1]: [m[ok].tobytes()], "width": [int(width)]}).astype({"width": "int32"})


def _packer(ids: str, rows: str, size: int):
    """Rows (key, vector) as blocks of up to ``size`` of one length; vectors with nulls, infinite or only zero numbers are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            for width in np.unique(lengths[lengths > 0]):
                of = b.filter(pa.array(lengths == width))
                m = of.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
                ok = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
                m, keys = m[ok], of.column(0).filter(pa.array(ok))
                for s in range(0, len(m), size):
                    part = keys.slice(s, size)
                    yield pa.RecordBatch.from_arrays(
                        [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), pa.array([m[s : s + size].tobytes()], pa.binary()), pa.array([width], pa.int32())], names=[ids, rows, "width"]
                    )

    return run


def _best(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for ids, rows, w, qids, qrows, width in zip(f["ids"], f["rows"], f["w"], f["block_ids"], f["block_vectors"], f["width"]):
                if w != width or not len(rows) or not len(qrows):
                    continue
                a, q = np.frombuffer(rows).reshape(-1, width), np.frombuffer(qrows).reshape(-1, width)
                size = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((a * a).sum(axis=1))
                score = np.round(q @ a.T / size, DIGITS) + 0.0
                ids = np.asarray(ids)
                by_id = np.argsort(np.argsort(ids.astype(str) if ids.dtype == object else ids, kind="stable"), kind="stable")
                k = min(n, len(ids))
                # Best k of each query; ties by id.
                order = np.lexsort((np.broadcast_to(by_id, score.shape), -score), axis=1)[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(np.asarray(qids), k), "id": ids[order].ravel(), "score": np.take_along_axis(score, order, axis=1).ravel()})

    return run


def hash_features(posting: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """id, category, bucket, w: signed hashed term counts, the sparse form of a model-free embedding."""
    digest = F.md5("term")
    bucket = F.pmod(F.conv(F.substring(digest, 1, 6), 16, 10).cast("bigint"), F.lit(dimensions)).cast("int")
    sign = F.when(F.substring(digest, 7, 1) < F.lit("8"), 1).otherwise(-1)
    return posting.groupBy("id", "category", bucket.alias("bucket")).agg(F.sum(sign * F.col("tf")).alias("w")).where("w <> 0")


def dense(features: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """id, category, embedding: the features of each id as one vector; at most ``dimensions`` of them are gathered."""
    cells = F.map_from_entries(F.collect_list(F.struct("bucket", F.col("w").cast("double").alias("w"))))
    made = features.groupBy("id", "category").agg(cells.alias("cells"))
    return made.select("id", "category", F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.coalesce(F.try_element_at("cells", k), F.lit(0.0))).alias("embedding"))


def hashed_cosine(vectors: DataFrame, query_vectors: DataFrame, n: int = 20) -> DataFrame:
    """Ranking by cosine of hashed features as dense vectors; only pairs with a positive cosine are ranked."""
    return cosine_topk(vectors, query_vectors.select(F.col("id").alias("query_id"), "embedding"), n).where("score > 0")
