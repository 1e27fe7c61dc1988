"""Mixing sources to target shares of tokens.

Each source gets a quota of tokens.  Whole passes over a source and a random
part of one more pass meet the quota; in each pass every document is dealt
anew into one of the source's blocks.  A splitting tree hands the blocks to
output shards: at each node the blocks of every source are divided between the
halves by a multivariate hypergeometric draw, so that each shard is a random
sample of the mixture and the totals stay exact.  A shard's blocks are taken
from a permutation of the source's blocks, and its documents are shuffled by
hash.

Blocks are made so small that a shard gets ``SHARD_BLOCKS`` of each source on
average, whatever the size of the corpus.  The driver holds tables of one row a
target, sums of ``CELLS`` cells a target and the upper ``TOP`` leaves of the
tree; the rest of the tree and all blocks are worked out in tasks.

Sources are compared without regard to case and surrounding blanks.  Documents
of sources without target, of null source or without tokens are not drawn; a
doc_id delivered again counts once, by its longest row.  A source that cannot
fill its share even at ``max_repeats`` passes gives all it may, and the others
keep their shares among themselves; the report says so.  Targets listed twice
are added up; a null or negative share counts as 0, a null or negative
max_repeats as 0.  With no documents or targets the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.llm import bpe
from lexmill.session import materialize

SEED = 20
#: Tokens of an output shard.
SHARD_TOKENS = 4_000_000
#: Blocks of each source in a shard on average.
SHARD_BLOCKS = 32
#: Most tokens of the part of a pass that is filled document by document, in one task a source.
FILL_TOKENS = 400_000
#: Places of a pass; a document's place is a hash of it and of the pass.
PLACE_BITS = 40
#: Cells into which the places are cut at a time to find where a quota ends; a power of 2.
CELLS = 1024
#: Leaves of the part of the tree that is drawn on the driver.
TOP = 1024
#: Blocks that one draw can handle; beyond it they move in bundles.
MOST_DRAWN = 500_000_000


def source_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def quotas(available: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: int | None = None) -> dict[str, int]:
    """Tokens to draw from each source.

    ``total`` is by default what the sources with a target hold; what a source
    cannot give is spread over the others in proportion to their shares.
    """
    cap = {s: available.get(s, 0) * repeats[s] for s in shares}
    open_ = {s for s in shares if shares[s] > 0 and cap[s] > 0}
    left = min(sum(available.get(s, 0) for s in open_) if total is None else total, sum(cap[s] for s in open_))
    out = dict.fromkeys(shares, 0)
    while open_ and left > 0:
        weight = sum(shares[s] for s in open_)
        full = {s for s in open_ if cap[s] <= shares[s] / weight * left}
        if not full:
            for s in open_:
                out[s] = round(shares[s] / weight * left)
            break
        for s in full:
            out[s] = cap[s]
            left -= cap[s]
        open_ -= full
    return out


def draw(have: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many blocks of each source are among ``n`` of all, multivariate hypergeometric."""
    total = int(have.sum())
    if total < MOST_DRAWN:
        return rng.multivariate_hypergeometric(have, n, method="marginals") if total else have
    # The generator has a limit: blocks move in bundles of one source, the odd ones singly.
    size = total // MOST_DRAWN + 1
    bundles, odd = have // size, have % size
    whole = min(n // size, int(bundles.sum()))
    if n - whole * size > odd.sum():  # open a bundle of the largest source
        k = int(np.argmax(bundles))
        bundles[k] -= 1
        odd[k] += size
        whole = min(n // size, int(bundles.sum()))
    return size * draw(bundles, whole, rng) + draw(odd, n - whole * size, rng)


def split_tree(counts: np.ndarray, low: int, high: int, shards: int, total: int, seed: int, leaves: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low, high, blocks of each source, those before them) of the nodes below [low, high), in order.

    Down to single shards, or to about ``leaves`` nodes.  A node's draw depends on the seed and its bounds alone, so a
    task that is run again comes to the same result.
    """
    least = 1 if leaves is None else max(1, math.ceil((high - low) / leaves))
    stack = [(low, high, counts, np.zeros_like(counts))]
    while stack:
        low, high, have, before = stack.pop()
        if high - low <= least:
            yield low, high, have, before
            continue
        middle = (low + high) // 2
        left = draw(have, total * middle // shards - total * low // shards, np.random.default_rng([seed, low, high]))
        stack += [(middle, high, have - left, before + left), (low, middle, left, before)]


def split_blocks(counts: dict[str, int], shards: int, seed: int = SEED) -> dict[str, np.ndarray]:
    """Blocks of each source in each shard; every shard gets the same number of blocks, but for one."""
    names = sorted(counts)
    have = np.array([counts[s] for s in names], np.int64)
    leaves = list(split_tree(have, 0, shards, shards, int(have.sum()), seed))
    return {s: np.array([x[2][k] for x in leaves], np.int64) for k, s in enumerate(names)}


def permuted(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Images of ``places`` under a permutation of 0..n-1 (a Feistel network, walked until it is below n)."""
    half = max(1, math.ceil(math.log2(max(2, n)) / 2))
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            h = (right + np.uint64(seed * 4 + r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            left, right = right, left ^ ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - half))
        return (left << np.uint64(half)) | right

    out = once(places.astype(np.uint64))
    while len(out_of := np.flatnonzero(out >= n)):
        out[out_of] = once(out[out_of])
    return out.astype(np.int64)


def shards_of_blocks(spark: SparkSession, counts: dict[str, int], shards: int, seed: int) -> DataFrame:
    """source, unit, shard of every block; the lower part of the tree is worked out in tasks."""
    names = sorted(counts)
    have = np.array([counts[s] for s in names], np.int64)
    total, schema = int(have.sum()), "low int, high int, have array<bigint>, before array<bigint>"
    top = [(low, high, h.tolist(), b.tolist()) for low, high, h, b in split_tree(have, 0, shards, shards, total, seed, TOP)] if total else []
    limits = dict(zip(names, have.tolist()))

    def below(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for low, high, h, b in zip(f["low"], f["high"], f["have"], f["before"]):
                for shard, _, n, at in split_tree(np.asarray(h, np.int64), low, high, shards, total, seed):
                    for k, s in enumerate(names):
                        first = b[k] + at[k]
                        if n[k]:
                            yield pd.DataFrame({"source": s, "unit": permuted(np.arange(first, first + n[k]), limits[s], seed + k), "shard": shard})

    nodes = spark.createDataFrame(top, schema).repartition(min(len(top), 256)) if top else spark.createDataFrame([], schema)
    return nodes.mapInPandas(below, "source string, unit bigint, shard int")


def _hash(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _of(values: dict[str, int]) -> Column:
    """The value of the row's source; a target has one."""
    pairs = [x for s, v in values.items() for x in (F.lit(s), F.lit(v).cast("bigint"))]
    return F.try_element_at(F.create_map(*pairs), F.col("source")) if pairs else F.lit(None).cast("bigint")


def _fill(cell: pd.DataFrame) -> pd.DataFrame:
    """Rows of one cell that fill its allowance; the last may go over it by less than what else would be missing."""
    cell = cell.sort_values(["order", "doc_id"])
    left, keep, best = int(cell["allowed"].iloc[0]), [], None
    for k, n in enumerate(cell["n_tokens"]):
        if n <= left:
            keep.append(k)
            left -= n
        elif best is None or n < best[0]:
            best = (n, k)
    if best is not None and best[0] - left < left:
        keep.append(best[1])
    return cell.iloc[keep][["doc_id", "source", "repeat_no", "n_tokens", "place"]]


def mixable(documents: DataFrame, targets: DataFrame, vocabulary: str = bpe.DEFAULT_VOCABULARY) -> tuple[DataFrame, list]:
    """(doc_id, source, n_tokens) of the documents of target sources, and the target rows."""
    wanted = (
        targets.groupBy(source_key(F.col("source")).alias("source"))
        .agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("repeats"))
        .where("source IS NOT NULL")
        .orderBy("source")
        .collect()  # the configured targets: a fixed table
    )
    names = [r["source"] for r in wanted]
    keyed = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").where(F.col("source").isin(names) if names else F.lit(False))
    counted = bpe.count_tokens(keyed.where("text IS NOT NULL AND doc_id IS NOT NULL"), keep=["doc_id", "source"], vocabulary=vocabulary).where("n_tokens > 0")
    once = counted.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("x"))
    return once.select("doc_id", "x.source", "x.n_tokens"), wanted


def _ends(last: DataFrame, left: dict[str, int]) -> dict[str, tuple[int, int, int]]:
    """source -> (low, high, tokens allowed): of its last pass a source gives the places below ``low`` and a part of those up to ``high``.

    The cell that holds the end is cut again until few tokens are in it; each round sums CELLS cells a source.
    """
    at = {s: (0, 1 << PLACE_BITS, n) for s, n in left.items()}
    done: dict[str, tuple[int, int, int]] = {}
    while at:
        width = {s: (high - low) // CELLS for s, (low, high, _) in at.items()}
        cell = F.lit(None).cast("bigint")
        for s, (low, high, _) in at.items():
            cell = F.when((F.col("source") == s) & (F.col("place") >= low) & (F.col("place") < high), F.shiftright(F.col("place") - low, width[s].bit_length() - 1)).otherwise(cell)
        sums = last.select("source", "n_tokens", cell.alias("cell")).where("cell IS NOT NULL").groupBy("source", "cell").agg(F.sum("n_tokens").alias("t")).collect()  # CELLS rows a target
        by: dict[str, dict[int, int]] = {}
        for r in sums:
            by.setdefault(r["source"], {})[r["cell"]] = r["t"]
        for s, (low, _, n) in list(at.items()):
            cells, end = by.get(s, {}), 0
            while end < CELLS and cells.get(end, 0) <= n:
                n -= cells.get(end, 0)
                end += 1
            # What is filled may go on behind the cell where the quota ends: more documents, a closer fit.
            stop, inside = end, 0
            while stop < CELLS and (stop == end or inside + cells.get(stop, 0) <= FILL_TOKENS):
                inside += cells.get(stop, 0)
                stop += 1
            if inside <= FILL_TOKENS or width[s] < CELLS:
                done[s] = (low + end * width[s], low + stop * width[s], n)
                del at[s]
            else:
                at[s] = (low + end * width[s], low + (end + 1) * width[s], n)
    return done


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, vocabulary: str = bpe.DEFAULT_VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(drawn rows, report).

    Drawn: doc_id, source, repeat_no (from 1), n_tokens, shard, position.
    Report: source, target_share, max_repeats, n_documents, available_tokens,
    drawn_rows, drawn_tokens, actual_share, exhausted.
    """
    spark = documents.sparkSession
    counted, wanted = mixable(documents, targets, vocabulary)
    counted = materialize(counted, "counted")
    shares, repeats = {r["source"]: r["share"] for r in wanted}, {r["source"]: r["repeats"] for r in wanted}
    held = {r["source"]: (r["n"], r["t"]) for r in counted.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}  # one row a target
    quota = quotas({s: t for s, (_, t) in held.items()}, shares, repeats, total)
    passes = {s: math.ceil(quota[s] / held[s][1]) for s in held if quota.get(s)}
    shards = max(1, math.ceil(sum(quota.values()) / shard_tokens))
    # Blocks of one pass: SHARD_BLOCKS a shard over all passes, but no more than documents.
    wide = {s: -(-(1 << PLACE_BITS) // max(1, min(held[s][0], math.ceil(SHARD_BLOCKS * shards * held[s][1] / quota[s])))) for s in passes}
    n_blocks = {s: -(-(1 << PLACE_BITS) // w) for s, w in wide.items()}

    some = counted.where(F.col("source").isin(list(passes)) if passes else F.lit(False)).withColumn("passes", _of(passes).cast("int"))
    dealt = some.withColumn("repeat_no", F.explode(F.sequence(F.lit(1), "passes")))
    dealt = dealt.withColumn("place", F.shiftrightunsigned(_hash(seed, "doc_id", "repeat_no"), 64 - PLACE_BITS))
    last = dealt.where("repeat_no = passes")
    ends = _ends(last, {s: quota[s] - (passes[s] - 1) * held[s][1] for s in passes})
    low, high, allowed = ({s: e[k] for s, e in ends.items()} for k in range(3))
    whole = dealt.where((F.col("repeat_no") < F.col("passes")) | (F.col("place") < _of(low)))
    columns = ["doc_id", "source", "repeat_no", "n_tokens", "place"]
    # The rest of a quota: documents in random order, passing over those that no longer fit.
    rest = last.where((F.col("place") >= _of(low)) & (F.col("place") < _of(high))).withColumn("allowed", _of(allowed)).withColumn("order", _hash(seed + 1, "doc_id"))
    rest = rest.groupBy("source").applyInPandas(_fill, f"doc_id {counted.schema['doc_id'].dataType.simpleString()}, source string, repeat_no int, n_tokens bigint, place bigint")
    drawn = whole.select(*columns).unionByName(rest)

    # Blocks are ranges of places; the units of a source are the blocks of its passes, as far as they are drawn.
    units = {s: (passes[s] - 1) * n_blocks[s] + -(-ends[s][1] // wide[s]) for s in passes}
    unit = (F.col("repeat_no") - 1) * _of(n_blocks) + F.call_function("div", F.col("place"), _of(wide))
    chosen = materialize(shards_of_blocks(spark, units, shards, seed), "blocks")
    placed = drawn.withColumn("unit", unit).join(chosen, ["source", "unit"])
    placed = placed.withColumn("position", F.row_number().over(Window.partitionBy("shard").orderBy(_hash(seed + 2, "doc_id", "repeat_no"), "doc_id", "repeat_no")))
    result = placed.select("doc_id", "source", "repeat_no", "n_tokens", "shard", "position")

    exhausted = lambda s: s not in held or bool(quota[s] and quota[s] >= held[s][1] * repeats[s])
    base = spark.createDataFrame(
        [(s, shares[s], repeats[s], *held.get(s, (0, 0)), exhausted(s)) for s in shares], "source string, target_share double, max_repeats int, n_documents bigint, available_tokens bigint, exhausted boolean"
    )
    got = drawn.groupBy("source").agg(F.count("*").alias("drawn_rows"), F.sum("n_tokens").alias("drawn_tokens"))
    report = base.join(F.broadcast(got), "source", "left").fillna(0, ["drawn_rows", "drawn_tokens"])  # both sides: a row for each target
    report = report.withColumn("actual_share", F.coalesce(F.round(F.col("drawn_tokens") / F.nullif(F.sum("drawn_tokens").over(Window.partitionBy()), F.lit(0)), 9), F.lit(0.0)))
    return result, report
