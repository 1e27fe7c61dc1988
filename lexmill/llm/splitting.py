"""Splitting oversized items at natural boundaries, inside the JVM.

One regular expression per limit takes a text apart: its alternatives, from
the strongest boundary to the weakest, each consume up to the limit with a
bounded quantifier, and the last one cuts between any two characters.  The
overlap comes from looking back from the start of each extract.

Results: pieces have at most ``limit`` code points; every piece but the first
repeats the last ``overlap`` code points before it; without those repeats the
pieces join to the text again.  A null, zero or negative limit means no limit:
one piece.  Null or empty text gives no piece.  An overlap of null or less than 0 counts
as 0, one of limit or more as limit - 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.arrays import let, running_starts, with_overlap

#: What must stand before a cut, from the strongest boundary to the weakest.
BOUNDARIES = (
    r"\n[ \t\r]{0,8}\n",  # paragraph; a lookbehind needs a bounded length
    r"\n",  # line
    r"[.!?…][\"')\]]?[ \t]|[。！？]",  # sentence
    r"[,;:][ \t]|[，；：、]",  # clause
    r"[ \t]",  # word
)
#: A boundary is taken only in the last half of the window, so that pieces do not become crumbs.
LEAST_PART = 2


def pattern_for(limit: Column, overlap: Column) -> Column:
    """The extraction pattern of one limit; \\G keeps the extracts adjacent."""
    step = limit - overlap
    least = F.greatest(F.lit(1), F.ceil(step / LEAST_PART).cast("int"))

    def window(low: Column, high: Column, tail: str) -> list[Column]:
        return [F.lit(".{"), low.cast("string"), F.lit(","), high.cast("string"), F.lit("}" + tail)]

    one = F.lit(1)
    parts = [F.lit(r"(?s)\A"), *window(one, limit, r"\z|"), F.lit(r"\G(?:"), *window(one, step, r"\z")]
    for b in BOUNDARIES:
        parts += [F.lit("|"), *window(least, step, f"(?<={b})")]
    parts += [F.lit("|"), *window(one, step, ")")]
    return F.concat(*parts)


def cores(text: Column, limit: Column, overlap: Column) -> Column:
    """The text cut into adjacent extracts; together they are the text."""
    lim = limit.cast("int")
    over = F.greatest(F.lit(0), F.least(F.coalesce(overlap.cast("int"), F.lit(0)), lim - 1))
    bounded = lim.isNotNull() & (lim > 0)
    return (
        F.when(text.isNull() | (F.length(text) == 0), F.array().cast("array<string>"))
        .when(~F.coalesce(bounded, F.lit(False)) | (F.length(text) <= lim), F.array(text))
        .otherwise(F.regexp_extract_all(text, pattern_for(lim, over), F.lit(0)))
    )


def split_items(items: DataFrame, text: str = "text", limit: str = "size_limit", overlap: str = "size_overlap") -> DataFrame:
    """Columns of ``items`` but ``text``, plus piece_no (from 0), start (code points from 0), piece.

    A name of these three that ``items`` already has is replaced.
    """
    keep = [c for c in items.columns if c not in (text, "piece_no", "start", "piece")]
    lim, over = F.col(f"`{limit}`").cast("int"), F.greatest(F.lit(0), F.coalesce(F.col(f"`{overlap}`").cast("int"), F.lit(0)))
    over = F.when(lim > 0, F.least(over, lim - 1)).otherwise(F.lit(0))
    least = F.greatest(F.lit(1), F.ceil((lim - over) / LEAST_PART).cast("int"))

    def placed(extracts: Column) -> Column:
        pieces, starts = with_overlap(extracts, over, least), running_starts(F.transform(extracts, F.length))
        return F.zip_with(pieces, starts, lambda p, s: F.struct(F.greatest(F.lit(0), s - F.when(s > 0, over).otherwise(F.lit(0))).alias("start"), p.alias("piece")))

    cut = let(cores(F.col(f"`{text}`"), F.col(f"`{limit}`"), F.col(f"`{overlap}`")), placed)
    # From a plain explode the optimizer would derive a filter that holds the whole cut a second time.
    made = items.select(*[F.col(f"`{c}`") for c in keep], F.posexplode_outer(cut).alias("piece_no", "__cut")).where("piece_no IS NOT NULL")
    return made.select(*[F.col(f"`{c}`") for c in keep], "piece_no", "__cut.start", "__cut.piece")


def limits(categories: DataFrame) -> DataFrame:
    """category -> limit and overlap of its chunks and of its parents; a fixed table of configured categories."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    cut = F.col("chunk_strategy") != "whole_file"
    child = positive("child_chunk_size")
    return categories.dropDuplicates(["category"]).select(
        "category",
        F.when(cut, F.coalesce(child, positive("chunk_size"))).alias("child_limit"),
        F.when(child.isNotNull(), F.col("child_overlap")).otherwise(F.col("chunk_overlap")).alias("child_over"),
        F.when(cut, positive("chunk_size")).alias("parent_limit"),
        F.col("chunk_overlap").alias("parent_over"),
    )


def corpus_items(chunks: DataFrame, parents: DataFrame, categories: DataFrame) -> DataFrame:
    """item_id, item_kind, text, size_limit, size_overlap of every delivered row of both tables."""
    by = F.broadcast(limits(categories))  # one row per configured category
    a = chunks.select(F.col("id").alias("item_id"), F.lit("chunk").alias("item_kind"), "category", "text").join(by, "category", "left")
    b = parents.select(F.col("parent_id").alias("item_id"), F.lit("parent").alias("item_kind"), "category", "text").join(by, "category", "left")
    return a.select("item_id", "item_kind", "text", F.col("child_limit").alias("size_limit"), F.col("child_over").alias("size_overlap")).unionByName(
        b.select("item_id", "item_kind", "text", F.col("parent_limit").alias("size_limit"), F.col("parent_over").alias("size_overlap"))
    )


def corpus_pieces(chunks: DataFrame, parents: DataFrame, categories: DataFrame) -> DataFrame:
    """All items as pieces within their limit; rows delivered again are dropped before the cut, those without id by their text."""
    nameless = F.when(F.col("item_id").isNull(), F.xxhash64("text"))
    once = corpus_items(chunks, parents, categories).withColumn("__nameless", nameless).dropDuplicates(["item_kind", "item_id", "__nameless"])
    return split_items(once).select("item_kind", "item_id", "piece_no", "start", "piece", "size_limit")


def oversized(chunks: DataFrame, parents: DataFrame, categories: DataFrame) -> DataFrame:
    """item_id of each item that comes out in more than one piece."""
    pieces = split_items(corpus_items(chunks, parents, categories).where("item_id IS NOT NULL"))
    return pieces.where("piece_no = 1").select("item_id").distinct()
