"""Keeping an index up to date: last-write-wins tables, manifests and what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Times closer than this are the same modification.
SAME_MILLIS = 1000
# Fixed value: the last lines of a report.
USAGE = '\n\nUsage: search_docs(query, category="<name>") to search within a category.'


def last_wins(rows: DataFrame, keys: list[str], order: str, ties: list[str] | None = None) -> DataFrame:
    """The latest row of each key; among equally late ones the one that is first by ``ties``, by default all columns.

    One shuffle and one sort; repeats within a partition are dropped before the shuffle (window group limit), and columns
    that nobody reads are not carried along unless they are among ``ties``.
    """
    rest = [c for c in rows.columns if c not in keys and c != order] if ties is None else ties
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), *([F.xxhash64(*rest)] if rest else []))
    return rows.withColumn("__nth", F.row_number().over(w)).where("`__nth` = 1").drop("__nth")


def category_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("category").agg(F.count("*").alias("n"))


def counts_with_total(chunks: DataFrame) -> DataFrame:
    """Chunks of each category and, with null category and is_total 1, of all."""
    return chunks.rollup("category").agg(F.count("*").alias("n"), F.grouping("category").cast("int").alias("is_total"))


def manifest_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("category").agg(F.sum(F.coalesce(F.size("chunk_ids"), F.lit(0))).alias("n"))


def build_manifest(chunks: DataFrame, mtimes: DataFrame | None = None) -> DataFrame:
    """source_path, category, n_chunks, chunk_ids, parent_ids of each indexed file, ids in order."""
    made = chunks.groupBy("source_path").agg(
        F.min("category").alias("category"), F.count("*").alias("n_chunks"), F.array_sort(F.collect_set("id")).alias("chunk_ids"), F.array_sort(F.collect_set("parent_id")).alias("parent_ids")
    )
    return made if mtimes is None else made.join(mtimes.select("source_path", "mtime"), "source_path", "left")


def diff(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """source_path, status: added, modified, deleted or unchanged.

    Both sides have source_path and mtime.  A missing time on either side counts as a change.
    """
    old = last_wins(manifest.select("source_path", "mtime"), ["source_path"], "mtime").select("source_path", F.col("mtime").alias("old"), F.lit(1).alias("was"))
    new = last_wins(current.select("source_path", "mtime"), ["source_path"], "mtime").select("source_path", F.col("mtime").alias("new"), F.lit(1).alias("now"))
    apart = F.abs(F.unix_millis(F.col("new").cast("timestamp")) - F.unix_millis(F.col("old").cast("timestamp")))
    status = (
        F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull(), "added").when(F.coalesce(apart < SAME_MILLIS, F.lit(False)), "unchanged").otherwise("modified")
    )
    return new.join(old, "source_path", "full_outer").select("source_path", status.alias("status"))


def apply_changes(stored: DataFrame, status: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows of files that did not change, and the fresh rows of those that did."""
    gone = status.where("status IN ('deleted', 'modified')").select("source_path")
    return stored.join(gone, "source_path", "left_anti").unionByName(fresh)


def dangling(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_path, id of manifest entries whose chunk is not stored."""
    listed = manifest.select("source_path", F.explode("chunk_ids").alias("id")).distinct()
    return listed.join(chunks.select("id").distinct(), "id", "left_anti").select("source_path", "id")


def unlisted(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """source_path of stored chunks that no manifest entry has."""
    return chunks.select("source_path").distinct().join(manifest.select("source_path"), "source_path", "left_anti")


def category_report(counts: DataFrame, categories: DataFrame, project: str = "knowledge base") -> DataFrame:
    """One row ``report``: categories by size with their descriptions; configured ones without chunks show 0."""
    w = Window.partitionBy()
    described = categories.select("category", "ord", F.coalesce("description", F.lit("")).alias("description"))
    rows = described.join(counts, "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.withColumn("total", F.sum("n").over(w))
    number = F.format_number("n", 0)
    pad = lambda c, n, left: F.when(F.length(c) >= n, c).otherwise(F.lpad(c, n, " ") if left else F.rpad(c, n, " "))
    line = F.concat(F.lit("  "), pad(F.col("category"), 15, False), F.lit(" "), pad(number, 6, True), F.lit(" chunks"), F.when(F.col("description") != "", F.concat(F.lit("  — "), "description")).otherwise(F.lit("")))
    # A row for each configured category.
    lines = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), "ord", line.alias("line"))))
    head = F.concat(F.lit(project + " — "), F.first("total").cast("string"), F.lit(" total chunks\n\n"))
    return rows.agg(F.concat(head, F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit(USAGE)).alias("report"))
