"""Merging of rankings, fetching of texts and lifting of hits to their parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The rank offset of the fusion and the sizes of a search.
RRF_K = 60
#: Each ranking gives this many times the wanted results, but no more than FETCH_MOST.
FETCH_FACTOR, FETCH_MOST = 3, 30
MOST_RESULTS = 15
#: Hits up to this number are sent to the stored chunks and parents; more of them are shuffled to meet.
SENT_HITS = 50_000


def wanted_results(n: int) -> int:
    return max(1, min(n, MOST_RESULTS))


def fetch_size(n: int) -> int:
    return min(FETCH_FACTOR * n, FETCH_MOST)


def rrf(first: DataFrame, second: DataFrame, n: int | None = None, k: int = RRF_K) -> DataFrame:
    """query_id, id, score, rank: reciprocal ranks summed over both rankings.

    Ties: the order of the first ranking, then that of the second.  With one
    ranking empty the other's order comes out, so no special case is needed.
    """
    a = first.select("query_id", "id", F.col("rank").alias("ra"))
    b = second.select("query_id", "id", F.col("rank").alias("rb"))
    both = a.join(b, ["query_id", "id"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", part("ra") + part("rb"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("ra"), F.asc("rb"))
    out = scored.withColumn("rank", F.row_number().over(w))
    if n is not None:
        out = out.where(F.col("rank") <= n)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def small(hits: DataFrame, most: int | None) -> DataFrame:
    """``hits`` marked for sending out if they are known to be at most SENT_HITS."""
    return F.broadcast(hits) if most is not None and most <= SENT_HITS else hits


def fetch(ranked: DataFrame, chunks: DataFrame, most: int | None = None) -> DataFrame:
    """Ranked ids with their chunk; ids without a chunk vanish.  ``most`` bounds the number of ranked rows, where the caller knows."""
    rest = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in ("category", "source", "source_path", "module") else F.col(c) for c in ("text", "category", "source", "source_path", "module", "parent_id")]
    return chunks.select("id", "text", "category", "source", "source_path", "module", "parent_id").join(small(ranked, most), "id").select("query_id", "rank", "id", *rest)


def resolve_parents(results: DataFrame, parents: DataFrame, enabled: bool = True, most: int | None = None) -> DataFrame:
    """Hits with a stored parent become that parent, once, with the data of their first hit.

    Parents come first, those with more hits before others, then in order of
    their first hit; hits without a parent follow in their own order.  Of a
    parent stored in several versions the greatest text counts.  Only parents
    of hits are gathered, not the whole table.
    """
    if not enabled:
        return results.select("query_id", "rank", "text", "category", "source", "source_path", "module", F.lit(None).cast("string").alias("parent_id"), F.lit(1).cast("bigint").alias("hits"))
    asked = results.select("parent_id").where("parent_id IS NOT NULL").distinct()
    store = parents.join(small(asked, most), "parent_id", "left_semi").groupBy("parent_id").agg(F.max("text").alias("parent_text"))
    joined = results.join(store, "parent_id", "left").withColumn("is_parent", F.col("parent_text").isNotNull())
    fields = ["category", "source", "source_path", "module"]
    key = F.when(F.col("is_parent"), F.col("parent_id")).otherwise(F.concat(F.lit("#"), F.col("id")))
    merged = joined.groupBy("query_id", key.alias("key"), "is_parent").agg(
        F.count("*").alias("hits"),
        F.min("rank").alias("first_rank"),
        F.min_by(F.struct(F.coalesce("parent_text", "text").alias("text"), *fields, F.when(F.col("is_parent"), F.col("parent_id")).alias("parent_id")), "rank").alias("x"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("is_parent"), F.when(F.col("is_parent"), F.col("hits")).desc_nulls_last(), "first_rank")
    return merged.withColumn("rank", F.row_number().over(w)).select("query_id", "rank", "x.*", "hits")


def render_results(results: DataFrame, queries: DataFrame, most_text: int = 2000, category: str | None = None) -> DataFrame:
    """query_id, rendered: the results of each query as one text."""
    text = F.when(F.length("text") > most_text, F.concat(F.left("text", F.lit(most_text)), F.lit("\n... [truncated]"))).otherwise(F.col("text"))
    label: Column = F.when(F.col("module") != "", F.concat(F.lit(" ("), "module", F.lit(")"))).otherwise(F.lit(""))
    entry = F.concat(F.lit("--- Result "), F.col("rank").cast("string"), F.lit(" | ["), "category", F.lit("]"), label, F.lit(" | "), "source", F.lit(" ---\n"), text, F.lit("\n"))
    # At most MOST_RESULTS rows a query.
    body = results.groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))).alias("entries"))
    nothing = F.concat(
        F.lit(f"No results found in category '{category}' for: \"" if category else 'No results found for: "'),
        "query",
        F.lit('"\n\nSuggestions:\n  - Rephrase the query or try different keywords\n  - Remove the category filter to search all documentation\n  - Make sure the index is built (see the category list)'),
    )
    found = F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(' result(s) for: "'), "query", F.lit('"\n\n'), F.array_join(F.transform("entries", lambda e: e["entry"]), "\n"))
    return queries.join(body, "query_id", "left").select("query_id", F.when(F.col("n").isNull(), nothing).otherwise(found).alias("rendered"))
