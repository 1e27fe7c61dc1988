"""The registered queries of the retrieval engine, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.config import Category
from lexmill.functions import paths, text
from lexmill.operators import chunking, docstrings, fusion, html_markdown, lexical, lexical_batch, maintenance, vector
from lexmill.plans import cases
from lexmill.plans.engine import hashed_queries, hybrid
from lexmill.plans.oracle import oracle_sql
from lexmill.session import read_table

__all__ = ["flagship", "oracle_sql", "queries"]

#: The stated queries of the single searches.
SEARCHES = [(1, "how to export the remote cache"), (2, "cookie settings and the privacy policy"), (3, "serial panel compiler epoch the the epoch")]
TOP = 20
#: Folders of the stored files, in the order of the categories.
FOLDERS = [Category(c, paths=(p,)) for c, p in (("docs", "processed/docs"), ("api", "processed/api"), ("guides", "processed/guides"), ("web", "processed/web"), ("faq", "processed/faq"), ("notes", "processed/notes"), ("examples", "raw_data/examples"), ("archive", "processed/archive"))]


def store(spark: SparkSession, d: str) -> DataFrame:
    """Stored chunks: the last delivery of each id."""
    return maintenance.last_wins(read_table(spark, d, "chunks"), ["id"], "indexed_at", ["category", "source_path", "module", "parent_id"])


def searchable(spark: SparkSession, d: str) -> DataFrame:
    return store(spark, d).where("text IS NOT NULL").select("id", "category", "text")


def stored_parents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "parents")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """documents as files of a category: path, category, text read like a file."""
    docs = read_table(spark, d, "documents", spread=True).where("text IS NOT NULL")
    source = F.coalesce(F.lower(F.trim("source")), F.lit("none"))
    return docs.select(F.concat(F.lit("docs/"), source, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_path"), F.lit("docs").alias("category"), text.strip(text.universal_newlines("text")).alias("text"))


def stated(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "query_id bigint, query string")


def title_queries(spark: SparkSession, d: str) -> DataFrame:
    """The query set of the batch searches: titles of the documents whose id is divisible by 100."""
    return read_table(spark, d, "documents").where("doc_id % 100 = 0 AND title IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


# ---------------------------------------------------------------------- ingest


def strip_normalize_docs(spark, d):
    return corpus(spark, d).select("source_path", "text")


def chunk_heading_docs(spark, d):
    return chunking.explode_flat(corpus(spark, d), "heading", 1200, 200).select("source_path", "chunk_no", "id", "text")


def chunk_char_docs_1200_200(spark, d):
    cut = corpus(spark, d).select("source_path", F.posexplode(chunking.char_split("text", 1200, 200)).alias("chunk_no", "text"))
    return cut.select("source_path", "chunk_no", "text")


def chunk_parents_docs(spark, d):
    return chunking.explode_parents(corpus(spark, d), "heading", 1200, 200).select("source_path", "parent_no", "parent_id", "text")


def chunk_children_docs_300_50(spark, d):
    parents = chunking.explode_parents(corpus(spark, d), "heading", 1200, 200)
    return chunking.explode_children(parents, 300, 50).select("source_path", "parent_no", "child_no", "parent_id", "id", "text")


def chunk_whole_files(spark, d):
    files = read_table(spark, d, "source_files").where("content IS NOT NULL").dropDuplicates(["file_id"])
    files = files.select("file_id", F.col("source_file").alias("source_path"), text.strip(text.universal_newlines("content")).alias("text"))
    return chunking.explode_flat(files, "whole_file", 0, 200).select("file_id", "source_path", "chunk_no", "id", "text")


def chunk_metadata(spark, d):
    p = F.col("source_path")
    return store(spark, d).select("id", paths.base_name(p).alias("source"), paths.suffix(p).alias("suffix"), paths.module_label(p, paths.detect_category(p, FOLDERS).isin("docs", "api", "guides", "faq", "notes")).alias("module"), paths.detect_category(p, FOLDERS).alias("category"))


# ----------------------------------------------------------------------- index


def upsert_last_wins(spark, d):
    return store(spark, d).select("id", "category", "source_path", "module", "parent_id", F.coalesce(F.length("text"), F.lit(-1)).alias("n_chars"), "indexed_at")


def chunks_per_category(spark, d):
    return maintenance.category_counts(store(spark, d))


def chunks_total_rollup(spark, d):
    return maintenance.counts_with_total(store(spark, d))


def manifest_counts(spark, d):
    latest = maintenance.last_wins(read_table(spark, d, "manifest"), ["source_path"], "mtime")
    return maintenance.manifest_counts(latest)


def list_categories(spark, d):
    return maintenance.category_report(maintenance.category_counts(store(spark, d)), read_table(spark, d, "categories"))


def tokenize_chunks(spark, d):
    return searchable(spark, d).select("id", F.posexplode(text.tokens("text")).alias("pos", "term"))


def postings_tf(spark, d):
    return lexical.postings(searchable(spark, d)).select("id", "term", "tf", "dl")


def doc_len(spark, d):
    return lexical.document_lengths(searchable(spark, d)).select("id", "dl")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


def term_stats_idf(spark, d):
    return _rounded(lexical.build_index(searchable(spark, d)).term_stats)


def corpus_stats(spark, d):
    return _rounded(lexical.build_index(searchable(spark, d)).corpus_stats)


# ---------------------------------------------------------------------- search


def bm25_topk(spark, d):
    return lexical.bm25_search(lexical.build_index(searchable(spark, d)), stated(spark), TOP)


def bm25_topk_category(spark, d):
    return lexical.bm25_search(lexical.build_index(searchable(spark, d)), stated(spark), TOP, "guides")


def bm25_topk_batch(spark, d):
    return lexical_batch.bm25_many(searchable(spark, d), title_queries(spark, d), TOP)


def _vectors(spark, d):
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")


def _vector_queries(spark, d, where: str):
    return _vectors(spark, d).where(where).select(F.col("id").alias("query_id"), "embedding")


def vector_topk(spark, d):
    return vector.cosine_topk(_vectors(spark, d), _vector_queries(spark, d, "id = 0"), TOP)


def vector_topk_category(spark, d):
    return vector.cosine_topk(_vectors(spark, d).where("label = 3"), _vector_queries(spark, d, "id = 0"), TOP)


def vector_topk_batch(spark, d):
    return vector.cosine_topk(_vectors(spark, d), _vector_queries(spark, d, "id % 100 = 0"), TOP)


def _two_rankings(spark, d):
    index = lexical.build_index(searchable(spark, d))
    near = vector.hashed_cosine(vector.dense(vector.hash_features(index.postings)), hashed_queries(stated(spark)), 24)
    return lexical.bm25_search(index, stated(spark), 24), near


def hashed_cosine_topk(spark, d):
    return _two_rankings(spark, d)[1]


def rrf_fuse(spark, d):
    return fusion.rrf(*_two_rankings(spark, d))


def _hybrid(spark, d, category=None, resolve=True, keyword_only=False, n=8):
    chunks = store(spark, d).where("text IS NOT NULL")
    index = lexical.build_index(chunks.select("id", "category", "text"))
    return hybrid(index, vector.dense(vector.hash_features(index.postings)), chunks, stored_parents(spark, d), stated(spark), n, category, resolve, keyword_only)


def hybrid_search(spark, d):
    return _hybrid(spark, d, resolve=False).drop("parent_id", "hits")


def hybrid_search_category(spark, d):
    return _hybrid(spark, d, category="api", resolve=False).drop("parent_id", "hits")


def hybrid_lexical_only(spark, d):
    return _hybrid(spark, d, resolve=False, keyword_only=True).drop("parent_id", "hits")


def resolve_parents(spark, d):
    return _hybrid(spark, d, category="docs", n=15).select("query_id", "rank", "parent_id", "hits", "source_path", "text")


def resolve_parents_all(spark, d):
    """As resolve_parents, without a category: the default of a search."""
    return _hybrid(spark, d, n=15).select("query_id", "rank", "parent_id", "hits", "source_path", "text")


def fetch_by_ids(spark, d):
    ranked = lexical.bm25_search(lexical.build_index(searchable(spark, d)), stated(spark), TOP)
    return fusion.fetch(ranked, store(spark, d)).drop("parent_id")


def search_render(spark, d):
    return fusion.render_results(_hybrid(spark, d, resolve=False), stated(spark))


# ----------------------------------------------------------------- maintenance


def manifest_build(spark, d):
    return maintenance.build_manifest(store(spark, d))


def _current(spark, d):
    """Files on hand: those of the stored chunks, as old as their last delivery."""
    return store(spark, d).groupBy("source_path").agg(F.max("indexed_at").alias("mtime"))


def manifest_diff(spark, d):
    return maintenance.diff(_current(spark, d), read_table(spark, d, "manifest"))


def incremental_kept(spark, d):
    kept = store(spark, d).select("id", "source_path")
    return maintenance.apply_changes(kept, manifest_diff(spark, d), kept.where("false"))


def dangling_ids(spark, d):
    return maintenance.dangling(read_table(spark, d, "manifest"), read_table(spark, d, "chunks"))


def unlisted_files(spark, d):
    return maintenance.unlisted(read_table(spark, d, "chunks"), read_table(spark, d, "manifest"))


# ------------------------------------------------------------------ converters


def html_to_md(spark, d):
    """Every document as a page with scripts, navigation and a footer, and back as Markdown."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    docs = read_table(spark, d, "documents", spread=True).where("text IS NOT NULL")
    body = text.strip(text.universal_newlines("text"))
    html = F.concat(
        F.lit("<html><head><title>t</title><style>p {}</style><script>var x = '<p>';</script></head><body><nav><ul><li>Home</ul></nav><h1>"),
        esc(F.coalesce("title", F.lit("untitled"))),
        F.lit("</h1><!-- note --><p>"),
        esc(body),
        F.lit("<ul><li>"),
        esc(F.coalesce(F.trim("lang"), F.lit("none"))),
        F.lit("<li><b>"),
        F.col("doc_id").cast("string"),
        F.lit("</b></ul><div class='footer'>x</div><footer>end</footer></body></html>"),
    )
    return html_markdown.convert(docs.select("doc_id", html.alias("html")))


def md_cleanup(spark, d):
    return read_table(spark, d, "documents", spread=True).where("text IS NOT NULL").select("doc_id", text.clean_markdown("text").alias("markdown"))


def docstring_items(spark, d):
    files = read_table(spark, d, "source_files").dropDuplicates(["file_id"])
    return docstrings.extract(files, keep=["file_id"])


def _items(spark, d):
    return read_table(spark, d, "docstring_items").dropDuplicates(["item_id"])


def docstring_markdown(spark, d):
    return _items(spark, d).select("item_id", docstrings.item_markdown().alias("markdown"))


def package_group_key(spark, d):
    return _items(spark, d).select("source_file").distinct().select("source_file", paths.package_key("source_file", 3).alias("group_key"))


def docstring_modules(spark, d):
    return docstrings.module_markdown(_items(spark, d).withColumn("module", paths.package_key("source_file", 3)), "module", ["source_file", "item_id"])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return hybrid_search(spark, d)


_ALL = [
    strip_normalize_docs, chunk_heading_docs, chunk_char_docs_1200_200, chunk_parents_docs, chunk_children_docs_300_50, chunk_whole_files, chunk_metadata,
    upsert_last_wins, chunks_per_category, chunks_total_rollup, manifest_counts, list_categories, tokenize_chunks, postings_tf, doc_len, term_stats_idf, corpus_stats,
    bm25_topk, bm25_topk_category, bm25_topk_batch, vector_topk, vector_topk_category, vector_topk_batch, hashed_cosine_topk, rrf_fuse,
    hybrid_search, hybrid_search_category, hybrid_lexical_only, resolve_parents, resolve_parents_all, fetch_by_ids, search_render,
    manifest_build, manifest_diff, incremental_kept, dangling_ids, unlisted_files,
    html_to_md, md_cleanup, docstring_items, docstring_markdown, package_group_key, docstring_modules,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL} | cases.queries()
