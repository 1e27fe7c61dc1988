"""The engine: builds index snapshots and answers searches from the published one."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.config import Category, Settings
from lexmill.operators import chunking, embedding, fusion, lexical, maintenance, vector, vector_index
from lexmill.plans.store import SnapshotStore, union_all
from lexmill.session import materialize
from lexmill.sources import files as source_files

CHUNK_COLUMNS = ["id", "text", "category", "source", "source_path", "module", "parent_id"]
PARENT_COLUMNS = ["parent_id", "source_path", "category", "text"]


def chunk_files(files: DataFrame, category: Category) -> tuple[DataFrame, DataFrame]:
    """(chunks, parents) of one category's files."""
    base = files.select("source_path", "category", "source", "module", "text")
    if category.has_children:
        parents = chunking.explode_parents(base, category.chunk_strategy, category.chunk_size, category.chunk_overlap)
        chunks = chunking.explode_children(parents, category.child_chunk_size, category.child_overlap)
        return chunks.select(*CHUNK_COLUMNS), parents.select(*PARENT_COLUMNS)
    chunks = chunking.explode_flat(base, category.chunk_strategy, category.chunk_size, category.chunk_overlap)
    no_parent = chunks.withColumn("parent_id", F.lit(None).cast("string"))
    return no_parent.select(*CHUNK_COLUMNS), base.where("false").select(F.lit(None).cast("string").alias("parent_id"), "source_path", "category", "text")


def chunk_all(files: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    both = [chunk_files(files.where(F.col("category") == c.name), c) for c in settings.categories]
    return union_all([a for a, _ in both]), union_all([b for _, b in both])


def settings_key(settings: Settings, embedder: embedding.Embedder | None = None) -> str:
    """Changes whenever a setting that shapes chunks or vectors changes."""
    return hashlib.md5(repr((settings, embedder)).encode(), usedforsecurity=False).hexdigest()


def hashed_queries(queries: DataFrame) -> DataFrame:
    """id, category, embedding: hashed term counts of each (query_id, query)."""
    terms = lexical.query_terms(queries).select(F.col("query_id").alias("id"), F.lit("").alias("category"), "term", F.col("qtf").alias("tf"))
    return vector.dense(vector.hash_features(terms))


def hashed_near(vectors: DataFrame, queries: DataFrame, n: int, category: str | None) -> DataFrame:
    """Vector ranking by hashed term counts."""
    own = vectors if category is None else vectors.where(F.col("category") == category)
    return vector.hashed_cosine(own, hashed_queries(queries), n)


def dense_near(embeddings: DataFrame, queries: DataFrame, embedder: embedding.Embedder, n: int, category: str | None) -> DataFrame:
    """Vector ranking by an embedder; the category narrows what is searched."""
    own = embeddings if category is None else embeddings.where(F.col("category") == category)
    return vector.cosine_topk(own, embedding.embed(queries, embedder, "query", keep=["query_id"]), n)


def merge(words: DataFrame, near: DataFrame, chunks: DataFrame, parents: DataFrame, n: int, resolve: bool = True, asked: int | None = None) -> DataFrame:
    """query_id, rank, text, category, source, source_path, module, parent_id, hits of two rankings; ``asked`` is the number of queries, where known."""
    most = None if asked is None else asked * n
    hits = fusion.fetch(fusion.rrf(words, near, n), chunks, most)
    # The hits are read twice, once for their parents' ids; written, they are searched for once.
    return fusion.resolve_parents(materialize(hits, "hits") if resolve else hits, parents, resolve, most)


def hybrid(index: lexical.KeywordIndex, vectors: DataFrame, chunks: DataFrame, parents: DataFrame, queries: DataFrame, n: int = 8, category: str | None = None, resolve: bool = True, keyword_only: bool = False) -> DataFrame:
    """Keyword and hashed vector ranking of each (query_id, query), merged."""
    category, many = category or None, fusion.fetch_size(n)
    words = lexical.bm25_search(index, queries, many, category)
    near = words.where("false") if keyword_only else hashed_near(vectors, queries, many, category)
    return merge(words, near, chunks, parents, n, resolve, queries.count())


@dataclass
class BuildReport:
    mode: str
    total: int
    by_category: dict[str, int]


class Engine:
    def __init__(self, spark: SparkSession, root: str, settings: Settings, embedder: embedding.Embedder | None = None, inverted: bool = False):
        """Without an ``embedder`` vectors are hashed term counts.

        With ``inverted`` a build also writes an inverted file of the vectors, and searches without a category open only
        as many of its cells as its builder measured to need; without it all vectors are compared, which is exact.
        """
        self.spark, self.settings, self.embedder, self.store, self.inverted = spark, settings, embedder, SnapshotStore(spark, root), inverted

    # ------------------------------------------------------------------ build

    def verify(self) -> list[str]:
        """Configured folders that do not exist."""
        return source_files.missing_folders(self.spark, self.settings)

    def census(self) -> DataFrame:
        return source_files.census(self.spark, self.settings)

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        return embedding.embed(chunks.select("id", "category", "source_path", "text"), self.embedder, keep=["id", "category", "source_path"])

    def _finish(self, snapshot: str, mode: str, files: DataFrame, chunks: DataFrame, parents: DataFrame, embeddings: DataFrame | None = None) -> BuildReport:
        w = self.store.write
        chunks = w(snapshot, "chunks", chunks, "category")
        parents = w(snapshot, "parents", parents)
        # In the order of the terms, so that a search for some of them skips most of the table.
        posting = w(snapshot, "postings", lexical.postings(chunks, unique=True).repartition("term").sortWithinPartitions("term"))
        lengths = w(snapshot, "doc_stats", lexical.document_lengths(chunks))
        terms, corpus = lexical.term_statistics(posting, lexical.corpus_size(lengths))
        w(snapshot, "term_stats", terms)
        w(snapshot, "corpus_stats", corpus)
        if self.embedder is None:
            vectors = w(snapshot, "embeddings", vector.dense(vector.hash_features(posting)))
        else:
            vectors = w(snapshot, "embeddings", self._embedded(chunks) if embeddings is None else embeddings)
        if self.inverted:
            centres = vector_index.fit_centres(vectors)
            placed = w(snapshot, "placed", vector_index.assign(vectors.select("id", "embedding"), centres))
            w(snapshot, "cells", vector_index.packed(placed))
            probes = vector_index.probes_for(placed, centres)
            w(snapshot, "centres", self.spark.createDataFrame([(k, probes, c.tolist()) for k, c in enumerate(centres)], "cell int, probes int, centre array<double>"))
        w(snapshot, "manifest", maintenance.build_manifest(chunks, files))
        names = self.spark.createDataFrame([(c.name, k, c.description) for k, c in enumerate(self.settings.categories)], "category string, ord int, description string")
        counts = names.join(maintenance.category_counts(chunks), "category", "left").select("category", "ord", "description", F.coalesce("n", F.lit(0)).alias("n"))
        counts = w(snapshot, "category_stats", counts)
        w(snapshot, "settings", self.spark.createDataFrame([(settings_key(self.settings, self.embedder),)], "key string"))
        self.store.publish(snapshot)
        by = {r["category"]: r["n"] for r in counts.orderBy(F.desc("n"), "ord").collect()}  # a row for each category
        return BuildReport(mode, sum(by.values()), by)

    def build_full(self) -> BuildReport:
        files = source_files.all_files(self.spark, self.settings)
        return self._finish(self.store.begin(), "full", files.select("source_path", "mtime"), *chunk_all(files, self.settings))

    def build_incremental(self) -> BuildReport:
        """Cuts only files that are new or changed; without a usable index, or after a change of settings, all."""
        at = self.store.current()
        if at is None or self.store.table("settings", at).first()["key"] != settings_key(self.settings, self.embedder):
            return self.build_full()
        # Names and times only; contents are read of what changed.
        seen = source_files.all_files(self.spark, self.settings).select("source_path", "mtime")
        status = maintenance.diff(seen, self.store.table("manifest", at)).persist()
        try:
            todo = source_files.some_files(self.spark, self.settings, status.where("status IN ('added', 'modified')"))
            fresh, fresh_parents = chunk_all(todo, self.settings)
            chunks = maintenance.apply_changes(self.store.table("chunks", at).select(*CHUNK_COLUMNS), status, fresh)
            parents = maintenance.apply_changes(self.store.table("parents", at).select(*PARENT_COLUMNS), status, fresh_parents)
            vectors = None
            if self.embedder is not None:  # texts that did not change are not embedded again
                vectors = maintenance.apply_changes(self.store.table("embeddings", at), status, self._embedded(fresh))
            return self._finish(self.store.begin(), "incremental", seen, chunks, parents, vectors)
        finally:
            status.unpersist()

    def reindex(self) -> str:
        """Full build, reported as text; failures too."""
        try:
            done = self.build_full()
        except Exception as e:  # noqa: BLE001 - the caller is a tool that shows text
            return f"Reindex failed: {e}"
        return "\n".join([f"Re-indexing complete. {done.total} total chunks.\n", *(f"  {c}: {n:,} chunks" for c, n in done.by_category.items())])

    # ----------------------------------------------------------------- search

    def _index(self, at: str) -> lexical.KeywordIndex:
        t = lambda name: self.store.table(name, at)
        return lexical.KeywordIndex(t("postings"), t("doc_stats"), t("term_stats"), t("corpus_stats"))

    def search_many(self, queries: DataFrame, category: str | None = None, n: int = 8) -> DataFrame:
        """Results of many queries (query_id, query) in one plan."""
        at = self.store.current()
        if at is None:
            raise RuntimeError("the index is not built")
        t = lambda name: self.store.table(name, at)
        category, many = category or None, fusion.fetch_size(n)
        words = lexical.bm25_search(self._index(at), queries, many, category)
        if self.inverted and category is None and self.store.has("centres", at):
            near = self._near_in_cells(t("cells"), t("centres"), queries, many)
        else:
            near = hashed_near(t("embeddings"), queries, many, category) if self.embedder is None else dense_near(t("embeddings"), queries, self.embedder, many, category)
        return merge(words, near, t("chunks"), t("parents"), n, asked=queries.count())

    def _near_in_cells(self, cells: DataFrame, centres: DataFrame, queries: DataFrame, n: int) -> DataFrame:
        rows = centres.orderBy("cell").collect()  # MOST_CELLS rows at most
        known, probes = np.array([r["centre"] for r in rows]), max((r["probes"] for r in rows), default=1)
        if self.embedder is None:
            asked = hashed_queries(queries).select(F.col("id").alias("query_id"), "embedding")
            return vector_index.search(cells, known, asked, n, probes).where("score > 0")
        return vector_index.search(cells, known, embedding.embed(queries, self.embedder, "query", keep=["query_id"]), n, probes)

    def search(self, query: str, category: str | None = None, n: int = 8) -> DataFrame:
        return self.search_many(self.spark.createDataFrame([(0, query)], "query_id bigint, query string"), category, n).drop("query_id").orderBy("rank")

    def search_docs(self, query: str, category: str | None = None, n: int = 8) -> str:
        """Search as a tool: arguments are checked, results come as text."""
        valid = sorted(c.name for c in self.settings.categories)
        if category and category not in valid:
            return f"Invalid category '{category}'.\nValid options: {', '.join(valid)}\nUse list_categories() to see available categories with chunk counts."
        q = self.spark.createDataFrame([(0, query)], "query_id bigint, query string")
        found = self.search_many(q, category, fusion.wanted_results(n))
        return fusion.render_results(found, q, category=category).first()["rendered"]  # one row

    def list_categories(self) -> str:
        at = self.store.current()
        if at is None:
            return "Index not built yet."
        stats = self.store.table("category_stats", at)
        return maintenance.category_report(stats.select("category", "n"), stats.select("category", "ord", "description"), self.settings.project).first()["report"]

    def banner(self) -> str:
        """What this server searches, for its instructions."""
        listed = ", ".join(f"{c.name} ({c.description})" if c.description else c.name for c in self.settings.categories)
        return f"Searches the {self.settings.project}. Categories: {listed}."
