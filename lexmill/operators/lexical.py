"""Keyword index and BM25 ranking.

The index is four tables.  Statistics are always those of the whole corpus;
a category filter only narrows which postings are scored.  A term in more than
half of the documents would weigh negatively; such terms get ``epsilon`` times
the mean weight of the vocabulary instead.  A query word counts as often as it
occurs.  Scores are rounded before ranking and ties go to the smaller id, so
that the order does not depend on the plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions.arrays import let
from lexmill.functions.text import tokens
from lexmill.session import materialize

# Fixed values of the ranking formula.
K1, B, EPSILON = 1.5, 0.75, 0.25
DIGITS = 6
#: Texts whose words are counted at once.
TEXTS = 2048


@dataclass
class KeywordIndex:
    postings: DataFrame  # term, id, category, tf, dl
    doc_stats: DataFrame  # id, category, dl
    term_stats: DataFrame  # term, df, idf
    corpus_stats: DataFrame  # n_docs, avgdl, avg_idf: one row


def postings(chunks: DataFrame, id_column: str = "id", text: str = "text", unique: bool = False) -> DataFrame:
    """term, id, category, tf, dl: exploded tokens counted, with partial sums before the shuffle; dl is the text's number of tokens.

    Where no id has two rows (``unique``) each text is counted by itself, without a shuffle.
    """
    if unique:
        id_type = chunks.schema[id_column].dataType.simpleString()
        own = chunks.select(F.col(id_column).alias("id"), F.col("category").cast("string").alias("category"), tokens(text).alias("words"))
        return own.mapInArrow(_count_words, f"term string, id {id_type}, category string, tf int, dl int")
    # The length goes along with each token, so that the texts are taken apart once.
    sized = let(tokens(text), lambda t: F.transform(t, lambda x: F.struct(x.alias("term"), F.size(t).alias("dl"))))
    found = chunks.select(F.col(id_column).alias("id"), "category", F.explode_outer(sized).alias("x")).where("x IS NOT NULL")
    return found.groupBy("id", "category", F.col("x.term").alias("term"), F.col("x.dl").alias("dl")).agg(F.count("*").cast("int").alias("tf")).select("term", "id", "category", "tf", "dl")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS):
            b = whole.slice(at, TEXTS)
            lengths = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int32)
            words = b.column(2).flatten().dictionary_encode()
            n = max(1, len(words.dictionary))
            key, tf = np.unique(np.repeat(np.arange(b.num_rows), lengths) * n + words.indices.to_numpy(), return_counts=True)
            text = key // n
            columns = [words.dictionary.take(pa.array(key % n)), b.column(0).take(pa.array(text)), b.column(1).take(pa.array(text)), pa.array(tf.astype(np.int32)), pa.array(lengths[text])]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "id", "category", "tf", "dl"])


def document_lengths(chunks: DataFrame, id_column: str = "id", text: str = "text") -> DataFrame:
    return chunks.select(F.col(id_column).alias("id"), "category", F.size(tokens(text)).alias("dl"))


def corpus_size(doc_stats: DataFrame) -> DataFrame:
    return doc_stats.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def term_statistics(posting: DataFrame, size: DataFrame, epsilon: float = EPSILON) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) and the one-row corpus statistics."""
    return weigh_terms(posting.groupBy("term").agg(F.count("*").alias("df")), size, epsilon)


def weigh_terms(df: DataFrame, size: DataFrame, epsilon: float = EPSILON) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) of (term, df), and the one-row corpus statistics."""
    raw = df.crossJoin(F.broadcast(size)).withColumn("raw_idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = raw.agg(F.avg("raw_idf").alias("avg_idf"))
    stats = size.crossJoin(mean)
    idf = F.when(F.col("raw_idf") < 0, F.lit(epsilon) * F.col("avg_idf")).otherwise(F.col("raw_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf")), stats


def build_index(chunks: DataFrame, id_column: str = "id", text: str = "text", epsilon: float = EPSILON, written: bool = True) -> KeywordIndex:
    """The index of ``chunks``; tables that others are made from are ``written`` once, so texts are read twice in all."""
    keep = materialize if written else lambda df, _: df
    posting = keep(postings(chunks, id_column, text), "postings")
    lengths = keep(document_lengths(chunks, id_column, text), "lengths")
    terms, corpus = term_statistics(posting, corpus_size(lengths), epsilon)
    corpus = keep(corpus, "corpus")
    return KeywordIndex(posting, lengths, terms, corpus)


def query_terms(queries: DataFrame, text: str = "query") -> DataFrame:
    """query_id, term, qtf: words of each query with how often they occur."""
    return queries.select("query_id", F.explode(tokens(text)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(index: KeywordIndex, queries: DataFrame, category: str | Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, id, score of every chunk that shares a weighted term with a query."""
    scored = index.postings
    if category is not None:
        scored = scored.where(F.col("category") == category)
    weight = query_terms(queries).join(index.term_stats.select("term", "idf"), "term")
    # Postings carry the lengths: what matches a query is not shuffled again to fetch them.
    hits = scored.join(weight, "term").crossJoin(F.broadcast(index.corpus_stats.select("avgdl")))
    part = F.col("idf") * F.col("qtf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "id").agg(F.round(F.sum(part), DIGITS).alias("score")).where("score > 0")


def rank(scored: DataFrame, n: int, descending: bool = True) -> DataFrame:
    """query_id, id, score, rank (from 1) of the best ``n`` of each query."""
    order = F.col("score").desc() if descending else F.col("score").asc()
    # Spark prunes to n rows a query before the shuffle (window group limit).
    w = Window.partitionBy("query_id").orderBy(order, "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("query_id", "id", "score", "rank")


def bm25_search(index: KeywordIndex, queries: DataFrame, n: int = 20, category: str | Column | None = None) -> DataFrame:
    return rank(bm25_scores(index, queries, category), n)
