"""Queries of the training-text operators, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.llm import boilerplate, bpe, documented, mixing, neardup, quality, splitting, syntax
from lexmill.session import read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pairs(spark, d).select("file_id", "line_no")


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return documented.documented(read_table(spark, d, "source_files", spread=True), read_table(spark, d, "docstring_items", spread=True))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(read_table(spark, d, "chunks", spread=True), read_table(spark, d, "parents", spread=True), read_table(spark, d, "categories"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """size_limit 0 means none."""
    return splitting.corpus_pieces(read_table(spark, d, "chunks", spread=True), read_table(spark, d, "parents", spread=True), read_table(spark, d, "categories")).fillna(0, ["size_limit"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(read_table(spark, d, "chunks", spread=True)).select("id_a", "id_b")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(*neardup.class_pairs(read_table(spark, d, "chunks", spread=True)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.not_parsing(read_table(spark, d, "source_files", spread=True), read_table(spark, d, "docstring_items", spread=True))


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    return syntax.check_files(read_table(spark, d, "source_files", spread=True))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(read_table(spark, d, "source_files", spread=True), read_table(spark, d, "docstring_items", spread=True))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.furniture_lines(read_table(spark, d, "chunks", spread=True)).select("id", "line_no")


def p5_articles(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.articles(read_table(spark, d, "chunks", spread=True))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(read_table(spark, d, "documents", spread=True), keep=["doc_id"])


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the ids, which are the texts again; null ones come out empty."""
    return bpe.decode_column(p6_ids(spark, d), "ids", "text")


def p6_edited(spark: SparkSession, d: str) -> DataFrame:
    """Every text after an edit in its middle: are the ids taken over from before those of encoding it anew?"""
    return bpe.check_edits(read_table(spark, d, "documents", spread=True))


def p7_drawn(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read_table(spark, d, "documents", spread=True), read_table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read_table(spark, d, "documents", spread=True), read_table(spark, d, "mix_targets"))[1]


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """Of each target: its documents, how many were drawn more often than allowed or twice in a pass, and whether a source that is not exhausted misses its part by more than a document."""
    drawn, report = mixing.mix(read_table(spark, d, "documents", spread=True), read_table(spark, d, "mix_targets"))
    times = drawn.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("repeat_no").alias("passes"), F.max("n_tokens").alias("size"))
    times = times.join(F.broadcast(report.select("source", "max_repeats")), "source")  # a row for each target
    by = times.groupBy("source").agg(F.count_if(F.col("n") > F.col("max_repeats")).alias("too_often"), F.count_if(F.col("n") > F.col("passes")).alias("twice_in_a_pass"), F.max("size").alias("size"))
    report = report.join(F.broadcast(by), "source", "left").fillna(0, ["too_often", "twice_in_a_pass"])
    whole = Window.partitionBy()
    open_ = ~F.col("exhausted") & (F.col("target_share") > 0)
    wanted = F.col("target_share") / F.sum(F.when(open_, F.col("target_share"))).over(whole) * F.sum(F.when(open_, F.col("drawn_tokens"))).over(whole)
    missed = F.coalesce(open_ & (F.abs(F.col("drawn_tokens") - wanted) > F.col("size")), F.lit(False))
    return report.select("source", "n_documents", "max_repeats", "too_often", "twice_in_a_pass", missed.cast("int").alias("missed"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(read_table(spark, d, "documents", spread=True), keep=["doc_id"])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(p8_statistics(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_pairs": p1_pairs,
        "p2_found": p2_found,
        "p2_pieces": p2_pieces,
        "p3_found": p3_found,
        "p3_groups": p3_groups,
        "p4_found": p4_found,
        "p4_files": p4_files,
        "p4_rates": p4_rates,
        "p5_found": p5_found,
        "p5_articles": p5_articles,
        "p6_ids": p6_ids,
        "p6_decoded": p6_decoded,
        "p6_edited": p6_edited,
        "p7_drawn": p7_drawn,
        "p7_shares": p7_shares,
        "p7_limits": p7_limits,
        "p8_found": p8_found,
        "p8_statistics": p8_statistics,
    }


_LIMITS = """lim AS (
              SELECT category,
                CASE WHEN chunk_strategy <> 'whole_file' THEN CASE WHEN child_chunk_size > 0 THEN child_chunk_size WHEN chunk_size > 0 THEN chunk_size END END AS child,
                CASE WHEN child_chunk_size > 0 THEN child_overlap ELSE chunk_overlap END AS child_over,
                CASE WHEN chunk_strategy <> 'whole_file' AND chunk_size > 0 THEN chunk_size END AS parent, chunk_overlap AS parent_over
              FROM categories)"""


def _pieces_sql() -> str:
    """The cut of every item, one extract a step: the longest within the step that ends at the strongest boundary present."""
    ends = ("\\n[ \\t\\r]{0,8}\\n", "\\n", "(?:[.!?…][\"'')\\]]?[ \\t]|[。！？])", "(?:[,;:][ \\t]|[，；：、])", "[ \\t]")
    # A boundary may begin before the extract, so some characters before it are looked at as well.
    at = [f"length(regexp_extract(win, '(?s)^(.*{e})', 1)) - ctx" for e in ends]
    cut = f"CASE WHEN length(t) - a <= step THEN length(t) - a {' '.join(f'WHEN {x} >= least_ THEN {x}' for x in at)} ELSE step END"
    view = "least(a, 12) AS ctx, substr(t, a - least(a, 12) + 1, least(a, 12) + step) AS win"
    return f"""
            WITH RECURSIVE {_LIMITS},
            items AS (
              SELECT DISTINCT 'chunk' AS item_kind, id AS item_id, text AS t, child AS size_limit, child_over AS over FROM chunks LEFT JOIN lim USING (category) WHERE length(text) > 0
              UNION
              SELECT DISTINCT 'parent', parent_id, text, parent, parent_over FROM parents LEFT JOIN lim USING (category) WHERE length(text) > 0),
            sized AS (SELECT *, CASE WHEN size_limit > 0 THEN greatest(0, least(coalesce(over, 0), size_limit - 1)) ELSE 0 END AS o FROM items),
            steps AS (SELECT *, size_limit - o AS step, greatest(1, ceil((size_limit - o) / 2.0))::INT AS least_ FROM sized WHERE length(t) > size_limit),
            ext AS (
              SELECT item_kind, item_id, t, size_limit, o, step, least_, 0::BIGINT AS a, ({cut})::BIGINT AS n, 0 AS piece_no FROM (SELECT *, {view} FROM (SELECT *, 0::BIGINT AS a FROM steps))
              UNION ALL
              SELECT item_kind, item_id, t, size_limit, o, step, least_, a, ({cut})::BIGINT, piece_no FROM (SELECT *, {view} FROM (
                SELECT item_kind, item_id, t, size_limit, o, step, least_, a + n AS a, piece_no + 1 AS piece_no FROM ext WHERE a + n < length(t))))
            SELECT item_kind, item_id, piece_no, greatest(0, a - o)::INT AS start, substr(t, greatest(0, a - o) + 1, n + least(a, o)) AS piece, size_limit::INT AS size_limit FROM ext
            UNION ALL
            SELECT item_kind, item_id, 0, 0, t, coalesce(size_limit, 0)::INT FROM sized WHERE size_limit IS NULL OR length(t) <= size_limit"""


# All pairs that share a triple of words, by brute force.
_SIMILAR = r"""
            WITH RECURSIVE w AS (
              SELECT id, regexp_extract_all(lower(any_value(text)), '[\p{L}\p{N}_]+') AS ws FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id),
            s AS (
              SELECT DISTINCT id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
              FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 20)),
            n AS (SELECT id, count(*) AS n, list(g ORDER BY g) AS gs FROM s GROUP BY id),
            c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
            p AS (SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 10 * c >= 6 * (x.n + y.n - c))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"{_SIMILAR} SELECT * FROM p",
        "p3_groups": f"""{_SIMILAR},
            links AS (SELECT id_a AS id, id_b AS other FROM p UNION ALL SELECT id_b, id_a FROM p),
            cls AS (SELECT n.id, min(m.id) AS class_id FROM n JOIN n m USING (gs) GROUP BY n.id),
            reach AS (SELECT id, id AS other FROM links UNION SELECT r.id, b.other FROM reach r JOIN links b ON r.other = b.id),
            grp AS (SELECT id, min(other) AS first FROM reach GROUP BY id)
            SELECT b.id, any_value(k.class_id) AS class_id, any_value(f.class_id) AS group_id, count(*) AS n_links
            FROM links b JOIN cls k ON k.id = b.id JOIN grp ON grp.id = b.id JOIN cls f ON f.id = grp.first GROUP BY b.id""",
        "p6_edited": "SELECT doc_id, true AS equal FROM documents",
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p2_found": f"""
            WITH {_LIMITS}
            SELECT DISTINCT id AS item_id FROM chunks JOIN lim USING (category) WHERE length(text) > child
            UNION
            SELECT DISTINCT parent_id FROM parents JOIN lim USING (category) WHERE length(text) > parent""",
        "p2_pieces": _pieces_sql(),
        "p7_limits": """
            SELECT t.source, count(d.doc_id) AS n_documents, t.max_repeats, 0::BIGINT AS too_often, 0::BIGINT AS twice_in_a_pass, 0 AS missed
            FROM (SELECT lower(trim(source)) AS source, max(max_repeats) AS max_repeats FROM mix_targets GROUP BY 1) t
            LEFT JOIN documents d ON lower(trim(d.source)) = t.source AND length(d.text) > 0 GROUP BY t.source, t.max_repeats""",
    }
