"""SQL counterparts of the registered queries, for a second engine over the same tables."""

from __future__ import annotations

from lexmill.plans import cases

SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
LINE_SPACE = r"[\t\x0b-\r\x1c-\x20\x{85}\p{Z}]"
WORDS = r"[\p{L}\p{N}_]+"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _normal(x: str) -> str:
    return _strip(rf"regexp_replace({x}, '\r\n?', chr(10), 'g')")


_CORPUS = f"""
corpus AS (
  SELECT 'docs/' || coalesce(lower(trim(source)), 'none') || '/' || doc_id || '.md' AS source_path, {_normal('text')} AS text
  FROM documents WHERE text IS NOT NULL)"""


def _windows(name: str, src: str, key: str, size: int, overlap: int) -> str:
    """CTE ``name``(key, piece_no, text): sliding windows over ``src``(key, t)."""

    def stop(start: str) -> str:
        win = f"substr(t, {start} + 1, {size})"
        dot = f"(CASE WHEN contains({win}, '. ') THEN length(regexp_extract({win}, '(?s)^(.*)\\. ', 1)) ELSE -1 END)"
        line = f"(CASE WHEN contains({win}, chr(10)) THEN length(regexp_extract({win}, '(?s)^(.*)\\n', 1)) ELSE -1 END)"
        b = f"greatest({dot}, {line})"
        return f"CASE WHEN {start} + {size} >= length(t) THEN length(t) WHEN {b} > {overlap} THEN {start} + {b} + 1 ELSE {start} + {size} END"

    return f"""
{name}_r AS (
  SELECT {key}, t, 0::BIGINT AS a, ({stop('0')})::BIGINT AS b FROM {src}
  UNION ALL
  SELECT {key}, t, a2, ({stop('a2')})::BIGINT FROM (SELECT {key}, t, b - {overlap} AS a2 FROM {name}_r WHERE b < length(t))),
{name} AS (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY a) - 1 AS piece_no, text
  FROM (SELECT {key}, a, {_strip('substr(t, a + 1, b - a)')} AS text FROM {name}_r) WHERE length(text) > 0)"""


_SECTIONS = f"""
sections AS (
  SELECT source_path, row_number() OVER (PARTITION BY source_path ORDER BY n) AS section_no, text AS t FROM (
    SELECT source_path, generate_subscripts(parts, 1) AS n, {_strip('unnest(parts)')} AS text
    FROM (SELECT source_path, string_split(regexp_replace(text, '(?m)^(#{{2,3}} )', chr(57344) || '\\1', 'g'), chr(57344)) AS parts FROM corpus))
  WHERE length(text) > 0),
keyed AS (SELECT source_path || chr(57344) || section_no AS k, source_path, section_no, t FROM sections)"""

_HEADING = f"""{_CORPUS}, {_SECTIONS}, {_windows('win', 'keyed', 'k', 1200, 200)},
heading AS (
  SELECT k.source_path, row_number() OVER (PARTITION BY k.source_path ORDER BY k.section_no, w.piece_no) - 1 AS chunk_no, w.text
  FROM win w JOIN keyed k USING (k))"""

_STORE = "store AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) = 1)"

_TOKENS = f"""
tok AS (SELECT id, category, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term FROM store WHERE text IS NOT NULL),
post AS (SELECT id, category, term, count(*)::INT AS tf FROM tok GROUP BY ALL),
docs_ AS (SELECT id, category, len(regexp_extract_all(lower(text), '{WORDS}'))::INT AS dl FROM store WHERE text IS NOT NULL),
size_ AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM docs_),
raw_ AS (SELECT term, df, ln(n_docs - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS r FROM (SELECT term, count(*) AS df FROM post GROUP BY 1), size_),
mean_ AS (SELECT avg(r) AS avg_idf FROM raw_),
terms AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25::DOUBLE * avg_idf ELSE r END AS idf FROM raw_, mean_)"""

_INDEX = f"{_STORE},{_TOKENS}"

_STATED = "q AS (SELECT * FROM (VALUES (1::BIGINT, 'how to export the remote cache'), (2, 'cookie settings and the privacy policy'), (3, 'serial panel compiler epoch the the epoch')) v(query_id, query))"
_TITLES = "q AS (SELECT doc_id AS query_id, title AS query FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL)"


def _bm25(name: str, n: int, where: str = "") -> str:
    return f"""
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '{WORDS}')) AS term FROM q) GROUP BY ALL),
{name}_s AS (
  SELECT query_id, id, round(sum(idf * qtf * tf * (1.5::DOUBLE + 1) / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM post JOIN qt USING (term) JOIN terms USING (term) JOIN docs_ USING (id), size_ {where} GROUP BY ALL),
{name} AS (
  SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank
  FROM {name}_s WHERE score > 0 QUALIFY rank <= {n})"""


def _features(name: str, src: str, key: str, tf: str) -> str:
    return f"""
{name} AS (
  SELECT {key}, bucket, w FROM (
    SELECT {key}, (('0x' || substr(md5(term), 1, 6))::BIGINT % 64)::INT AS bucket, sum(CASE WHEN substr(md5(term), 7, 1) < '8' THEN 1 ELSE -1 END * {tf}) AS w
    FROM {src} GROUP BY ALL) WHERE w <> 0)"""


def _near(name: str, n: int, where: str = "") -> str:
    return f"""{_features('feat', f'post {where}', 'id', 'tf')}, {_features('qfeat', 'qt', 'query_id', 'qtf')},
{name} AS (
  SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM (
    SELECT query_id, id, round(dot / (norm * qnorm), 6) AS score
    FROM (SELECT query_id, id, sum(f.w * g.w)::DOUBLE AS dot FROM feat f JOIN qfeat g USING (bucket) GROUP BY ALL)
    JOIN (SELECT id, sqrt(sum(w * w)) AS norm FROM feat GROUP BY 1) USING (id)
    JOIN (SELECT query_id, sqrt(sum(w * w)) AS qnorm FROM qfeat GROUP BY 1) USING (query_id) WHERE dot > 0)
  WHERE score > 0 QUALIFY rank <= {n})"""


def _fused(n: int | None) -> str:
    limit = f"QUALIFY rank <= {n}" if n else ""
    return f"""
both_ AS (
  SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.rank AS ra, b.rank AS rb,
    coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS s
  FROM words_ a FULL JOIN near_ b ON a.query_id = b.query_id AND a.id = b.id),
fused AS (
  SELECT query_id, id, round(s, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ra NULLS LAST, rb))::INT AS rank
  FROM both_ {limit})"""


def _hybrid(n: int, category: str | None = None, keyword_only: bool = False, index: str = _INDEX) -> str:
    where = f"WHERE post.category = '{category}'" if category else ""
    many = min(3 * n, 30)
    near = "near_ AS (SELECT * FROM words_ WHERE false)" if keyword_only else _near("near_", many, where)
    return f"{index}, {_STATED}, {_bm25('words_', many, where)}, {near}, {_fused(n)}"


_RESULT = "query_id, rank, text, coalesce(category, '') AS category, coalesce(source, '') AS source, coalesce(source_path, '') AS source_path, coalesce(module, '') AS module"


def _cosine(n: int, queries: str, corpus: str = "true") -> str:
    return f"""
SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM (SELECT * FROM embeddings WHERE {queries}) a, (SELECT * FROM embeddings WHERE {corpus}) b)
QUALIFY rank <= {n}"""


_DIFF = f"""{_STORE},
cur AS (SELECT source_path, max(indexed_at) AS t FROM store GROUP BY 1),
old AS (SELECT source_path, max(mtime) AS t FROM manifest GROUP BY 1),
diff AS (
  SELECT source_path, CASE WHEN c.source_path IS NULL THEN 'deleted' WHEN o.source_path IS NULL THEN 'added'
    WHEN coalesce(abs(epoch_ms(c.t) - epoch_ms(o.t)) < 1000, false) THEN 'unchanged' ELSE 'modified' END AS status
  FROM cur c FULL JOIN old o USING (source_path))"""

_FOLDERS = "CASE WHEN source_path LIKE 'processed/docs/%' THEN 'docs' WHEN source_path LIKE 'processed/api/%' THEN 'api' WHEN source_path LIKE 'processed/guides/%' THEN 'guides' WHEN source_path LIKE 'processed/web/%' THEN 'web' WHEN source_path LIKE 'processed/faq/%' THEN 'faq' WHEN source_path LIKE 'processed/notes/%' THEN 'notes' WHEN source_path LIKE 'raw_data/examples/%' THEN 'examples' ELSE 'archive' END"


def _tidy(x: str) -> str:
    lines = rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g')"
    return f"{_strip(f'''regexp_replace({lines}, '(?m){LINE_SPACE}+$', '', 'g')''')} || chr(10)"


_ITEMS = "items AS (SELECT * FROM docstring_items QUALIFY row_number() OVER (PARTITION BY item_id) = 1)"
_ITEM_MD = """CASE lower(trim(kind))
    WHEN 'module' THEN chr(10) || '> *Source: `' || src || '`*' || repeat(chr(10), 3) || doc || chr(10)
    WHEN 'class' THEN chr(10) || '## `' || name || '`' || chr(10) || chr(10) || '*Source: `' || src || '`*' || chr(10) || CASE WHEN doc <> '' THEN chr(10) || chr(10) || doc || chr(10) ELSE '' END
    WHEN 'error' THEN chr(10) || '> **Parse error in `' || src || '`**: ' || doc || chr(10)
    WHEN 'function' THEN fm WHEN 'method' THEN fm END"""
_RENDERED = f"""{_ITEMS},
parts AS (SELECT *, string_split(source_file, '/')[-1] AS src, coalesce(docstring, '') AS doc, coalesce(signature, '') AS sig FROM items),
funcs AS (SELECT *, chr(10) || '### `' || name || '`' || chr(10) || CASE WHEN sig <> '' THEN chr(10) || '```python' || chr(10) || sig || chr(10) || '```' || chr(10) ELSE '' END
    || CASE WHEN doc <> '' THEN chr(10) || chr(10) || doc || chr(10) ELSE '' END AS fm FROM parts),
rendered AS (SELECT *, {_ITEM_MD} AS md FROM funcs)"""
_GROUP = "CASE WHEN len(string_split(source_file, '/')) >= 3 THEN array_to_string(string_split(source_file, '/')[1:3], '.') WHEN len(string_split(source_file, '/')) = 2 THEN array_to_string(string_split(source_file, '/'), '.') ELSE replace(source_file, '.py', '') END"


_RESOLVED = """
hit AS (
  SELECT query_id, rank, f.id, s.parent_id, s.text, coalesce(s.source_path, '') AS source_path, coalesce(s.source, '') AS source, coalesce(s.module, '') AS module, p.text AS ptext
  FROM fused f JOIN store s USING (id) LEFT JOIN (SELECT parent_id, max(text) AS text FROM parents GROUP BY 1) p ON s.parent_id = p.parent_id),
grp AS (
  SELECT query_id, CASE WHEN ptext IS NOT NULL THEN parent_id END AS parent_id, coalesce(CASE WHEN ptext IS NOT NULL THEN parent_id END, '#' || id) AS k, ptext IS NOT NULL AS isp, count(*) AS hits, min(rank) AS fr,
    arg_min(source_path, rank) AS source_path, arg_min(source, rank) AS source, arg_min(module, rank) AS module, arg_min(coalesce(ptext, text), rank) AS text FROM hit GROUP BY 1, 2, 3, 4)"""
_RANKED = "(row_number() OVER (PARTITION BY query_id ORDER BY isp DESC, CASE WHEN isp THEN hits END DESC NULLS LAST, fr))::INT"

# What an engine over the documents as files holds: parents by headings, children by windows.
_BUILT = f"""{_HEADING},
parents AS (SELECT md5(source_path || '|p' || chunk_no) AS parent_id, source_path, 'docs' AS category, text, source_path || '|p' || chunk_no AS pk FROM heading),
par AS (SELECT pk, text AS t FROM parents), {_windows('child', 'par', 'pk', 300, 50)},
store AS (
  SELECT md5(pk || '|c' || piece_no) AS id, source_path, string_split(source_path, '/')[-1] AS source, string_split(source_path, '/')[-2] AS module, 'docs' AS category, parent_id, c.text
  FROM child c JOIN parents USING (pk))"""


def _cases() -> dict[str, str]:
    chunks = f"WITH RECURSIVE {_BUILT} SELECT id, source_path, source, module, category, parent_id, text FROM store"
    usage = "chr(10) || chr(10) || 'Usage: search_docs(query, category=\"<name>\") to search within a category.'"
    return {
        "engine_full_build": chunks,
        "engine_incremental_build": chunks,
        "engine_parents": f"WITH RECURSIVE {_BUILT} SELECT parent_id, source_path, category, text FROM parents",
        "engine_manifest": f"WITH RECURSIVE {_BUILT} SELECT source_path, 'docs' AS category, count(*) AS n_chunks, list_sort(list(DISTINCT id)) AS chunk_ids, list_sort(list(DISTINCT parent_id)) AS parent_ids FROM store GROUP BY 1",
        "engine_search": f"WITH RECURSIVE {_hybrid(8, index=_BUILT + ',' + _TOKENS)}, {_RESOLVED} SELECT query_id, {_RANKED} AS rank, parent_id, hits, source_path, source, module, text FROM grp",
        "engine_report": f"""WITH RECURSIVE {_BUILT}, n AS (SELECT count(*) AS n FROM store)
            SELECT 'Index not built yet.' AS before, false AS ready_before, 'full' AS mode, n AS total, true AS ready,
              'knowledge base — ' || n || ' total chunks' || chr(10) || chr(10) || '  docs            ' || lpad(format('{{:,}}', n), 6, ' ') || ' chunks  — Manual pages' || {usage} AS report,
              'Invalid category ''nothing''.' || chr(10) || 'Valid options: docs' || chr(10) || 'Use list_categories() to see available categories with chunk counts.' AS refused,
              'Searches the knowledge base. Categories: docs (Manual pages).' AS banner FROM n""",
        "file_scan": cases.values([
            ("docs/net/a.md", "docs", "a.md", "net", 22, "# Title\nintro � end"), ("docs/net/B.MD", "docs", "B.MD", "net", 9, "upper"), ("docs/empty.md", "docs", "empty.md", "docs", 3, ""),
            ("more/deep/er/c.md", "docs", "c.md", "er", 12, "third\nfolder"), ("notes/n.txt", "notes", "n.txt", "", 11, "Grüße\u2028x"),
        ], "source_path, category, source, module, length, text").replace("SELECT *", "SELECT * REPLACE (length::BIGINT AS length)"),
        "file_census": cases.values([("docs", 4), ("notes", 1), ("none", 0)], "category, n_files").replace("SELECT *", "SELECT * REPLACE (n_files::BIGINT AS n_files)"),
        "missing_folders": cases.values([("missing",), ("nowhere",)], "folder"),
        "index_files": cases.values([("docs/net/a.md", "docs", 1), ("docs/net/B.MD", "docs", 1), ("more/deep/er/c.md", "docs", 1), ("notes/n.txt", "notes", 1)], "source_path, category, n_chunks").replace("SELECT *", "SELECT * REPLACE (n_chunks::BIGINT AS n_chunks)"),
        "html_cases": cases.values([(n, m) for n, _, _, m in cases.PAGES], "name, markdown"),
        "docstring_cases": cases.values([("lib/pkg.py", *x, k) for k, x in enumerate(cases.ITEMS)], "source_file, kind, name, signature, docstring, item_no"),
        "cli_clean_html": cases.values([("a/one.md", "# T\n\ntext\n"), ("two.md", "x\n")], "name, text"),
        "cli_docstrings": cases.values([
            ("a.b.m.py.md", "# a.b.m.py\n\n\n### `f`\n\n```python\ndef f(x)\n```\n\n\nDoes.\n"), ("a.b.c.md", "# a.b.c\n\n\n## `C`\n\n*Source: `n.py`*\n"), ("top.md", "# top\n\n\n### `g`\n\n```python\ndef g()\n```\n\n\nGoes.\n"),
        ], "name, text"),
        "cli_docstrings_flat": cases.values([("m.md", "# m\n\n\n### `f`\n\n```python\ndef f(x)\n```\n\n\nDoes.\n"), ("m.pyi.md", "# m.pyi\n\n\n### `f`\n\n```python\ndef f(x: int)\n```\n\n\nTyped.\n")], "name, text"),
        "search_sizes": "SELECT asked, greatest(1, least(asked, 15)) AS wanted, least(3 * greatest(1, least(asked, 15)), 30) AS fetched FROM (SELECT unnest([-3, 0, 1, 8, 10, 11, 15, 16, 1000])::INT AS asked)",
        "category_settings": "SELECT category, chunk_strategy = 'whole_file' OR coalesce(chunk_size, 0) = 0 AS whole, coalesce(child_chunk_size, 0) > 0 AS has_children, coalesce(module_field, false) AS module_field FROM categories",
        "flat_titles": "SELECT DISTINCT source_file, regexp_replace(source_file, '\\.py$', '') AS title, CASE WHEN contains(source_file, '/') THEN array_to_string(string_split(source_file, '/')[1:2], '.') ELSE replace(source_file, '.py', '') END AS group_key FROM docstring_items",
        "chunk_each_strategy": f"""WITH RECURSIVE {_HEADING},
            a AS (SELECT 'whole_file' AS strategy, text FROM corpus WHERE length(text) > 0 UNION ALL SELECT 'char', text FROM corpus WHERE length(text) > 0 UNION ALL SELECT 'heading', text FROM heading)
            SELECT strategy, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars FROM a GROUP BY 1""",
        "vector_index_exact": _cosine(20, "vec_id % 100 = 0"),
        "vector_index_recall": "SELECT 20 * count(*) AS n, true AS enough FROM embeddings WHERE vec_id % 100 = 0",
    }


def oracle_sql() -> dict[str, str]:
    hybrid_rows = f"SELECT {_RESULT} FROM fused JOIN store USING (id)"
    return {
        "strip_normalize_docs": f"WITH {_CORPUS} SELECT source_path, text FROM corpus",
        "chunk_heading_docs": f"WITH RECURSIVE {_HEADING} SELECT source_path, chunk_no::INT AS chunk_no, md5(source_path || '|' || chunk_no) AS id, text FROM heading",
        "chunk_char_docs_1200_200": f"WITH RECURSIVE {_CORPUS}, src AS (SELECT source_path, text AS t FROM corpus), {_windows('win', 'src', 'source_path', 1200, 200)} SELECT source_path, piece_no::INT AS chunk_no, text FROM win",
        "chunk_parents_docs": f"WITH RECURSIVE {_HEADING} SELECT source_path, chunk_no::INT AS parent_no, md5(source_path || '|p' || chunk_no) AS parent_id, text FROM heading",
        "chunk_children_docs_300_50": f"""WITH RECURSIVE {_HEADING},
            par AS (SELECT source_path || '|p' || chunk_no AS pk, source_path, chunk_no, text AS t FROM heading), {_windows('child', 'par', 'pk', 300, 50)}
            SELECT source_path, chunk_no::INT AS parent_no, piece_no::INT AS child_no, md5(pk) AS parent_id, md5(pk || '|c' || piece_no) AS id, c.text FROM child c JOIN par USING (pk)""",
        "chunk_whole_files": f"""SELECT file_id, source_path, 0 AS chunk_no, md5(source_path || '|0') AS id, text FROM (
            SELECT DISTINCT file_id, source_file AS source_path, {_normal('content')} AS text FROM source_files WHERE content IS NOT NULL) WHERE length(text) > 0""",
        "chunk_metadata": f"""WITH {_STORE}, c AS (SELECT id, string_split(source_path, '/') AS p, {_FOLDERS} AS category FROM store)
            SELECT id, p[-1] AS source, lower(regexp_extract(p[-1], '.(\\.[^.]+)$', 1)) AS suffix, CASE WHEN category IN ('docs', 'api', 'guides', 'faq', 'notes') AND len(p) > 1 THEN p[-2] ELSE '' END AS module, category FROM c""",
        "upsert_last_wins": f"WITH {_STORE} SELECT id, category, source_path, module, parent_id, coalesce(length(text), -1)::INT AS n_chars, indexed_at FROM store",
        "chunks_per_category": f"WITH {_STORE} SELECT category, count(*) AS n FROM store GROUP BY 1",
        "chunks_total_rollup": f"WITH {_STORE} SELECT category, count(*) AS n, grouping(category)::INT AS is_total FROM store GROUP BY ROLLUP (category)",
        "manifest_counts": "SELECT category, sum(coalesce(len(chunk_ids), 0))::BIGINT AS n FROM (SELECT * FROM manifest QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY mtime DESC) = 1) GROUP BY 1",
        "list_categories": f"""WITH {_STORE}, n AS (SELECT category, count(*) AS n FROM store GROUP BY 1),
            r AS (SELECT c.category, ord, coalesce(description, '') AS description, coalesce(n.n, 0) AS n FROM categories c LEFT JOIN n USING (category)),
            l AS (SELECT n, ord, '  ' || CASE WHEN length(category) >= 15 THEN category ELSE rpad(category, 15, ' ') END || ' ' || CASE WHEN length(format('{{:,}}', n)) >= 6 THEN format('{{:,}}', n) ELSE lpad(format('{{:,}}', n), 6, ' ') END || ' chunks' || CASE WHEN description <> '' THEN '  — ' || description ELSE '' END AS line FROM r)
            SELECT 'knowledge base — ' || sum(n)::BIGINT || ' total chunks' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY n DESC, ord) || chr(10) || chr(10) || 'Usage: search_docs(query, category="<name>") to search within a category.' AS report FROM l""",
        "tokenize_chunks": f"""WITH {_STORE}, w AS (SELECT id, regexp_extract_all(lower(text), '{WORDS}') AS ws FROM store WHERE text IS NOT NULL)
            SELECT id, (generate_subscripts(ws, 1) - 1)::INT AS pos, unnest(ws) AS term FROM w""",
        "postings_tf": f"WITH {_INDEX} SELECT id, term, tf, dl FROM post JOIN docs_ USING (id)",
        "doc_len": f"WITH {_INDEX} SELECT id, dl FROM docs_",
        "term_stats_idf": f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM terms",
        "corpus_stats": f"WITH {_INDEX} SELECT n_docs, round(avgdl, 6) AS avgdl, round(avg_idf, 6) AS avg_idf FROM size_, mean_",
        "bm25_topk": f"WITH {_INDEX}, {_STATED}, {_bm25('b', 20)} SELECT * FROM b",
        "bm25_topk_category": f"WITH {_INDEX}, {_STATED}, {_bm25('b', 20, '''WHERE post.category = 'guides' ''')} SELECT * FROM b",
        "bm25_topk_batch": f"WITH {_INDEX}, {_TITLES}, {_bm25('b', 20)} SELECT * FROM b",
        "vector_topk": _cosine(20, "vec_id = 0"),
        "vector_topk_category": _cosine(20, "vec_id = 0", "label = 3"),
        "vector_topk_batch": _cosine(20, "vec_id % 100 = 0"),
        "hashed_cosine_topk": f"WITH {_INDEX}, {_STATED}, {_bm25('words_', 24)}, {_near('near_', 24)} SELECT * FROM near_",
        "rrf_fuse": f"WITH {_INDEX}, {_STATED}, {_bm25('words_', 24)}, {_near('near_', 24)}, {_fused(None)} SELECT * FROM fused",
        "hybrid_search": f"WITH {_hybrid(8)} {hybrid_rows}",
        "hybrid_search_category": f"WITH {_hybrid(8, 'api')} {hybrid_rows}",
        "hybrid_lexical_only": f"WITH {_hybrid(8, keyword_only=True)} {hybrid_rows}",
        "resolve_parents": f"WITH {_hybrid(15, 'docs')}, {_RESOLVED} SELECT query_id, {_RANKED} AS rank, parent_id, hits, source_path, text FROM grp",
        "resolve_parents_all": f"WITH {_hybrid(15)}, {_RESOLVED} SELECT query_id, {_RANKED} AS rank, parent_id, hits, source_path, text FROM grp",
        "fetch_by_ids": f"WITH {_INDEX}, {_STATED}, {_bm25('b', 20)} SELECT id, {_RESULT} FROM b JOIN store USING (id)",
        "search_render": f"""WITH {_hybrid(8)}, r AS ({hybrid_rows}),
            e AS (SELECT query_id, rank, '--- Result ' || rank || ' | [' || category || ']' || CASE WHEN module <> '' THEN ' (' || module || ')' ELSE '' END || ' | ' || source || ' ---' || chr(10)
              || CASE WHEN length(text) > 2000 THEN left(text, 2000) || chr(10) || '... [truncated]' ELSE text END || chr(10) AS entry FROM r)
            SELECT query_id, 'Found ' || count(*) || ' result(s) for: "' || query || '"' || chr(10) || chr(10) || string_agg(entry, chr(10) ORDER BY rank) AS rendered FROM e JOIN q USING (query_id) GROUP BY query_id, query""",
        "manifest_build": f"""WITH {_STORE} SELECT source_path, min(category) AS category, count(*) AS n_chunks, list_sort(list(DISTINCT id)) AS chunk_ids,
            coalesce(list_sort(list(DISTINCT parent_id) FILTER (WHERE parent_id IS NOT NULL)), []::VARCHAR[]) AS parent_ids FROM store GROUP BY 1""",
        "manifest_diff": f"WITH {_DIFF} SELECT * FROM diff",
        "incremental_kept": f"WITH {_DIFF} SELECT id, source_path FROM store WHERE source_path NOT IN (SELECT source_path FROM diff WHERE status IN ('deleted', 'modified'))",
        "dangling_ids": "SELECT DISTINCT source_path, id FROM (SELECT source_path, unnest(chunk_ids) AS id FROM manifest) WHERE id NOT IN (SELECT id FROM chunks WHERE id IS NOT NULL)",
        "unlisted_files": "SELECT DISTINCT source_path FROM chunks WHERE source_path NOT IN (SELECT source_path FROM manifest)",
        "html_to_md": f"""SELECT doc_id, {_tidy(f'''repeat(chr(10), 2) || '# ' || {_strip("coalesce(title, 'untitled')")} || repeat(chr(10), 4) || {_normal('text')} || repeat(chr(10), 2) || chr(10) || '- ' || coalesce(trim(lang), 'none') || chr(10) || '- **' || doc_id || '**' || chr(10)''')} AS markdown
            FROM documents WHERE text IS NOT NULL""",
        "md_cleanup": f"SELECT doc_id, {_tidy('text')} AS markdown FROM documents WHERE text IS NOT NULL",
        "docstring_markdown": f"WITH {_RENDERED} SELECT item_id, md AS markdown FROM rendered",
        "package_group_key": f"SELECT DISTINCT source_file, {_GROUP} AS group_key FROM docstring_items",
        "docstring_modules": f"""WITH {_RENDERED}, g AS (SELECT *, {_GROUP} AS module FROM rendered WHERE md IS NOT NULL)
            SELECT module, count(*) AS n_items, count(*) FILTER (WHERE doc <> '') AS n_documented, '# ' || module || chr(10) || chr(10) || string_agg(md, chr(10) ORDER BY source_file, item_id) AS markdown FROM g GROUP BY module""",
    } | _cases()
