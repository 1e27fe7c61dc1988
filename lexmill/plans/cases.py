"""Registered queries that run the engine itself over files, and operators over small stated inputs.

The engine's files are the documents, written to the shared folder; what has
no table (pages, sources, odd files) is written down here with the result that
SQL states as values.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import cli
from lexmill.config import Category, Settings
from lexmill.functions import paths
from lexmill.operators import chunking, docstrings, fusion, html_markdown, vector, vector_index
from lexmill.plans.engine import Engine
from lexmill.session import materialize, read_table, scratch_path
from lexmill.sources import files as source_files

# ------------------------------------------------------------ engine over files


def _folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name).removeprefix("file://")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    source = F.coalesce(F.lower(F.trim("source")), F.lit("none"))
    docs = read_table(spark, d, "documents", spread=True).where("text IS NOT NULL")
    return docs.select("doc_id", F.concat(F.lit("docs/"), source, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), "text")


def _engine(spark: SparkSession, root: str) -> Engine:
    return Engine(spark, f"{root}/index", Settings((Category("docs", ("docs",), (".md",), "heading", 1200, 300, True, "Manual pages"),), root))


_BUILT: dict[tuple[str, str], Engine] = {}


def _built(spark: SparkSession, d: str) -> Engine:
    """The engine over all documents of a folder of tables as files; built once a session, as long as its files are there."""
    known = _BUILT.get((spark.sparkContext.applicationId, d))
    if known is not None and known.store.current() is not None:
        return known
    root = _folder(spark, "files")
    cli.write_texts(_documents(spark, d), root, "name", "text")
    engine = _BUILT[spark.sparkContext.applicationId, d] = _engine(spark, root)
    engine.build_full()
    return engine


def _chunks(engine: Engine) -> DataFrame:
    return engine.store.table("chunks").select("id", "source_path", "source", "module", "category", "parent_id", "text")


def engine_full_build(spark, d):
    """Chunks of the published index of all documents as files."""
    return _chunks(_built(spark, d))


def engine_incremental_build(spark, d):
    """The same chunks after an index of an older state was brought up to date: files added, changed and deleted."""
    root, docs = _folder(spark, "files"), _documents(spark, d)
    kind = F.col("doc_id") % 10
    older = docs.where(kind != 3).withColumn("text", F.when((kind == 4) & (F.length(F.trim("text")) > 0), F.concat(F.lit("older "), "text")).otherwise(F.col("text")))
    gone = docs.where(kind == 5).withColumn("name", F.concat(F.lit("docs/gone/"), F.col("doc_id").cast("string"), F.lit(".md")))
    cli.write_texts(older.unionByName(gone), root, "name", "text")
    engine = _engine(spark, root)
    engine.build_full()
    time.sleep(1.5)  # times less than a second apart count as the same
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/docs/gone")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    cli.write_texts(docs.where(kind.isin(3, 4)), root, "name", "text")
    if engine.build_incremental().mode != "incremental":
        raise RuntimeError("the index was built anew")
    return _chunks(engine)


def engine_parents(spark, d):
    return _built(spark, d).store.table("parents").select("parent_id", "source_path", "category", "text")


def engine_manifest(spark, d):
    return _built(spark, d).store.table("manifest").select("source_path", "category", "n_chunks", "chunk_ids", "parent_ids")


def engine_search(spark, d):
    """The stated queries against the built index, without category, hits lifted to their parents; in a session that has the index only the search."""
    from lexmill.plans.queries import stated

    return _built(spark, d).search_many(stated(spark), None, 8).select("query_id", "rank", "parent_id", "hits", "source_path", "source", "module", "text")


def engine_report(spark, d):
    """What the engine says of itself before and after a build."""
    root = _folder(spark, "files")
    cli.write_texts(_documents(spark, d), root, "name", "text")
    engine = _engine(spark, root)
    before = (engine.list_categories(), engine.store.is_ready())
    done = engine.build_incremental()
    asked = engine.search_docs("copy", "nothing")
    rows = [(before[0], before[1], done.mode, done.total, engine.store.is_ready(), engine.list_categories(), asked, engine.banner())]
    return spark.createDataFrame(rows, "before string, ready_before boolean, mode string, total bigint, ready boolean, report string, refused string, banner string")


# ----------------------------------------------------------------- stated inputs

SMALL_FILES = {
    "docs/net/a.md": b"# Title\r\nintro \xff end\r\n",
    "docs/net/B.MD": b"  upper  ",
    "docs/skip.txt": b"not asked for",
    "docs/empty.md": b" \n ",
    "more/deep/er/c.md": b"third\rfolder",
    "notes/n.txt": "Grüße x".encode(),
}
SMALL_SETTINGS = (Category("docs", ("docs", "more", "missing"), (".md",), "heading", 400, 100, True), Category("notes", ("notes",), (".txt",), "whole_file", 0), Category("none", ("nowhere",)))


def _small(spark: SparkSession) -> Settings:
    root = _folder(spark, "small")
    for name, content in SMALL_FILES.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(content))
        out.close()
    return Settings(SMALL_SETTINGS, root)


def file_scan(spark, d):
    return source_files.all_files(spark, _small(spark)).select("source_path", "category", "source", "module", "length", "text")


def file_census(spark, d):
    return source_files.census(spark, _small(spark))


def missing_folders(spark, d):
    s = _small(spark)
    return spark.createDataFrame([(m.removeprefix(s.data_root + "/"),) for m in source_files.missing_folders(spark, s)], "folder string")


def index_files(spark, d):
    """A build over the odd files, and its tables written as JSON and read again."""
    s = _small(spark)
    engine = Engine(spark, f"{s.data_root}-index", s)
    engine.build_full()
    folder = _folder(spark, "json")
    engine.store.export_json("manifest", folder)
    return spark.read.json(folder).select("source_path", "category", "n_chunks")


PAGES = [
    ("dialect madcap", "madcap", '<body><div id="mc-main-content"><p>mc</p></div><div class="document"><p>doc</p></div></body>', "mc\n"),
    ("dialect sphinx", "sphinx", '<body><div id="mc-main-content"><p>mc</p></div><div class="document"><p>doc</p></div></body>', "doc\n"),
    ("sphinx main before body", "sphinx", '<body><div class="body">b</div><div role="main">m</div></body>', "m\n"),
    ("auto by generator", "auto", '<html><head><meta name="generator" content="MadCap Flare"></head><body><div id="mc-main-content">x</div><p>all</body></html>', "x\n\nall\n"),
    ("auto by class", "auto", '<body><div class="MCBody"><p>m</p></div>rest</body>', "m\n"),
    ("auto else", "auto", '<body><div role="main"><p>yes</p></div><p>no</p></body>', "yes\n"),
    ("headings", "auto", "<body><h1>a</h1><h4> b </h4><h6>c</h6></body>", "# a\n\n#### b\n\n###### c\n"),
    ("code", "auto", '<body><pre><code class="language-py">a\n  b\n</code></pre><p><code>c</code></p></body>', "```py\na\n  b\n```\n\n`c`\n"),
    ("plain pre", "auto", "<body><pre>x &lt; y\n</pre></body>", "```\nx < y\n```\n"),
    ("table", "auto", "<body><table><tr><th>x<th>y<tr><td>1<td>a<br>b</table></body>", "| x | y |\n|---|---|\n| 1 | a b |\n"),
    ("lists", "auto", "<body><ul><li>a<li><b>b</b></ul><ol><li>x<li> <li>z</ol></body>", "- a\n- **b**\n\n1. x\n3. z\n"),
    ("nested list", "auto", "<body><ul><li>a<ul><li>b</li></ul></li><li>c</li></ul></body>", "- a\n- b\n- c\n"),
    ("emphasis and links", "auto", '<body><p><em>e</em> <strong>s</strong> <a href="u">link</a></p><hr><p>z</p></body>', "*e* **s** link\n\n---\n\nz\n"),
    ("dropped", "auto", '<body><nav>n</nav><script>s</script><style>t</style><!-- c --><p>keep &amp; &copy;</p><div class="sidenav">no</div><footer>f</footer></body>', "keep & ©\n"),
    ("open tags", "auto", "<body><p><b>bold.<br><p>next</body>", "**bold.**\n\nnext\n"),
    ("blank lines", "auto", "<body><p>a</p>\n\n\n\n<p>b   </p></body>", "a\n\nb\n"),
    ("deep", "auto", f"<body>{'<div>' * 5000}deep</body>", "deep\n"),
]


def html_cases(spark, d):
    """Pages of each dialect as Markdown."""
    made = None
    for dialect in ("auto", "madcap", "sphinx"):
        pages = spark.createDataFrame([(n, h) for n, x, h, _ in PAGES if x == dialect], "name string, html string")
        one = html_markdown.convert(pages, dialect=dialect)
        made = one if made is None else made.unionByName(one)
    return made


SOURCE = '''"""Module text."""
class A(Base):
    """Class."""
    async def run(self, a, b: int = 2, /, c=3, *args, d, e: str = "x", **kw) -> bool:
        """Run it."""
        def inner(): pass
    def _hidden(self): pass
    def _told(self):
        "told"
def f(*, k): ...
'''
ITEMS = [
    ("module", "pkg", "", "Module text."), ("class", "A", "class A", "Class."),
    ("method", "A.run", "async def run(self, a, b: int = 2, /, c = 3, *args, d, e: str = 'x', **kw) -> bool", "Run it."), ("method", "A._told", "def _told(self)", "told"),
    ("function", "f", "def f(*, k)", ""), ("function", "run", "async def run(self, a, b: int = 2, /, c = 3, *args, d, e: str = 'x', **kw) -> bool", "Run it."),
    ("function", "_told", "def _told(self)", "told"), ("function", "inner", "def inner()", ""),
]


def docstring_cases(spark, d):
    """Items of a stated source, private ones without text left out, methods listed twice."""
    files = spark.createDataFrame([("lib/pkg.py", SOURCE), ("lib/note.txt", "def g(): pass"), ("lib/none.pyi", None)], "source_file string, content string")
    return docstrings.extract(files)


def _ran(spark: SparkSession, argv: list[str], inputs: dict[str, str]) -> DataFrame:
    """File names and texts that a command of the command line wrote."""
    given, out = _folder(spark, "given"), _folder(spark, "made")
    cli.write_texts(spark.createDataFrame(list(inputs.items()), "name string, text string"), given, "name", "text")
    if cli.main([*argv, "-i", given, "-o", out]) != 0:
        raise RuntimeError("the command failed")
    return source_files.binary_files(spark, out, ".md").select(F.col("source_file").alias("name"), F.col("content").alias("text"))


def cli_clean_html(spark, d):
    return _ran(spark, ["clean-html", "-f", "sphinx"], {"a/one.html": '<body><div role="main"><h1>T</h1>text</div></body>', "two.HTML": "<body><p>x</p></body>", "empty.txt": "<p>no</p>"})


def cli_docstrings(spark, d):
    return _ran(spark, ["extract-docstrings"], {"a/b/m.py": 'def f(x):\n    "Does."\n', "a/b/c/n.py": "class C: pass\n", "top.py": 'def g():\n    "Goes."\n'})


def cli_docstrings_flat(spark, d):
    return _ran(spark, ["extract-docstrings", "--flat"], {"m.py": 'def f(x):\n    "Does."\n', "m.pyi": 'def f(x: int):\n    "Typed."\n'})


def search_sizes(spark, d):
    """Wanted and fetched results for what a caller may ask."""
    asked = [-3, 0, 1, 8, 10, 11, 15, 16, 1000]
    return spark.createDataFrame([(n, fusion.wanted_results(n), fusion.fetch_size(fusion.wanted_results(n))) for n in asked], "asked int, wanted int, fetched int")


def category_settings(spark, d):
    """Settings of the categories table as they dispatch: whole files, flat chunks or parents with children."""
    rows = read_table(spark, d, "categories").collect()  # a row for each configured category
    made = [Category(r["category"], (), (".md",), r["chunk_strategy"], r["chunk_size"] or 0, r["child_chunk_size"] or 0, bool(r["module_field"]), chunk_overlap=r["chunk_overlap"] or 0, child_overlap=r["child_overlap"] or 0) for r in rows]
    return spark.createDataFrame([(c.name, c.whole, c.has_children, c.module_field) for c in made], "category string, whole boolean, has_children boolean, module_field boolean")


def flat_titles(spark, d):
    """Names of the items' files as single pages."""
    items = read_table(spark, d, "docstring_items").select("source_file").distinct()
    return items.select("source_file", F.regexp_replace("source_file", r"\.py$", "").alias("title"), paths.package_key("source_file", 2).alias("group_key"))


def chunk_each_strategy(spark, d):
    """The categories' strategies side by side over the documents: chunks and their characters."""
    from lexmill.plans.queries import corpus

    docs, out = corpus(spark, d), None
    for strategy, size in (("whole_file", 0), ("heading", 1200), ("char", 0)):
        one = chunking.explode_flat(docs, strategy, size, 200).select(F.lit(strategy).alias("strategy"), "source_path", "chunk_no", "text")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("strategy").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


# ------------------------------------------------------------------ vector index


def _inverted(spark, d):
    from lexmill.plans.queries import TOP, _vector_queries, _vectors

    rows = _vectors(spark, d)
    centres = vector_index.fit_centres(rows)
    placed = materialize(vector_index.assign(rows, centres), "placed")
    index = materialize(vector_index.packed(placed), "cells")
    q = _vector_queries(spark, d, "id % 100 = 0")
    probes = vector_index.probes_for(placed, centres, TOP)
    return rows, q, vector_index.search(index, centres, q, TOP, probes), TOP, len(centres), vector_index.search(index, centres, q, TOP, max(1, len(centres)))


def vector_index_topk(spark, d):
    """The batch of vector searches from the inverted file, with as many cells opened as a sample needs for 95 %."""
    return _inverted(spark, d)[2]


def vector_index_exact(spark, d):
    """The same with all cells opened, which is exact."""
    return _inverted(spark, d)[5]


def vector_index_recall(spark, d):
    """Does the inverted file find at least nine tenths of what all vectors give?"""
    rows, q, found, n, _, _ = _inverted(spark, d)
    exact = vector.cosine_topk(rows, q, n).select("query_id", "id", F.lit(1).alias("hit"))
    both = exact.join(found.select("query_id", "id", F.lit(1).alias("got")), ["query_id", "id"], "left")
    return both.agg(F.count("*").alias("n"), (F.sum("got") >= 0.9 * F.count("*")).alias("enough"))


_ALL = [
    engine_full_build, engine_incremental_build, engine_parents, engine_manifest, engine_search, engine_report, file_scan, file_census, missing_folders, index_files, html_cases, docstring_cases,
    cli_clean_html, cli_docstrings, cli_docstrings_flat, search_sizes, category_settings, flat_titles, chunk_each_strategy, vector_index_topk, vector_index_exact, vector_index_recall,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def text_literal(x: str) -> str:
    """A text as SQL, control characters spelled out."""
    parts = x.replace("'", "''").split("\n")
    return "(" + " || chr(10) || ".join(f"'{p}'" for p in parts) + ")"


def values(rows: list[tuple], names: str) -> str:
    shown = lambda x: "NULL" if x is None else text_literal(x) if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) v({names})"
