import os
import shutil
import time

import pytest

from lexmill.config import Category, Settings
from lexmill.operators.embedding import HashingEmbedder
from lexmill.plans.engine import Engine
from lexmill.session import drop_written, materialize, shared_dir
from lexmill.sources.files import all_files, census, some_files
from lexmill.streaming.ingest import follow

TABLES = ("chunks", "parents", "postings", "doc_stats", "term_stats", "manifest", "category_stats")


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "data"
    for rel, text in {
        "docs/net/a.md": "# Title\nintro about routers\n## Setup\nplug the cable. then wait.\n## Use\nsend packets",
        "docs/net/b.MD": "## Upper\nsuffix in capitals",
        "docs/net/skip.txt": "not indexed",
        "docs/empty.md": "  \n ",
        "notes/n.txt": "whole note about packets\r\nsecond line",
    }.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    (root / "notes/bad.txt").write_bytes(b"broken \xff bytes")
    settings = Settings(
        (Category("docs", ("docs",), (".md",), "heading", 400, 100, True, "Manuals"), Category("notes", ("notes", "missing"), (".txt",), "whole_file", 0), Category("none", ("nowhere",))),
        str(root),
    )
    return root, settings, str(tmp_path / "index")


def contents(engine):
    out = {}
    for t in (*TABLES, "embeddings"):
        df = engine.store.table(t)
        out[t] = sorted(map(repr, df.select(*sorted(c for c in df.columns if c != "mtime")).toPandas().round(9).values.tolist()))
    return out


def test_files_are_read_as_text(spark, tree):
    _, settings, _ = tree
    got = {r["source_path"]: r for r in all_files(spark, settings).collect()}
    assert set(got) == {"docs/net/a.md", "docs/net/b.MD", "docs/empty.md", "notes/n.txt", "notes/bad.txt"}
    assert got["notes/n.txt"]["text"] == "whole note about packets\nsecond line"
    assert got["notes/bad.txt"]["text"] == "broken � bytes"
    assert got["docs/net/a.md"]["module"] == "net" and got["notes/n.txt"]["module"] == ""
    assert {r["category"]: r["n_files"] for r in census(spark, settings).collect()} == {"docs": 3, "notes": 2, "none": 0}


@pytest.mark.parametrize("embedder", [None, HashingEmbedder(64)])
def test_build_search_and_incremental_equals_full(spark, tree, embedder):
    root, settings, index = tree
    engine = Engine(spark, index, settings, embedder)
    assert engine.list_categories() == "Index not built yet." and not engine.store.is_ready()
    assert [m.rpartition("/")[2] for m in engine.verify()] == ["missing", "nowhere"]
    first = engine.build_incremental()  # no index yet: a full build
    assert first.mode == "full" and first.by_category == {"docs": 4, "notes": 2, "none": 0}
    assert "packets" in engine.search_docs("packets")
    assert engine.search_docs("packets", "bogus").startswith("Invalid category 'bogus'.")
    hit = engine.search("plug the cable", "docs", 1).first()
    assert hit["text"].startswith("## Setup") and hit["module"] == "net" and hit["parent_id"]
    assert "docs" in engine.list_categories() and "— Manuals" in engine.list_categories()

    old = time.time() + 60
    (root / "docs/net/a.md").write_text("## Setup\nnew words only")
    os.utime(root / "docs/net/a.md", (old, old))
    (root / "docs/net/b.MD").unlink()
    (root / "notes/new.txt").write_text("added later")
    (root / "notes/n.txt").write_text("  ")
    os.utime(root / "notes/n.txt", (old, old))
    done = engine.build_incremental()
    assert done.mode == "incremental" and done.by_category == {"docs": 1, "notes": 2, "none": 0}
    after = contents(engine)
    engine.build_full()
    assert contents(engine) == after
    if embedder is None:  # dense vectors always have a nearest neighbour
        assert engine.search_docs("routers").startswith("No results")


def test_changed_settings_force_a_full_build(spark, tree):
    root, settings, index = tree
    Engine(spark, index, settings).build_full()
    other = Settings((Category("docs", ("docs",), (".md",), "whole_file", 0),), str(root))
    assert Engine(spark, index, other).build_incremental().mode == "full"


def test_snapshots(spark, tree):
    _, settings, index = tree
    engine = Engine(spark, index, settings)
    for _ in range(3):
        engine.build_full()
    assert len(engine.store.drop_old(1)) == 2 and engine.store.is_ready()
    newest = engine.store.current()
    with open(f"{index}/published.999999999999999.gone", "w"):
        pass
    assert engine.store.current() == newest  # a pointer to nothing does not count
    shutil.rmtree(newest)
    assert engine.store.current() is None
    assert engine.reindex().startswith("Re-indexing complete. 6 total chunks.")


def test_a_reader_never_finds_the_index_gone_while_one_is_published(spark, tree):
    _, settings, index = tree
    engine = Engine(spark, index, settings)
    engine.build_full()
    first = engine.store.current()
    engine.store._put(engine.store._path("published.999999999999998.half"))  # a build that dies before its folder is there
    assert engine.store.current() == first
    engine.build_full()
    assert engine.store.current() != first


def test_an_empty_corpus_and_one_whose_files_all_went(spark, tree):
    root, settings, index = tree
    engine = Engine(spark, index, settings)
    engine.build_full()
    for f in [*root.rglob("*.md"), *root.rglob("*.MD"), *root.rglob("*.txt")]:
        f.unlink()
    assert engine.build_incremental().total == 0 and engine.build_full().total == 0 and not engine.store.is_ready()
    assert engine.search_docs("packets", "docs").startswith("No results found in category 'docs' for")


def test_categories_that_look_like_numbers(spark, tree):
    root, _, index = tree
    engine = Engine(spark, index, Settings((Category("1", ("notes",), (".txt",), "whole_file", 0),), str(root)))
    assert engine.build_full().by_category == {"1": 2}
    assert engine.search("packets", "1").first()["category"] == "1"


def test_only_changed_files_are_opened(spark, tree):
    root, settings, _ = tree
    wanted = spark.createDataFrame([("docs/net/a.md",), ("notes/n.txt",), ("notes/gone.txt",)], "source_path string")
    for most in (10, 1):
        got = some_files(spark, settings, wanted, most)
        assert {r["source_path"] for r in got.select("source_path").collect()} == {"docs/net/a.md", "notes/n.txt"}
    assert len(some_files(spark, settings, wanted).inputFiles()) == 2


def test_a_cluster_without_a_shared_folder_is_refused():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        shared_dir(Session)


def test_a_file_stream_drives_builds(spark, tree, tmp_path):
    root, settings, index = tree
    engine = Engine(spark, index, settings)
    q = follow(engine, str(root), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert engine.store.is_ready() and q.exception() is None


@pytest.mark.parametrize(
    "make",
    [
        lambda: Category("a", chunk_size=200),
        lambda: Category("a", chunk_size=0, child_chunk_size=300),
        lambda: Category("a", child_chunk_size=50),
        lambda: Category(""),
        lambda: Settings((Category("a", ("x",)), Category("b", ("x/y",)))),
        lambda: Settings((Category("a"), Category("a"))),
    ],
)
def test_bad_settings_are_refused(make):
    with pytest.raises(ValueError):
        make()


def test_both_kinds_of_vectors_find_a_text_by_its_words(spark, tree, tmp_path):
    _, settings, index = tree
    for k, embedder in enumerate((None, HashingEmbedder(64))):
        engine = Engine(spark, f"{index}{k}", settings, embedder)
        engine.build_full()
        assert engine.search("plug the cable. then wait.").first()["text"].startswith("## Setup")
    engine.store.export_json("manifest", str(tmp_path / "manifest"))
    assert spark.read.json(str(tmp_path / "manifest")).count() == 4


@pytest.mark.parametrize("embedder", [None, HashingEmbedder(64)])
def test_a_search_through_the_inverted_file(spark, tree, embedder):
    root, settings, index = tree
    for k in range(40):
        (root / f"notes/more{k}.txt").write_text(" ".join(f"word{(k * j) % 97}" for j in range(1, 30)))
    engine = Engine(spark, index, settings, embedder, inverted=True)
    engine.build_full()
    q = spark.createDataFrame([(1, "plug the cable. then wait."), (2, "word3 word6 word9 word12")], "query_id bigint, query string")
    exact = Engine(spark, index, settings, embedder).search_many(q, None, 3).collect()
    got = engine.search_many(q, None, 3).collect()
    assert [r["text"] for r in got if r["query_id"] == 1][0].startswith("## Setup")
    assert len({(r["query_id"], r["text"]) for r in got} & {(r["query_id"], r["text"]) for r in exact}) >= len(exact) - 1


def test_written_tables_can_be_dropped(spark):
    drop_written(spark)
    kept = materialize(spark.range(3), "x")
    assert kept.count() == 3 and drop_written(spark) == 1 and drop_written(spark) == 0


def test_many_small_files_are_few_tasks(spark, tmp_path):
    """Spark alone makes a task of every few files, however small they are."""
    for k in range(400):
        (tmp_path / f"{k} é%20#.md").write_text(f"## Part\ntext {k}\r\n")
    (tmp_path / "bytes.md").write_bytes(b"bad \xff")
    settings = Settings((Category("docs", ("",), (".md",), "heading", 400, 100, True),), str(tmp_path))
    files = all_files(spark, settings)
    assert files.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism  # those of the scan and of the empty table in front of it
    wanted = files.select("source_path").where("source_path NOT LIKE '1%'")
    got = some_files(spark, settings, wanted, 3)  # more than are opened by name
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, files.where("source_path NOT LIKE '1%'").collect()))


def test_words_of_unique_texts_are_counted_as_others(spark):
    from lexmill.operators import lexical

    df = spark.createDataFrame([("a", "x", "one two one"), ("b", None, "two"), ("c", "x", ""), ("d", "x", None)], "id string, category string, text string")
    own = lexical.postings(df, unique=True)
    assert sorted(map(tuple, own.collect()), key=repr) == sorted(map(tuple, lexical.postings(df).collect()), key=repr)
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
