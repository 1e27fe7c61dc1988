"""Command line: build, search, categories, clean-html, extract-docstrings."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.config import Category, Settings
from lexmill.functions.paths import package_key
from lexmill.operators import docstrings, html_markdown
from lexmill.plans.engine import Engine
from lexmill.sources.files import binary_files


def load_settings(path: str) -> Settings:
    raw = json.loads(Path(path).read_text("utf-8"))
    cats = tuple(Category(name=k, **{a: tuple(b) if isinstance(b, list) else b for a, b in v.items()}) for k, v in raw["categories"].items())
    return Settings(cats, raw.get("data_root", ""), raw.get("project", "knowledge base"))


def write_texts(df: DataFrame, folder: str, name: str, text: str) -> int:
    """Each row as a file of a folder that all executors reach; tasks write on their own, blank texts are left out.

    The folder's file system is that of its scheme, or the session's default; a task that runs again writes the same files.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri

    def run(frames):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(uri)
        for f in frames:
            for own, content in zip(f[name], f[text]):
                target = f"{root}/{own}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(content.encode())
            yield f[[name]].agg(["count"]).rename(columns={name: "n"})

    kept = df.select(name, text).where(F.length(F.trim(text)) > 0)
    return kept.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="lexmill", description=__doc__)
    sub = ap.add_subparsers(dest="command", required=True)
    for name in ("build", "search", "categories"):
        p = sub.add_parser(name)
        p.add_argument("--settings", required=True)
        p.add_argument("--index", required=True)
        if name == "build":
            p.add_argument("--incremental", action="store_true")
        if name == "search":
            p.add_argument("query")
            p.add_argument("--category")
            p.add_argument("-n", type=int, default=8)
    p = sub.add_parser("clean-html")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-f", "--format", choices=("madcap", "sphinx", "auto"), default="auto")
    p = sub.add_parser("extract-docstrings")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--flat", action="store_true")
    p.add_argument("--group-depth", type=int, default=3)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("lexmill").getOrCreate()

    if a.command in ("build", "search", "categories"):
        engine = Engine(spark, a.index, load_settings(a.settings))
        if a.command == "search":
            print(engine.search_docs(a.query, a.category, a.n))
        elif a.command == "categories":
            print(engine.list_categories())
        else:
            if missing := engine.verify():
                print("Missing folders:\n" + "\n".join(f"  {m}" for m in missing), file=sys.stderr)
                return 1
            for r in engine.census().collect():
                print(f"  {r['category']}: {r['n_files']} files")
            began = time.time()
            done = engine.build_incremental() if a.incremental else engine.build_full()
            print(f"{done.mode} build: {done.total} chunks in {time.time() - began:.1f} s")
            for c, n in done.by_category.items():
                print(f"  {c}: {n:,} chunks")
        return 0
    if a.command == "clean-html":
        pages = html_markdown.convert(binary_files(spark, a.input, ".html"), "content", "markdown", a.format)
        n = write_texts(pages.withColumn("name", F.regexp_replace("source_file", r"\.[^.]*$", ".md")), a.output, "name", "markdown")
    else:
        items = docstrings.extract(binary_files(spark, a.input, ".py", ".pyi"))
        # One output for each file or package; the suffix keeps a.py and a.pyi apart.
        group = F.regexp_replace("source_file", r"\.py$", "") if a.flat else package_key("source_file", a.group_depth)
        docs = docstrings.module_markdown(items.withColumn("module", group), "module", ["source_file", "item_no"])
        n = write_texts(docs.withColumn("name", F.concat("module", F.lit(".md"))), a.output, "name", "markdown")
    print(f"{n} .md files written")
    return 0


if __name__ == "__main__":
    sys.exit(main())
