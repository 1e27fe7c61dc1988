import sys

from pyspark.sql import functions as F

from lexmill.config import Category
from lexmill.functions import paths, text
from lexmill.operators import maintenance


def test_strip_equals_the_language_wide_definition_of_space(spark):
    odd = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["​", "﻿", "x"]
    df = spark.createDataFrame([(i, f"{c}a{c}b{c}") for i, c in enumerate(odd)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", text.strip("t").alias("s")).collect()}
    assert [got[i] for i in range(len(odd))] == [f"{c}a{c}b{c}".strip() for c in odd]


def test_decode(spark):
    df = spark.createDataFrame([(bytearray(b" a\r\nb\rc \xf0\x28"),)], "content binary")
    assert df.select(text.decode("content").alias("t")).first()["t"] == "a\nb\nc �("


def test_tokens(spark):
    df = spark.createDataFrame([("Größe_1 x-y  ÉTÉ 中文",), (None,)], "t string")
    assert [r[0] for r in df.select(text.tokens("t")).collect()] == [["größe_1", "x", "y", "été", "中文"], []]


def test_paths(spark):
    df = spark.createDataFrame([("docs/net/A.Tar.MD",), ("x.py",), ("other/y",)], "p string")
    cats = [Category("d", ("docs",)), Category("o", ("o",))]
    got = df.select(paths.base_name("p"), paths.suffix("p"), paths.module_label("p"), paths.detect_category("p", cats), paths.package_key("p", 2)).collect()
    assert [tuple(r) for r in got] == [("A.Tar.MD", ".md", "net", "d", "docs.net"), ("x.py", ".py", "", "o", "x"), ("y", "", "other", "o", "other.y")]
    df = spark.createDataFrame([("file:/data/root/a/b.md",), ("file:///elsewhere/c.md",)], "p string")
    assert [r[0] for r in df.select(paths.relative_path("p", "/data/root")).collect()] == ["a/b.md", "/elsewhere/c.md"]


def test_truncated(spark):
    df = spark.createDataFrame([("abcdef",), ("ab",)], "t string")
    assert [r[0] for r in df.select(text.truncated("t", 3, "!")).collect()] == ["abc!", "ab"]


def test_diff_and_changes(spark):
    ts = "timestamp'2024-01-01 00:00:00'"
    new = spark.sql(f"SELECT * FROM VALUES ('same', {ts}), ('near', {ts} + INTERVAL 0.9 SECOND), ('far', {ts} + INTERVAL 1 SECOND), ('added', {ts}), ('untimed', NULL) t(source_path, mtime)")
    old = spark.sql(f"SELECT * FROM VALUES ('same', {ts}), ('same', {ts} - INTERVAL 1 DAY), ('near', {ts}), ('far', {ts}), ('gone', {ts}), ('untimed', {ts}) t(source_path, mtime)")
    status = maintenance.diff(new, old)
    assert {r[0]: r[1] for r in status.collect()} == {"same": "unchanged", "near": "unchanged", "far": "modified", "added": "added", "gone": "deleted", "untimed": "modified"}
    stored = spark.createDataFrame([("same", 1), ("far", 2), ("gone", 3)], "source_path string, v int")
    fresh = spark.createDataFrame([("far", 9)], "source_path string, v int")
    assert sorted(r[1] for r in maintenance.apply_changes(stored, status, fresh).collect()) == [1, 9]


def test_last_wins_on_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 2, "x"), ("b", None, "y")], "k string, t int, v string")
    assert sorted(map(tuple, maintenance.last_wins(df, ["k"], "t").collect())) == [("a", 2, "x"), ("b", None, "y")]
    assert maintenance.last_wins(df.where(F.lit(False)), ["k"], "t").count() == 0


def test_nothing_in_the_core_imports_the_training_package(spark):
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "lexmill"
    users = [p for p in root.rglob("*.py") if "llm" not in p.parts and "lexmill.llm" in p.read_text("utf-8")]
    assert users == [] and sys.modules is not None
