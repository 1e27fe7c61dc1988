"""Folders of files as DataFrames."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.config import Category, Settings
from lexmill.functions.paths import base_name, module_label, relative_path, suffix
from lexmill.functions.text import decode

#: Most files whose names are gathered by the driver; beyond it tasks open the files they are given.
MOST_PATHS = 10_000
#: Bytes of files that one task reads. Spark counts each file as 4 MB at least, so that small files would be a task for every few.
TASK_BYTES = 8 << 20
#: Bytes of contents that a task hands on at once.
BATCH_BYTES = 8 << 20
FILE_SCHEMA = "path string, source_path string, mtime timestamp, length bigint, category string, source string, module string, text string"


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def missing_folders(spark: SparkSession, settings: Settings) -> list[str]:
    return [p for c in settings.categories for p in c.paths if not _exists(spark, _absolute(p, settings))]


def _absolute(path: str, settings: Settings) -> str:
    return path if path.startswith("/") or "://" in path else f"{settings.data_root.rstrip('/')}/{path}"


def _rows(raw: DataFrame, settings: Settings, category: Category) -> DataFrame:
    path = relative_path("path", settings.data_root)
    return (
        raw.where(suffix("path").isin(*category.extensions))
        .select("path", path.alias("source_path"), F.col("modificationTime").alias("mtime"), "length", "content")
        .select(
            "path",
            "source_path",
            "mtime",
            "length",
            F.lit(category.name).alias("category"),
            base_name("source_path").alias("source"),
            module_label("source_path", category.module_field).alias("module"),
            decode("content").alias("text"),
        )
    )


def _raw(spark: SparkSession, paths: list[str]) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    size = int(str(raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return raw.coalesce(max(spark.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES)))


def _contents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (path, modificationTime, length) with the content of the file."""
    from pyarrow import fs

    systems = {"file": (fs.LocalFileSystem(), "")}
    for f in frames:
        group = (f["length"].cumsum() // BATCH_BYTES).to_numpy()
        for _, part in f.groupby(group):
            content = []
            for path in part["path"]:
                scheme, host, own = re.match(r"(?s)(?:([\w+.-]+):(?://([^/]*))?)?(.*)", path).groups()
                key = "file" if scheme in (None, "file") else f"{scheme}://{host or ''}/"
                if key not in systems:
                    system, root = fs.FileSystem.from_uri(key)
                    systems[key] = system, root.rstrip("/")
                system, root = systems[key]
                with system.open_input_stream(root + own, compression=None) as file:
                    content.append(file.read())
            yield part.assign(content=content)


def category_files(spark: SparkSession, settings: Settings, category: Category) -> DataFrame:
    """Files of a category; only suffixes that are asked for, folders that do not exist give none."""
    folders = [q for p in category.paths if _exists(spark, q := _absolute(p, settings))]
    return _rows(_raw(spark, folders), settings, category) if folders else spark.createDataFrame([], FILE_SCHEMA)


def all_files(spark: SparkSession, settings: Settings) -> DataFrame:
    """Where only names and times are selected, no content is read."""
    return reduce(DataFrame.unionByName, [category_files(spark, settings, c) for c in settings.categories], spark.createDataFrame([], FILE_SCHEMA))


def some_files(spark: SparkSession, settings: Settings, wanted: DataFrame, most: int = MOST_PATHS) -> DataFrame:
    """The files whose source_path is among ``wanted``, and no others, are opened: up to ``most`` by name, more by the tasks they are dealt to."""
    listed = all_files(spark, settings).select("source_path", "path", "category", "mtime", "length").join(wanted.select("source_path").distinct(), "source_path")
    rows = listed.select("path", "category").limit(most + 1).collect()  # names of files, most + 1 of them
    if len(rows) > most:
        dealt = listed.select("path", "category", F.col("mtime").alias("modificationTime"), "length").repartition(8 * spark.sparkContext.defaultParallelism, "path")
        opened = lambda c: dealt.where(F.col("category") == c).drop("category").mapInPandas(_contents, "path string, modificationTime timestamp, length bigint, content binary")
        return reduce(DataFrame.unionByName, [_rows(opened(c.name), settings, c) for c in settings.categories])
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r["category"], []).append(r["path"])
    found = [_rows(_raw(spark, sorted(set(by[c.name]))), settings, c) for c in settings.categories if c.name in by]
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], FILE_SCHEMA))


def census(spark: SparkSession, settings: Settings) -> DataFrame:
    """category, n_files of every configured category; reads no contents."""
    names = spark.createDataFrame([(c.name, k) for k, c in enumerate(settings.categories)], "category string, ord int")
    counts = all_files(spark, settings).groupBy("category").agg(F.count("*").alias("n_files"))
    return names.join(counts, "category", "left").select("category", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def binary_files(spark: SparkSession, folder: str, *suffixes: str) -> DataFrame:
    """path, name, text of the files of a folder with one of the suffixes, in any letter case."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kept = raw.where(suffix("path").isin(*suffixes)) if suffixes else raw
    return kept.select(relative_path("path", folder).alias("source_file"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
