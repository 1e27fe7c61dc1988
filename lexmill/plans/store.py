"""Index snapshots: complete sets of Parquet tables, published by one small pointer file.

A build writes a new folder and then creates a pointer of a new name that
tells the time and the folder; readers take the newest.  Nothing is deleted or
replaced on the way, so readers see the old index or the new one, never
neither, and a build that dies changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("chunks", "parents", "postings", "doc_stats", "term_stats", "corpus_stats", "embeddings", "placed", "cells", "centres", "manifest", "category_stats", "settings")


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[tuple[str, str]]:
        """(pointer, snapshot), the newest first; pointers to folders that are gone do not count."""
        fs, root = self._fs(), self._path("")
        names = sorted((s.getPath().getName() for s in fs.listStatus(root)), reverse=True) if fs.exists(root) else []
        split = [(n, n.split(".", 2)[2]) for n in names if n.startswith("published.") and n.count(".") >= 2]
        return [(n, snapshot) for n, snapshot in split if snapshot and snapshot in names]

    def current(self) -> str | None:
        """Folder of the published snapshot, None if there is none."""
        return next((f"{self.root}/{snapshot}" for _, snapshot in self._pointers()), None)

    def table(self, name: str, at: str | None = None) -> DataFrame | None:
        """A table with the schema it was written with, also where it is empty or its categories look like numbers."""
        at = at or self.current()
        if at is None:
            return None
        fs, path = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}.schema")
        stream = fs.open(path)
        try:
            schema = StructType.fromJson(json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()
        return self.spark.read.schema(schema).parquet(f"{at}/{name}").select(schema.names)

    def has(self, name: str, at: str) -> bool:
        return self._fs().exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}.schema"))

    def is_ready(self) -> bool:
        at = self.current()
        return at is not None and not self.table("chunks", at).isEmpty()

    def begin(self) -> str:
        return f"snapshot-{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"

    def _put(self, path, content: str = "") -> None:
        stream = self._fs().create(path, True)
        if content:
            stream.write(bytearray(content.encode()))
        stream.close()

    def write(self, snapshot: str, name: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        path = f"{self.root}/{snapshot}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        self._put(self._path(f"{snapshot}/{name}.schema"), df.schema.json())
        return self.table(name, f"{self.root}/{snapshot}")

    def publish(self, snapshot: str) -> None:
        """The newest pointer wins; older ones but for the last two go."""
        latest = max((int(n.split(".")[1]) for n, _ in self._pointers()), default=0)
        self._put(self._path(f"published.{max(int(time.time() * 1000), latest + 1):015d}.{snapshot}"))
        for name, _ in self._pointers()[2:]:
            self._fs().delete(self._path(name), False)

    def export_json(self, name: str, folder: str) -> None:
        """A table of the published snapshot as lines of JSON."""
        self.table(name).write.mode("overwrite").json(folder)

    def drop_old(self, keep: int = 2) -> list[str]:
        """Remove all but the latest ``keep`` snapshots; the published one always stays."""
        fs = self._fs()
        names = sorted(s.getPath().getName() for s in fs.listStatus(self._path("")) if s.getPath().getName().startswith("snapshot-"))
        live = (self.current() or "").rpartition("/")[2]
        gone = [n for n in names[: max(0, len(names) - keep)] if n != live]
        for n in gone:
            fs.delete(self._path(n), True)
        return gone


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
