"""Incremental builds driven by a file stream.

A file source tells of new files only, not of edits or deletions; it is used as
the signal, and every batch runs the same incremental build that a manual call
would, so the index stays equal to a full build.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexmill.plans.engine import Engine


def follow(engine: Engine, folder: str, checkpoint: str, pattern: str = "*", once: bool = True) -> StreamingQuery:
    """Rebuild incrementally whenever new files appear below ``folder``."""

    def on_batch(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.build_incremental()

    stream = (
        engine.spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path")
    )
    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
