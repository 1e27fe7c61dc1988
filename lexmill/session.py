"""Session helpers that behave alike on a laptop and on a cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode (tests) a session without one gets a temporary folder, once and removed at the end; on a
    cluster each executor would write to a disk of its own, so there it is an error.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    own = spark.conf.get("spark.lexmill.sharedDir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lexmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        own = "file://" + folder
        spark.conf.set("spark.lexmill.sharedDir", own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for ``name`` among the tables of this application in the shared folder."""
    return f"{shared_dir(spark)}/lexmill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` by a Parquet table in the shared folder.

    The table outlives executors, so a lost executor costs a re-read and not
    a recomputation of everything before this point.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Remove what this application wrote to the shared folder; call it when no plan reads it any more."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lexmill-{spark.sparkContext.applicationId}")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    n = len(fs.listStatus(root))
    fs.delete(root, True)
    return n


#: Larger tables are not dealt out again: their own splits are enough work for each core.
SPREAD_BYTES = 1 << 30


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table of a folder of Parquet tables.

    ``spread`` deals the rows of a small table that comes in fewer splits than there are cores (one file, one
    row group) over all cores; other tables are read as they are, without a shuffle.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if spread and df.rdd.getNumPartitions() < (cores := spark.sparkContext.defaultParallelism):
        if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SPREAD_BYTES:
            df = df.repartition(cores)
    return df
