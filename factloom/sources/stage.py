"""Intermediate rows in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset, a temporary one serves a local master,
    whose executors are this process; any other master is refused, as its executors would not share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(scratch, "own", None) or tempfile.mkdtemp(prefix="factloom-")
        scratch.own = folder
    return folder.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends there, and a
    lost executor loses nothing. The new frame's `staged_at` names the folder."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/factloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes what staged() wrote, through the file system that holds it."""
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's Parquet. One that comes as fewer splits than there are cores, as a single row group does, is dealt out
    first: its rows are the same, but all cores read texts. Large tables have splits enough and are left alone."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


#: Rows of a shuffle that one task takes.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt out by its keys, in so many partitions that each has about TASK_ROWS of its `rows`: adaptive execution joins
    partitions by their bytes, and narrow rows that compress well need far more memory than these. A small one is left alone."""
    return df.repartition(-(-rows // TASK_ROWS), *keys) if rows > TASK_ROWS else df
