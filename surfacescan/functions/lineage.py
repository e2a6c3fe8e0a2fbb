"""Cutting the lineage of tables that are built in steps, and shared scratch folders."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a local one is set only in local mode, where none is named."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's path below the shared one; it is deleted when the driver ends."""
    path = f"{shared(spark)}/scratch/{tag}-{uuid.uuid4().hex}"
    atexit.register(forget, spark, path)
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass
