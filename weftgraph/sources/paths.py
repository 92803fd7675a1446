"""Paths on any store that Spark reads."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str):
    """(store, path) as Hadoop objects."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def table_at(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at a path, or None where there is nothing."""
    fs, p = file_system(spark, path)
    return spark.read.parquet(path) if fs.exists(p) else None


def shared_dir(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`, which all executors see; a temporary folder only where all runs on one machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
            path = tempfile.mkdtemp(prefix="weft-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def removed_at_exit(spark: SparkSession, path: str) -> str:
    """The path, whose files go when the application ends."""
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def reads_files(df: DataFrame) -> bool:
    """Whether a plan's rows are those of one file scan, so that their file and block are known."""
    if not hasattr(df, "_jdf"):
        return False
    return df._jdf.queryExecution().analyzed().metadataOutput().mkString(",").count("_metadata") == 1
