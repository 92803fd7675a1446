"""Streams of records merged into node tables, batch by batch, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.config import NodeMapping
from weftgraph.operators.graph import merge, project_nodes
from weftgraph.operators.validation import apply_rules
from weftgraph.sources.paths import file_system, table_at

BUCKET = "bucket"
#: Folders beside the buckets that readers do not see: the new files of a batch, and the old ones until they are replaced.
NEW, OLD = "_new", "_old"


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo the swap that a lost driver left: a bucket that has old files and no current ones takes them back."""
    fs, root = file_system(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    old = at(root, OLD)
    if fs.exists(old):
        for found in fs.listStatus(old):
            name = found.getPath().getName()
            if not fs.exists(at(root, name)):
                fs.rename(found.getPath(), at(root, name))
        fs.delete(old, True)
    fs.delete(at(root, NEW), True)


def swap(spark: SparkSession, path: str) -> None:
    """Put the buckets of a complete batch in the place of the current ones; what is replaced stays until its new files are there."""
    fs, root = file_system(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(at(root, OLD))
    for found in fs.listStatus(at(root, NEW)):  # at most one folder a bucket
        name = found.getPath().getName()
        if not name.startswith(f"{BUCKET}="):
            continue
        if fs.exists(at(root, name)):
            fs.rename(at(root, name), at(at(root, OLD), name))
        fs.rename(found.getPath(), at(root, name))
    fs.delete(at(root, OLD), True)
    fs.delete(at(root, NEW), True)


def bucketed(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where it has no bucket yet."""
    fs, root = file_system(spark, path)
    if not fs.exists(root) or not any(f.getPath().getName().startswith(f"{BUCKET}=") for f in fs.listStatus(root)):
        return None
    return table_at(spark, path)


def merge_stream(stream: DataFrame, mapping: NodeMapping, path: str, checkpoint: str, buckets: int = 256, **trigger: object) -> StreamingQuery:
    """Validate, project and MERGE each micro-batch into a Parquet table bucketed by key.

    A batch reads and replaces only the buckets that its keys fall in: their new files are
    complete beside the old ones before they take their place. The merge keeps the last
    assignment, so a batch that runs again after a failure leaves the same table.
    """

    def put(batch: DataFrame, _: int) -> None:
        rows = batch
        if mapping.validation and mapping.validation.rules:
            rows = apply_rules(batch, mapping.validation.rules).valid
        bucket = F.pmod(F.xxhash64(F.col(f"`{mapping.key}`").cast("string")), F.lit(buckets)).cast("int")
        new = project_nodes(rows, mapping).withColumn(BUCKET, bucket)
        new = new.where(F.col(f"`{mapping.key}`").isNotNull()).persist()
        try:
            touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most `buckets` numbers
            spark = batch.sparkSession
            recover(spark, path)
            old = bucketed(spark, path)
            parts = [new] if old is None else [old.where(F.col(BUCKET).isin(touched)), new]
            merged = merge(parts, [mapping.key, BUCKET])
            merged.write.partitionBy(BUCKET).parquet(f"{path}/{NEW}")
            swap(spark, path)
        finally:
            new.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(put).start()


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Rows by event-time window and columns; rows later than the watermark are left out.

    Times without a zone are taken in the session's.
    """
    if dict(stream.dtypes)[time] == "timestamp_ntz":
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, lateness).groupBy(window.alias("window"), *by).agg(F.count(F.lit(1)).alias("n"))
