"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftgraph.sources.paths import removed_at_exit, shared_dir

#: Rows that a Python function sees at once, whatever the size of the Arrow batch.
SLICE = 512
#: Bytes of an Arrow batch on its way to Python: both sides of every core hold a few of these.
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder of the cluster."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in that folder, which goes when the application ends.

    Unlike a checkpoint it starts again from measured sizes: estimates multiply from
    join to join, and a loop of checkpoints ends up planning with astronomical numbers.
    """
    spark = df.sparkSession
    path = removed_at_exit(spark, f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], by: list[str], salts: int = 8, how: str = "inner") -> DataFrame:
    """`many` joined with `one`, which has one row a key, so that no key lands in one task.

    Rows of `many` are dealt over `salts` partitions a key by a hash of `by`; `one` is repeated.
    Neither side is broadcast: Spark sees the size of `one` before it is repeated and hashed, and a
    file just below its bound becomes some sixty times that in the driver.
    """
    one = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    many = many.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    return many.join(one.hint("merge"), [*keys, "__salt"], how).drop("__salt")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on Arrow batches to BATCH_BYTES, where it is higher.

    A batch of rows as such may hold a few very long texts; the bound is read when a plan
    starts, so it can only be set for the session.
    """
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def map_texts(
    df: DataFrame,
    text_col: str,
    fields: T.StructType,
    make: Callable[[], Callable[[list], dict[str, list]]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add columns computed from whole texts in Arrow batches.

    `make()` runs once per task and gives a function from a list of texts (None for
    null) to one list per new field. `keep` names the input columns to return (all by
    default). An input column whose name clashes with a new one is replaced by it.
    """
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    inner = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([*inner.schema.fields[:-1], *fields.fields])
    arrow = to_arrow_schema(fields)
    n_kept = len(kept)

    def run(batches):
        fn = make()
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), SLICE):
                part = batch.slice(at, SLICE)
                out = fn(part.column(n_kept).to_pylist())
                made = [pa.array(out[f.name], type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(part.columns[:n_kept] + made, names=kept + arrow.names)

    return inner.mapInArrow(run, schema)
