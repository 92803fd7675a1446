"""Sources: each registered function turns a SourceConfig into a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftgraph.config import SourceConfig
from weftgraph.registry import source_registry
from weftgraph.sources import files, jdbc, rest, tables  # noqa: F401  they register themselves


def read_source(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    """The rows of a source, by its type; a plug-in may return a DataFrame or a list of dicts."""
    fn = source_registry.get(cfg.type)
    if fn is None:
        raise ValueError(f"Unknown source type: '{cfg.type}'. Known: {sorted(source_registry.keys())}")
    out = fn(spark, cfg)
    if not isinstance(out, DataFrame) and isinstance(out, Sequence):
        out = from_records(spark, out)
    return out if cfg.limit is None else out.limit(cfg.limit)


def from_records(spark: SparkSession, records: Sequence[dict]) -> DataFrame:
    """Rows of a plug-in; columns without any value become text, no records give no columns."""
    names = list(dict.fromkeys(k for r in records for k in r))
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    void = [n for n in names if all(r.get(n) is None for r in records)]
    rows = [{n: ("" if n in void else r.get(n)) for n in names} for r in records]
    df = spark.createDataFrame(rows, samplingRatio=1.0).select(*names)
    return df.replace({"": None}, subset=void) if void else df
