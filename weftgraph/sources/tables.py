"""Catalog tables and queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.config import SourceConfig
from weftgraph.registry import source_registry


def is_query(text: str) -> bool:
    return text.lstrip().upper().startswith(("SELECT ", "SELECT\n", "SELECT\t", "WITH ", "WITH\n"))


@source_registry.register("spark_table")
def spark_table(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    """A table by name, or a query (SELECT or WITH)."""
    text = cfg.query or cfg.path
    if not text:
        raise ValueError("spark_table requires 'query' or 'path'")
    return spark.sql(text) if is_query(text) else spark.table(text)
