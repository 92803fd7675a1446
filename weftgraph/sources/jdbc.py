"""Relational databases over JDBC."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from weftgraph.config import SourceConfig
from weftgraph.registry import source_registry
from weftgraph.sources.tables import is_query


def jdbc_url(url: str) -> tuple[str, dict[str, str]]:
    """A JDBC url and login options from a JDBC url or a database url (dialect+driver://user:password@host/db)."""
    if url.startswith("jdbc:"):
        return url, {}
    parts = urlsplit(url)
    dialect = parts.scheme.split("+")[0]
    if dialect == "sqlite":
        return f"jdbc:sqlite:{parts.path.removeprefix('/')}", {}
    login = {"user": parts.username, "password": parts.password}
    host = (parts.hostname or "localhost") + (f":{parts.port}" if parts.port else "")
    query = f"?{parts.query}" if parts.query else ""
    return f"jdbc:{dialect}://{host}{parts.path}{query}", {k: unquote(v) for k, v in login.items() if v}


def _read(spark: SparkSession, cfg: SourceConfig, table: str, options: dict[str, str]) -> DataFrame:
    url, login = jdbc_url(cfg.connection_string or cfg.url or cfg.path or "")
    options = login | options
    if cfg.chunk_size:
        options.setdefault("fetchsize", str(cfg.chunk_size))
    return spark.read.format("jdbc").options(**options).option("url", url).option("dbtable", table).load()


@source_registry.register("sql")
def sql(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    """The rows of any query; `headers` are reader options (driver, partitionColumn and bounds for parallel reads)."""
    return _read(spark, cfg, f"({cfg.query.rstrip().rstrip(';')}) q", cfg.headers)


@source_registry.register("spark_jdbc")
def spark_jdbc(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    """A table or a query; a query is read as a derived table, so partition options work with both."""
    text = (cfg.query or "").strip().rstrip(";")
    if not text:
        raise ValueError("spark_jdbc requires 'query'")
    return _read(spark, cfg, f"({text}) q" if is_query(text) else text, {k: v for k, v in cfg.headers.items() if v})
