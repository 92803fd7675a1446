"""CSV, JSON, Parquet and table formats on any path that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.config import SourceConfig
from weftgraph.registry import source_registry
from weftgraph.sources.paths import file_system


@source_registry.register("csv")
def csv(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    """Every cell as text; an empty or missing cell is ''.

    Quoted cells may span lines, and then a file is one split. Files larger than a split
    are looked through once, in splits, and read in splits where no line can be part of
    such a cell. `headers` are reader options; multiLine there decides without a look.
    """
    options = {"header": "true", "multiLine": "true", "escape": '"', "sep": cfg.delimiter, "encoding": cfg.encoding, "emptyValue": ""}
    if not any(k.lower() == "multiline" for k in cfg.headers) and splittable(spark, cfg):
        options["multiLine"] = "false"
    return spark.read.options(**(options | cfg.headers)).csv(cfg.path).na.fill("")


def splittable(spark: SparkSession, cfg: SourceConfig) -> bool:
    """Whether CSV files are larger than a split and hold whole records in every line.

    A line with an even number of quotes begins and ends outside of a quoted cell if the
    one before does. Lines of blanks only are records to one reader and none to the other.
    """
    fs, path = file_system(spark, cfg.path)
    largest = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    found = [f for root in (fs.globStatus(path) or []) for f in ([root] if root.isFile() else fs.listStatus(root.getPath()))]
    if not any(f.getLen() > largest for f in found) or cfg.encoding.lower().replace("-", "") not in ("utf8", "ascii", "usascii", "iso88591", "latin1", "windows1252", "cp1252"):
        return False
    line = F.col("value")
    odd = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    blank = (F.length(line) > 0) & (F.length(F.trim(line)) == 0)
    return spark.read.text(cfg.path).where((odd % 2 == 1) | blank).isEmpty()


def descend(df: DataFrame, root: str) -> DataFrame:
    """The elements of the list at a dotted path; whole numbers index lists."""
    x, kind = None, df.schema
    for part in root.split("."):
        if isinstance(kind, T.StructType):
            if part not in kind.names:
                raise KeyError(f"json_root '{root}': no field '{part}'")
            x = F.col(f"`{part}`") if x is None else x[part]
            kind = kind[part].dataType
        elif isinstance(kind, T.ArrayType):
            x, kind = x[int(part)], kind.elementType
        else:
            raise KeyError(f"json_root '{root}': '{part}' is inside a {kind.simpleString()}")
    if not isinstance(kind, T.ArrayType):
        raise ValueError(f"json_root '{root}' is a {kind.simpleString()}, not a list")
    rows = df.select(F.explode(x).alias("row"))
    return rows.select("row.*") if isinstance(kind.elementType, T.StructType) else rows


@source_registry.register("json")
def json(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    """One JSON document a file, a list of records at its top or at json_root; .jsonl files are read by line."""
    if cfg.path.endswith((".jsonl", ".ndjson")):
        return spark.read.json(cfg.path)
    df = spark.read.options(multiLine=True, encoding=cfg.encoding).json(cfg.path)
    return descend(df, cfg.json_root) if cfg.json_root else df


@source_registry.register("spark_csv")
def spark_csv(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    """Typed CSV; `headers` are reader options and win."""
    options = {"header": "true", "inferSchema": "true", "encoding": cfg.encoding, "sep": cfg.delimiter} | cfg.headers
    return spark.read.options(**options).csv(cfg.path)


@source_registry.register("spark_json")
def spark_json(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    return spark.read.options(**cfg.headers).json(cfg.path)


def _queried(spark: SparkSession, df: DataFrame, cfg: SourceConfig) -> DataFrame:
    """The query over the view __<name>, if there is one."""
    if not cfg.query:
        return df
    df.createOrReplaceTempView(f"__{cfg.name}")
    return spark.sql(cfg.query)


@source_registry.register("spark_parquet")
def spark_parquet(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    return _queried(spark, spark.read.parquet(cfg.path), cfg)


@source_registry.register("spark_delta")
def spark_delta(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    """Needs the Delta package on the cluster; `headers` are reader options, time travel included."""
    return _queried(spark, spark.read.format("delta").options(**cfg.headers).load(cfg.path), cfg)
