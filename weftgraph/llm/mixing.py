"""Mixing sources to target weights by capped water-filling.

Sources share `share` of all words by weight; a target stops at `epochs` times its
source's words and the excess goes to the others by weight until none is above. The
level that settles this is found in closed form from the sources in order of cap by
weight. A source's target is met by whole repetitions of all its documents and a seeded
fraction: documents in the order of a seeded hash take one more repetition until the
target is reached; the document at the cut takes the words that are missing.

The cut is found from sums over hash buckets, then inside one bucket for each source, so
no source, however large, is sorted or summed in one task; a document needs only its own
hash and its source's row.

Defined results: null text has no words; the null source is a source of its own, last in
order; documents without words take none; rows that share an id and size share the words
at the cut in proportion, rounded down; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftgraph.llm.common import checkpointed, table

WEIGHTS = (3, 1, 2)
SHARE, EPOCHS, SEED = 1.5, 2, 42
WORD = r"[^\x20\x09-\x0D]+"
#: Leading hex digits of the hash that name a bucket: 4,096 buckets a source.
DIGITS = 3
#: A source table of at most so many rows (about 1 MB) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 10_000
SALTS = 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: Column, seed: int = SEED) -> Column:
    """The seeded place of a document in its source, as hex digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def source_key(source: Column) -> Column:
    """A key that is never null and keeps the null source apart."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def water_fill(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """`sources` (skey, source, source_size), one row a source, with `target`.

    Works on one row a source, in one task.
    """
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_code) - 1) % len(weights) + 1).cast("int"))
    w = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    w = w.withColumn("level", (total - before) / after).withColumn("nth", F.row_number().over(by_ratio))
    settles = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("nth", "level"))
    level = F.coalesce(F.min(settles).over(everything)["level"], F.lit(float("inf")))
    return w.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select("skey", "source", "source_size", "target")


def plan_mix(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """From (source, draw, size) of all documents, one row a source.

    skey, source_size, target, whole (repetitions of all), cut (draw of the document at
    the cut, null for none), room (words that it takes) and cut_size (words it has).
    """
    d = sized.withColumn("skey", source_key(F.col("source"))).withColumn("bucket", F.substring("draw", 1, DIGITS))
    buckets = checkpointed(d.groupBy("skey", "bucket").agg(F.sum("size").alias("size"), F.first("source").alias("source")))
    sources = buckets.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    plan = water_fill(sources, weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("quota", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    plan = checkpointed(plan.select("skey", "source_size", "target", "whole", "quota"))

    def crossing(rows: DataFrame, order: str) -> DataFrame:
        run = Window.partitionBy("skey").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = rows.withColumn("upto", F.sum("size").over(run) + F.col("base"))
        return sums.where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("size") < F.col("quota")))

    at = crossing(buckets.select("skey", "bucket", "size").join(plan.select("skey", "quota"), "skey").withColumn("base", F.lit(0)), "bucket")
    at = at.select("skey", "bucket", "quota", (F.col("upto") - F.col("size")).alias("base"))
    near = d.groupBy("skey", "bucket", "draw").agg(F.sum("size").alias("size")).join(at, ["skey", "bucket"])
    cut = crossing(near, "draw").select("skey", F.col("draw").alias("cut"), (F.col("quota") - F.col("upto") + F.col("size")).alias("room"), F.col("size").alias("cut_size"))
    return checkpointed(plan.join(cut, "skey", "left").drop("quota"))


def with_plan(df: DataFrame, plan: DataFrame, source: Column) -> DataFrame:
    """`df` with its source's row; `plan` is broadcast only when its measured size allows it.

    A larger plan is joined by shuffle, with every source dealt over SALTS partitions.
    """
    df = df.withColumn("skey", source_key(source))
    if plan.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(plan), "skey").drop("skey")
    salted = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    df = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return df.join(salted, ["skey", "__salt"]).drop("skey", "__salt")


def extra_share(draw_col: Column, size: Column) -> Column:
    """Words that a document takes beyond whole repetitions."""
    return (
        F.when(F.col("cut").isNull() | (draw_col > F.col("cut")), F.lit(0))
        .when(draw_col < F.col("cut"), size)
        .otherwise(F.floor(size * F.col("room") / F.greatest(F.col("cut_size"), F.lit(1))))
        .cast("long")
    )


def mix_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, size, source_size, target, taken) of every document."""
    sized = docs.select(F.col(id_col), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), draw(F.col(id_col)).alias("draw"))
    sized = checkpointed(sized)
    rows = with_plan(sized, plan_mix(sized), F.col("source"))
    taken = F.col("whole") * F.col("size") + extra_share(F.col("draw"), F.col("size"))
    return rows.select(id_col, "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` as the mix repeats them: every whole repetition is a row; the document at the
    cut is repeated once more when it would take at least half its words. Documents that
    the mix does not take are left out; texts are not shuffled."""
    names, fields = docs.columns, docs.schema
    sized = docs.select(F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), draw(F.col(id_col)).alias("draw"))
    plan = plan_mix(sized)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    rows = with_plan(whole, plan, F.col("row")[source_col])
    place = draw(F.col("row")[id_col])
    more = F.when(place < F.col("cut"), 1).when((place == F.col("cut")) & (2 * F.col("room") >= F.col("cut_size")), 1).otherwise(0)
    times = (F.col("whole") + F.coalesce(more, F.lit(0))).cast("int")
    out = rows.select("row", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).select("row.*")
    return out.to(T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_words(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, 2 * source_size AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS nth,
        (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
v AS (SELECT arg_min(level, nth) AS level FROM l WHERE level <= cap / weight),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), v.level * weight) AS target FROM l, v),
p AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
q AS (SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS quota FROM p),
g AS (SELECT source, draw, sum(size) AS gsize, sum(sum(size)) OVER (PARTITION BY source ORDER BY draw) AS upto FROM d GROUP BY source, draw)
SELECT d.doc_id, d.size, q.source_size, q.target,
       CAST(q.whole * d.size + CASE WHEN g.upto <= q.quota THEN d.size WHEN g.upto - g.gsize >= q.quota THEN 0
            ELSE floor(d.size * (q.quota - g.upto + g.gsize) / greatest(g.gsize, 1)) END AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.draw = g.draw
"""
