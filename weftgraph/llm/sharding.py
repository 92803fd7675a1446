"""Hilbert-curve sharding with DataFrame functions only.

Numeric dimensions are quantised at their approximate quantiles, text dimensions where the
rows of their distinct values in order pass a cell's share; the cells are ordered along a Hilbert curve (Hamilton's algorithm as a state table walked by `aggregate`), and
the global order (curve index, text checksum, id) is cut into runs of equal counts: law
`rows`. Files written run by run then have narrow ranges in every dimension.

The rank of a row is the count of the range partitions before its own plus its place in
that one, so no task sees more than a partition; only one row a partition is broadcast.

Defined results: null text has no bytes; null dimensions come first; equal rows take
neighbouring ranks in any order; an empty table gives no rows; input columns named like
the ones added are replaced. `assign_shards` keeps rows with equal keys in one shard, so
its counts may differ by the number of rows that share the key at a cut.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import checkpointed, table

SHARDS = 24
BITS = 5
#: monotonically_increasing_id keeps the place in the partition in its lower 33 bits.
_PLACE = (1 << 33) - 1


def hilbert_table(n: int) -> tuple[list[int], list[int]]:
    """For state s = entry * n + direction and cell bits b, at s * 2^n + b: the digit and the next state."""
    full = (1 << n) - 1
    rot = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & full
    gray = lambda i: i ^ (i >> 1)
    back = {gray(i): i for i in range(full + 1)}
    ones = lambda i: ((i ^ (i + 1)).bit_length() - 1) % n  # trailing set bits
    digits, states = [], []
    for entry in range(full + 1):
        for direction in range(n):
            for cell in range(full + 1):
                w = back[rot(cell ^ entry, n - (direction + 1) % n)]
                turn = 0 if w == 0 else ones(w if w % 2 else w - 1)
                e = entry ^ rot(0 if w == 0 else gray(2 * ((w - 1) // 2)), direction + 1)
                digits.append(w)
                states.append(e * n + (direction + turn + 1) % n)
    return digits, states


def hilbert_index(cells: Sequence[Column], bits: int = BITS) -> Column:
    """The curve index of integer cells of `bits` bits each."""
    n = len(cells)
    digits, states = (F.array(*[F.lit(x) for x in t]) for t in hilbert_table(n))

    def step(acc, bit):
        cell = F.lit(0)
        for k, c in enumerate(cells):
            cell = cell + F.call_function("shiftright", c.cast("int"), bit).bitwiseAND(F.lit(1)) * (1 << k)
        at = (acc["s"] * (1 << n) + cell + 1).cast("int")
        return F.struct(F.element_at(states, at).alias("s"), (acc["h"] * (1 << n) + F.element_at(digits, at)).alias("h"))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["h"]


def _prefix_sums(df: DataFrame, order: Sequence[str], weight: str) -> DataFrame:
    """`df` with `before`, the sum of `weight` over the rows before each in the order, and `total`.

    Rows are dealt by range; a task sees one partition, and one row a partition is broadcast.
    """
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()))
    sums = dealt.groupBy("pid").agg(F.sum(weight).alias("s"))
    upto = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sums.select("pid", (F.sum("s").over(upto) - F.col("s")).alias("start"), F.sum("s").over(everything).alias("total"))
    inside = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(F.broadcast(starts), "pid").withColumn("before", F.col("start") + F.sum(weight).over(inside) - F.col(weight)).drop("pid", "start")


def text_cuts(df: DataFrame, dims: Sequence[str], bits: int = BITS) -> dict[str, list[str]]:
    """For text columns, the first value of every cell but the lowest: at most 2^bits - 1 a column.

    A value begins in the cell in which the share of the rows with smaller values falls, so
    a prefix that all values share costs nothing. Nulls are in the lowest cell.
    """
    if not dims:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]))
    counts = df.select(pairs.alias("p")).select("p.dim", "p.value").groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))
    summed = _prefix_sums(counts, ["dim", "value"], "n")
    # every column has as many rows, so the sums of one column start at a multiple of that
    rows = F.col("total") / len(dims)
    cell = F.floor((F.col("before") % rows) * (1 << bits) / rows)
    first = summed.where("value is not null").groupBy("dim", cell.alias("cell")).agg(F.min("value").alias("value")).where("cell > 0")
    out: dict[str, list[str]] = {d: [] for d in dims}
    for r in first.collect():
        out[r.dim].append(r.value)
    return {d: sorted(v, key=lambda x: x.encode("utf-8", "surrogatepass")) for d, v in out.items()}


def cells_of(df: DataFrame, numbers: Sequence[str], texts: Sequence[str], bits: int = BITS) -> list[Column]:
    """Cells of numeric and text columns, cut by all rows."""
    points = [k / (1 << bits) for k in range(1, 1 << bits)]
    edges = df.agg(*[F.percentile_approx(d, points, 10_000).alias(d) for d in numbers]).first()
    found = {d: F.array(*[F.lit(int(e)) for e in sorted(set(edges[d] or [0]))]) for d in numbers}
    found |= {d: F.array(*[F.lit(v) for v in cuts]).cast("array<string>") for d, cuts in text_cuts(df, texts, bits).items()}
    reached = lambda cuts, value: F.size(F.filter(cuts, lambda e: e <= value))
    return [reached(cuts, F.col(d)) for d, cuts in found.items()]


def ranked(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """`df` with `rank`, gapless from 0 in the order, and `total`. Uses columns pid and place."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("pid", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)))
    dealt = checkpointed(dealt)
    counts = dealt.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    all_rows = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    starts = counts.select("pid", before.alias("start"), F.sum("n").over(all_rows).alias("total"))
    # one row a partition: a few hundred bytes for every gigabyte of input
    return dealt.join(F.broadcast(starts), "pid").withColumn("rank", F.col("start") + F.col("place")).drop("pid", "place", "start")


def measured(docs: DataFrame, text_col: str, dims: Sequence[str]) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return [(F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), *[F.col(d).cast("string").alias(f"dim_{d}") for d in dims]]


def hilbert_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: Sequence[str] = ("lang", "source"), shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """(id_col, size, text_crc32, curve, shard, slot) of every row."""
    rows = checkpointed(docs.select(F.col(id_col), *measured(docs, text_col, dims)))
    rows = rows.withColumn("curve", hilbert_index(cells_of(rows, ["size"], [f"dim_{d}" for d in dims], bits), bits)).select(id_col, "size", "text_crc32", "curve")
    r = ranked(rows, ["curve", "text_crc32", id_col, "size"])
    at = F.expr(f"cast((rank * {shards}) div total as int)")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return r.withColumn("shard", at).withColumn("slot", F.col("rank") - first).drop("rank", "total")


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: Sequence[str] = ("lang", "source"), shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """`docs` with `curve` and `shard`; texts are neither shuffled nor sorted.

    The runs are cut on a narrow table; the keys at the cuts (one a shard) then place
    every row. Rows with equal keys stay in one shard.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("curve", "shard")]
    key = [F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id")]
    narrow = checkpointed(docs.select(*key, *measured(docs, text_col, dims)))
    cells = cells_of(narrow, ["size"], [f"dim_{d}" for d in dims], bits)
    order = ["curve", "text_crc32", "id"]
    r = ranked(narrow.withColumn("curve", hilbert_index(cells, bits)).select(*order), order)
    cut = F.expr(f"rank > 0 and (rank * {shards}) div total != ((rank - 1) * {shards}) div total")
    cuts = sorted((tuple(x) for x in r.where(cut).select(*order).collect()), key=lambda c: (c[0], c[1], c[2].encode("utf-8", "surrogatepass")))  # at most shards - 1 rows
    whole = docs.select(F.struct(*kept).alias("row"), *key, *measured(docs, text_col, dims)).withColumn("curve", hilbert_index(cells, bits))
    return whole.select("row.*", "curve", cuts_passed(F.struct(*order), cuts).alias("shard"))


def cuts_passed(key: Column, cuts: Sequence[tuple[int, int, str]]) -> Column:
    """How many of some sorted (curve, text_crc32, id) a key is not below, by binary search in one literal."""
    kind = "array<struct<curve:bigint,text_crc32:bigint,id:string>>"
    found = F.from_json(F.lit(json.dumps([dict(zip(("curve", "text_crc32", "id"), c, strict=True)) for c in cuts])), kind)

    def halve(at, _):
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        passed = key >= F.get(found, middle)
        low = F.when((at["low"] < at["high"]) & passed, middle + 1).otherwise(at["low"])
        high = F.when((at["low"] < at["high"]) & ~passed, middle).otherwise(at["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), start, halve)["low"]


def write_shards(sharded: DataFrame, path: str, order: Sequence[str] = ("curve",)) -> None:
    """One folder a shard, rows in curve order, so that files can be pruned in every dimension."""
    sharded.repartitionByRange("shard", *order).sortWithinPartitions("shard", *order).write.partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hilbert_shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
