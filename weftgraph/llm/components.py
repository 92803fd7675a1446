"""Connected components of a link table by contraction.

Each round every node picks, in its closed neighbourhood, the node with the smallest
hash; links are renamed to the picks and made distinct. The picks of all rounds are then
composed. The hash order is the same in every round: a star is gone in two rounds, and a
path, of whatever order of ids, shrinks by a constant factor a round. Once at most
`finish` links are left, one task ends them with a union-find: its input is bounded by
that count, whatever the size of the graph. No link or node reaches the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import kept, salted_join

FINISH = 10_000


def union_find(pairs) -> dict:
    """node -> root of its class, the smallest node."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def _finished(frames):
    found = union_find(p for f in frames for p in zip(f["a"].tolist(), f["b"].tolist(), strict=True))
    yield pd.DataFrame(list(found.items()), columns=["node", "root"], dtype="int64")


def components(links: DataFrame, finish: int = FINISH) -> DataFrame:
    """(node, root) for every node of `links` (a long, b long) that has a link; loops and repeats are harmless."""

    def clean(df: DataFrame) -> DataFrame:
        return kept(df.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def rank(c: str):
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))

    edges, picks = clean(links), []
    while edges.count() > finish:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        best = both.groupBy("node").agg(F.min(rank("other")).alias("o")).select("node", F.least(rank("node"), F.col("o"))["v"].alias("root"))
        picks.append(best := kept(best))
        for end in ("a", "b"):
            edges = edges.join(best.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("root", end)
        edges = clean(edges)
    found = edges.coalesce(1).mapInPandas(_finished, "node long, root long")
    while picks:
        later = kept(found).select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = salted_join(picks.pop(), later, ["root"], ["node"], how="left").select("node", F.coalesce("last", "root").alias("root"))
    return kept(found)
