"""SimHash near-duplicates through an inverted index of positional bytes.

Two 64-bit fingerprints at Hamming distance 3 or less differ in at most 3 of their 8
bytes, so at least 5 positional bytes are shared (the count filter's guaranteed
minimum). The 14 affine planes {i, j, k, i^j^k} of the byte positions cover every set of
3 positions; hence such a pair agrees on the 4 bytes outside one plane, and posting each
fingerprint under 14 keys of 4 positional bytes meets every pair. Where two meet, their
shared positional bytes are tallied, pairs under 5 go, and the rest are verified.

A posting list with more than `hot` fingerprints is posted again by the nibbles of its
free bytes (3 of 8 may differ: 13 nibbles fixed, 12 bits free), so a list never holds
more than 4,096 distinct fingerprints and no list is paired up whole. Of each list only
a tree of the linked fingerprints goes on. Equal fingerprints are one posting, however
many documents share them.

With a `similarity`, texts link by their Jaccard similarity of shingles instead, through the
same steps on a SimHash of 1,024 bits (`widehash`), as no 64-bit fingerprint reaches 0.8.

Defined results: null or wordless text has fingerprint 0 and links like any other; rows
with a null doc_id take part, but a class has the smallest doc_id that is not null (null
if there is none); repeated rows stay repeated.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm import minwise, widehash
from weftgraph.llm.common import checkpointed, map_texts, salted_join, table
from weftgraph.llm.components import components

SEED = 42
SHINGLE = 3
DISTANCE = 3
LEAST_SHARED = 8 - DISTANCE
HOT = 16
_PIECE = 65_536
PRINT = T.StructType([T.StructField("print", T.LongType())])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(units, width: int) -> int:
    return sum(((1 << width) - 1) << (width * u) for u in units)


#: The bytes in which a pair may differ, and the mask of those that agree.
PLANES = [p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]
FIXED = [_signed(_mask(set(range(8)) - set(p), 8)) for p in PLANES]


def _finer(plane) -> list[int]:
    nibbles = [n for b in plane for n in (2 * b, 2 * b + 1)]
    return [_signed(_mask(set(range(16)) - set(c), 4)) for c in combinations(nibbles, DISTANCE)]


FINER = {m: _finer(p) for m, p in zip(FIXED, PLANES, strict=True)}


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(line, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    after = ends.tolist()[shingle - 1 :]
    n = len(after)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        some = list(zip(starts[at : at + _PIECE], after[at : at + _PIECE], strict=False))
        h = np.fromiter((digest(line[a:b], SEED) for a, b in some), np.uint64, len(some))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """`docs` with `print`, the fingerprint as a signed long."""

    def make():
        return lambda texts: {"print": [_signed(simhash(t, shingle)) for t in texts]}

    return map_texts(docs, text_col, PRINT, make, keep)


def tree_links(prints, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Trees that join the fingerprints of one posting list that link directly or through others.

    Pairs are tallied by shared positional bytes first, then verified bit by bit. Node k
    of a sorted class hangs on node (k - 1) // 2, so no node has more than three links.
    """
    left = np.unique(np.asarray(prints, np.int64))
    out: list[tuple[int, int]] = []
    while len(left) > 1:
        queue, left, found = [left[0]], left[1:], []
        while queue:
            x = queue.pop()
            found.append(int(x))
            differ = left ^ x
            shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            maybe = np.flatnonzero(shared >= 8 - distance)
            near = maybe[np.bitwise_count(differ[maybe].view(np.uint64)) <= distance]
            if len(near):
                queue += left[near].tolist()
                left = np.delete(left, near)
        found.sort()
        out += [(found[(k - 1) // 2], found[k]) for k in range(1, len(found))]
    return out


def _links(lists: DataFrame) -> DataFrame:
    """(a, b) from rows with an array `prints`."""

    def run(frames):
        for frame in frames:
            pairs = [p for prints in frame["prints"] for p in tree_links(prints)]
            yield pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    return lists.where(F.size("prints") > 1).select("prints").mapInPandas(run, "a long, b long")


def near_links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct `print` within DISTANCE."""
    fixed = F.array(*[F.lit(m) for m in FIXED])
    posted = prints.select("print", F.explode(fixed).alias("mask")).withColumn("key", F.col("print").bitwiseAND(F.col("mask")))
    met = posted.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = checkpointed(salted_join(posted, met, ["mask", "key"], ["print"]).select("mask", "key", "print", "n"))
    cold = met.where(F.col("n") <= hot).groupBy("mask", "key").agg(F.collect_list("print").alias("prints"))
    finer = F.create_map(*[x for m, fs in FINER.items() for x in (F.lit(m), F.array(*[F.lit(f) for f in fs]))])
    again = met.where(F.col("n") > hot).select("print", F.explode(F.element_at(finer, F.col("mask"))).alias("mask"))
    again = again.distinct().withColumn("key", F.col("print").bitwiseAND(F.col("mask")))
    warm = again.groupBy("mask", "key").agg(F.collect_list("print").alias("prints"))
    return _links(cold).unionByName(_links(warm))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """(id, text_hash, print, root, component_id): one row per row of `docs`.

    `text_hash` tells rows apart that share an id; `root` is a fingerprint that names the class.
    With `similarity`, `print` is the hash of the text's wide SimHash.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    keep = ["id", "text_hash"]
    if similarity is None:
        rows = checkpointed(fingerprints(keyed, "text", keep, shingle))
        links = near_links(rows.select("print").distinct())
    else:
        rows = checkpointed(widehash.signatures(keyed, "text", keep, shingle).withColumn("print", F.xxhash64("sig")))
        sigs = checkpointed(rows.groupBy(F.col("print").alias("node")).agg(F.first("sig").alias("sig"), F.first("small").alias("small")))

        def sets_of(nodes: DataFrame) -> DataFrame:
            """The shingles of one text of each node; only texts of such nodes are read on."""
            one = rows.groupBy("print").agg(F.min("text_hash").alias("text_hash"))  # copies are combined before any shuffle
            one = one.join(nodes.select(F.col("node").alias("print")), "print", "left_semi")
            texts = salted_join(keyed, one, ["text_hash"], ["id"]).groupBy(F.col("print").alias("node")).agg(F.first("text").alias("text"))
            return minwise.shingle_sets(texts, shingle)

        links = widehash.near_links(sigs, sets_of, similarity)
    roots = components(links).select(F.col("node").alias("print"), "root")
    # rows are dealt by fingerprint or class and a salt, as one of either may hold many of them
    labelled = salted_join(rows.select("id", "text_hash", "print"), roots, ["print"], ["id", "text_hash"], how="left")
    labelled = checkpointed(labelled.withColumn("root", F.coalesce("root", "print")))
    least = labelled.groupBy("root").agg(F.min("id").alias("component_id"))
    return salted_join(labelled, least, ["root"], ["id", "text_hash"]).select("id", "text_hash", "print", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """`docs` with one row of each class: that of the smallest id (null last, then by text hash)."""
    found = near_duplicates(docs, id_col, text_col, shingle, similarity)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "text_hash")).alias("w"))
    word = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    kept = first.select(word(F.col("w.id")).alias("__id"), F.col("w.text_hash").alias("__hash"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, word(F.col(id_col)).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__hash"))
    rows = rows.join(kept, ["__id", "__hash"], "left_semi").groupBy("__id", "__hash").agg(F.first("row").alias("row"))
    return rows.select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
