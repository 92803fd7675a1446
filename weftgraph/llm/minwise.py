"""Links of texts at a similarity of word shingles, through an inverted index of positional bytes.

A 64-bit SimHash cannot tell a Jaccard similarity of 0.8 from 0.6, and one wide enough
needs some 150 postings a text to meet 95 % of the pairs at 0.8 (a bit differs with
probability acos(0.89) / pi = 0.15). Here each of BYTES positional bytes comes from the
smallest of the shingles' hashes under a function of that position, so two texts share
a byte with the probability of their Jaccard similarity: the tally of shared positional
bytes estimates it with a standard error of 0.035 at 0.8.

The index posts a text under BANDS keys of WIDTH bytes each. A pair at similarity 0.8 meets
with probability 1 - (1 - 0.8^5)^16 = 0.998. Where texts meet, their shared bytes are tallied
and pairs under the least are dropped; the least is the similarity less two standard
errors. Of each list the maximum spanning trees by shared bytes go on, so that no list is
paired up whole, and every link that is left is verified on the whole sets of shingles.

A posting list above `limit` is posted again under pairs of bands, which parts texts that
share a passage only. A list that is still above it is a cloud of near copies: its
members are compared with one leader, those that share the least are done, and the rest
has the next leader, until at most `limit` are left. Equal signatures are one posting.

Defined results: null and wordless texts have a signature of zeros and are equal; a text
of fewer words than a shingle is one shingle; repeated texts are one node.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import checkpointed, map_texts, salted_join

SHINGLE, SIMILARITY = 5, 0.8
BYTES, BANDS, WIDTH = 128, 16, 5
LIMIT = 512
SEED = 42
_PIECE = 8_192
_rng = np.random.default_rng(SEED)
_FACTORS = (_rng.integers(0, 1 << 32, BYTES, dtype=np.uint32) | np.uint32(1))[:, None]
_OFFSETS = _rng.integers(0, 1 << 32, BYTES, dtype=np.uint32)[:, None]
SIGNATURE = T.StructType([T.StructField("sig", T.BinaryType())])


def least_shared(similarity: float = SIMILARITY) -> int:
    return math.floor(BYTES * similarity - 2 * math.sqrt(BYTES * similarity * (1 - similarity)))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 of every shingle of lower-cased words, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([digest(line, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    spans = zip((ends - lengths).tolist(), ends.tolist()[shingle - 1 :], strict=False)
    return np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1)


def signature(text: str | None, shingle: int = SHINGLE) -> bytes:
    """The positional bytes of a whole text."""
    h = shingle_hashes(text, shingle)
    if not len(h):
        return bytes(BYTES)
    h = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(BYTES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), _PIECE):
        np.minimum(least, (_FACTORS * h[at : at + _PIECE] + _OFFSETS).min(axis=1), out=least)
    least ^= least >> np.uint32(15)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """`docs` with `sig`."""

    def make():
        return lambda texts: {"sig": [signature(t, shingle) for t in texts]}

    return map_texts(docs, text_col, SIGNATURE, make, keep)


def shingle_sets(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, shingles) from (node, text): the distinct shingles of whole texts, by 32 bits of their hashes."""

    def make():
        return lambda found: {"shingles": [np.unique((shingle_hashes(t, shingle) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in found]}

    return map_texts(texts, "text", T.StructType([T.StructField("shingles", T.ArrayType(T.IntegerType()))]), make, ["node"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The distinct pairs (a, b) whose sets of shingles are similar enough."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = salted_join(pairs, sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), ["a"], ["b"])
    both = salted_join(left, sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), ["b"], ["a"])
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def tree_links(nodes: list[int], sigs: list[bytes], least: int) -> list[tuple[int, int]]:
    """Maximum spanning trees by shared bytes over the nodes of a list; links have at least `least` (Prim's algorithm)."""
    x = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, BYTES)
    best, via = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    waiting = np.ones(len(x), bool)
    out: list[tuple[int, int]] = []
    at = 0
    for _ in range(len(x) - 1):
        waiting[at] = False
        shared = (x == x[at]).sum(axis=1)
        better = waiting & (shared > best)
        best[better], via[better] = shared[better], at
        at = int(np.where(waiting, best, -1).argmax())
        if best[at] >= least:
            out.append((nodes[via[at]], nodes[at]))
    return out


def _listed(posted: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """Links (a, b) within each list of `posted` (key, node); a list is bounded by its caller."""

    def run(frames):
        for frame in frames:
            pairs = [p for nodes, some in zip(frame["nodes"], frame["sigs"], strict=True) for p in tree_links(nodes, some, least)]
            yield pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    rows = posted.join(sigs, "node").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "sig"))).alias("l"))
    return rows.select(F.col("l.node").alias("nodes"), F.col("l.sig").alias("sigs")).mapInPandas(run, "a long, b long")


def _against_leaders(rows: DataFrame, least: int) -> DataFrame:
    """`rows` (key, node, leader, sig, leader_sig) with `linked`."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BYTES) for c in ("sig", "leader_sig"))
            linked = (a == b).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("node"), batch.column("leader"), pa.array(linked)], names=["key", "node", "leader", "linked"])

    return rows.select("key", "node", "leader", "sig", "leader_sig").mapInArrow(run, "key long, node long, leader long, linked boolean")


def _meeting(posted: DataFrame) -> DataFrame:
    """(key, node, n, ..) of the keys that several nodes have."""
    met = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return salted_join(posted, met, ["key"], ["node"])


def _band(k: int) -> Column:
    return F.substring("sig", WIDTH * k + 1, WIDTH)


def near_links(sigs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) of `sigs` (node long, sig), one row a node; `sets_of` gives (node, shingles) of some nodes."""
    pairs = checkpointed(candidates(sigs, least_shared(similarity), limit).distinct())
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return verified(pairs, checkpointed(sets_of(nodes)), similarity)


def candidates(sigs: DataFrame, least: int, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, b) that share at least `least` bytes: trees of the posting lists."""
    keys = F.array(*[F.struct(F.xxhash64(F.lit(k), _band(k)).alias("key"), F.lit(k).alias("band")) for k in range(BANDS)])
    met = checkpointed(_meeting(sigs.select("node", F.explode(keys).alias("x")).select("node", "x.key", "x.band")))
    links = _listed(met.where(F.col("n") <= limit).select("key", "node"), sigs, least)
    hot = met.where(F.col("n") > limit).groupBy("node").agg(F.collect_set("band").alias("bands"))
    if hot.isEmpty():
        return links
    pairs = [(F.xxhash64(F.lit(-1 - a), F.lit(b), _band(a), _band(b)), a, b) for a, b in combinations(range(BANDS), 2)]
    # a pair of bands counts where either of them is hot for the node
    finer = F.array_compact(F.array(*[F.when(F.array_contains("bands", a) | F.array_contains("bands", b), key) for key, a, b in pairs]))
    rest = checkpointed(_meeting(hot.join(sigs, "node").select("node", F.explode(finer).alias("key"))).select("key", "node", "n"))
    while True:
        links = links.unionByName(_listed(rest.where(F.col("n") <= limit).select("key", "node"), sigs, least))
        big = rest.where(F.col("n") > limit)
        if big.isEmpty():
            return links
        leaders = big.groupBy("key").agg(F.min_by("node", F.xxhash64("key", "node")).alias("leader"))
        leaders = leaders.join(sigs.select(F.col("node").alias("leader"), F.col("sig").alias("leader_sig")), "leader")
        rows = salted_join(big.select("key", "node"), leaders, ["key"], ["node"]).join(sigs, "node")
        tried = checkpointed(_against_leaders(rows, least))
        links = links.unionByName(tried.where("linked and node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")))
        rest = checkpointed(_meeting(tried.where("not linked").select("key", "node")))
