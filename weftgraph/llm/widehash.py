"""Links of texts at a similarity of word shingles: wide SimHash, inverted index of positional bytes.

At a Jaccard similarity of 0.8 two sets of shingles have a cosine of 0.889 at least, so a bit
of their SimHash differs with probability acos(0.889) / pi = 0.151: too much for 64 bits and
a distance of 3, but of a SimHash of 1,024 bits 35 of 128 positional bytes are shared, and
half a byte by unrelated texts.

The index posts a fingerprint under TABLES keys of WIDTH of its bytes, positions dealt by
permutations so that all bytes serve alike. A pair at 0.8 meets with a probability of 0.98 and
at 0.85 of 0.99 (measured on random sets). A posting is a key, the place of its fingerprint
and PREFIX bytes of it: postings of a table and a slice of its keys are one group, sorted in
numpy, and where two of one key differ in more than FAR bits of the prefix they are no pair
(0.05 % at 0.8 are, 98 % of the unrelated are not). Up to PAIRED postings of a key give all
their pairs. Of more each gives the nearest that comes before it in the order of a hash, the
same in all tables, so a cloud of near copies gives few pairs, many times; lists above LIMIT
are cut into parts of LIMIT that share a leader.

Pairs are then tallied on whole fingerprints: those with fewer than the least shared bytes
(the mean at the similarity less 2.5 standard errors) or more bits apart than the like (3) go.
The rest is verified on the whole sets of shingles. The first EARLY tables come alone: their
links put near copies in classes, and postings of the other tables carry their class, so that
a cloud does not meet itself again in every table: a pair within a class can change nothing.
Of what those tables add, the best pair of every node is verified first, and then all pairs
whose ends are not yet in one class, so none is given up for a better one.

Sets of a few shingles are too coarse for that: of 4 and 5 with 4 in common a quarter would
be found. So a set of at most SMALL is also looked up, exactly, among sets that have one
shingle more; no other two of that size reach 0.8.

Defined results: null and wordless texts have a fingerprint of zeros and are equal; a text
of fewer words than a shingle is one shingle; repeated texts are one node.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import checkpointed, kept, map_texts
from weftgraph.llm.components import components
from weftgraph.llm.minwise import SHINGLE, SIMILARITY, shingle_hashes

BYTES, WIDTH, TABLES, EARLY = 128, 3, 252, 21
#: Bytes of the fingerprint that a posting carries, and the bits of them that may differ.
PREFIX, FAR = 6, 16
PAIRED, LIMIT = 4, 2048
SMALL = 7
#: Postings of a group, about; rows of a batch, whose places are two bytes.
GROUP, BATCH = 1 << 18, 1 << 15
SEED = 42
#: Shingles whose bits are summed at a time, in one byte each.
_PIECE = 255
_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 1 << 63, BYTES // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, BYTES // 8, dtype=np.uint64)
POSITIONS = np.concatenate([_rng.permutation(BYTES)[: BYTES // WIDTH * WIDTH].reshape(-1, WIDTH) for _ in range(-(-TABLES // (BYTES // WIDTH)))])[:TABLES]
FIELDS = T.StructType([T.StructField("sig", T.BinaryType()), T.StructField("small", T.ArrayType(T.LongType()))])


def differing(similarity: float) -> float:
    """The probability that a bit differs at a Jaccard similarity of sets of one size, where it is largest."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def least_shared(similarity: float = SIMILARITY) -> int:
    p = (1 - differing(similarity)) ** 8
    return math.floor(BYTES * p - 2.5 * math.sqrt(BYTES * p * (1 - p)))


def most_apart(similarity: float = SIMILARITY) -> int:
    p = differing(similarity)
    return math.ceil(8 * BYTES * p + 3 * math.sqrt(8 * BYTES * p * (1 - p)))


def wide_simhash(text: str | None, shingle: int = SHINGLE) -> bytes:
    """The SimHash of the distinct shingles of a whole text: a bit is 1 if it is set in over half of them."""
    return _wide(np.unique(shingle_hashes(text, shingle)))


def _wide(h: np.ndarray) -> bytes:
    ones = np.zeros(8 * BYTES, np.int64)
    for at in range(0, len(h), _PIECE):
        x = h[at : at + _PIECE, None] * _FACTORS + _OFFSETS
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h)).tobytes()


def signatures(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """`docs` with `sig`, the wide SimHash, and `small`: hashes of a set of few shingles and of it without each one."""

    def make():
        def run(texts):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
            return {"sig": [_wide(h) for h in sets], "small": [_small(h) for h in sets]}

        return run

    return map_texts(docs, text_col, FIELDS, make, keep)


def _small(h: np.ndarray) -> list[int] | None:
    if not 0 < len(h) <= SMALL + 1:
        return None
    sets = [h, *(np.delete(h, k) for k in range(len(h)))]
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64).tolist()


def small_pairs(sigs: DataFrame) -> DataFrame:
    """Pairs (a, b, bits) of nodes of which one has a shingle more, and no more than SMALL others."""
    few = sigs.where("small is not null").select("node", "small")
    one = few.where(F.size("small") <= SMALL + 1).select(F.col("node").alias("a"), F.col("small")[0].alias("key")).hint("merge")
    more = few.select(F.col("node").alias("b"), F.explode(F.slice("small", 2, SMALL + 1)).alias("key"))
    return more.join(one, "key").select("a", "b", F.lit(0).alias("bits"))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BYTES)


def _posted(places: DataFrame, slices: int, tables: range) -> DataFrame:
    """(bucket, base, payload) of (place, sig, class): the postings of some rows, a row each table and slice of keys."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                place, x = batch.column("place").to_numpy(), _matrix(batch.column("sig"))
                classes = batch.column("class").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
                cuts = np.flatnonzero(np.diff(place) != 1) + 1  # a base counts for consecutive places
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)], strict=True):
                    offsets = np.arange(hi - lo, dtype="<u2").view(np.uint8).reshape(-1, 2)
                    rows = np.concatenate([offsets, x[lo:hi, :PREFIX], classes[lo:hi], np.empty((hi - lo, WIDTH), np.uint8)], axis=1)
                    for t in tables:
                        rows[:, -WIDTH:] = keys = x[lo:hi][:, POSITIONS[t]]
                        part = keys.astype(np.int64) @ [65536, 256, 1] * slices >> 24
                        order = np.argsort(part, kind="stable")
                        found, first = np.unique(part[order], return_index=True)
                        some = np.split(rows[order], first[1:]) if slices > 1 else [rows]
                        payload = [np.ascontiguousarray(r.T).tobytes() for r in some]
                        yield pa.RecordBatch.from_arrays([pa.array((t * slices + found).astype(np.int32)), pa.array(np.full(len(found), place[lo])), pa.array(payload, pa.binary())], names=["bucket", "base", "payload"])

    return places.select("place", "sig", "class").mapInArrow(run, "bucket int, base long, payload binary")


def _earlier(prints: np.ndarray) -> list[tuple[int, int]]:
    """Of some postings of one key, each with the first of the nearest that come before it; nearness is told in steps of 4 bits."""
    out = []
    for i in range(1, len(prints)):
        apart = np.bitwise_count(prints[:i] ^ prints[i])
        k = int((apart >> 2).argmin())
        if apart[k] <= FAR:
            out.append((i, k))
    return out


def list_pairs(keys: np.ndarray, prints: np.ndarray, places: np.ndarray, limit: int = LIMIT, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places whose postings have one key and like prefixes, but not one class (0: none)."""
    classes = np.zeros(len(keys), np.uint64) if classes is None else classes
    mixed = places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort((mixed ^ mixed >> np.uint64(32), keys))
    keys, prints, places, classes = keys[order], prints[order], places[order], classes[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def take(i, j):
        i, j = np.asarray(i, np.int64), np.asarray(j, np.int64)
        near = (np.bitwise_count(prints[i] ^ prints[j]) <= FAR) & ((classes[i] != classes[j]) | (classes[i] == 0))
        found.append((i[near], j[near]))

    for size in range(2, PAIRED + 1):
        some = starts[sizes == size]
        for a in range(size):
            for b in range(a + 1, size):
                take(some + a, some + b)
    for at, size in zip(starts[sizes > PAIRED].tolist(), sizes[sizes > PAIRED].tolist(), strict=True):
        if size > limit:
            take(np.full(size - 1, at), np.arange(at + 1, at + size))
        for lo in range(at, at + size, limit):
            if pairs := _earlier(prints[lo : min(lo + limit, at + size)]):
                i, j = np.array(pairs).T
                take(lo + i, lo + j)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (places[np.concatenate(x)] for x in zip(*found, strict=True))
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return both[0], both[1]


def _meeting(posted: DataFrame, limit: int) -> DataFrame:
    """Pairs (place_a, place_b) from the groups of postings."""

    def run(group):
        rows, base = [], []
        for at, payload in zip(group.column("base").to_pylist(), group.column("payload").to_pylist(), strict=True):
            rows.append(np.frombuffer(payload, np.uint8).reshape(2 + PREFIX + 8 + WIDTH, -1))
            base.append(np.full(rows[-1].shape[1], at))
        x = np.concatenate(rows, axis=1)

        def number(part):
            return sum((p.astype(np.uint64) << np.uint64(8 * i) for i, p in enumerate(part)), np.zeros(x.shape[1], np.uint64))

        offsets, prints, classes, keys = map(number, np.split(x, [2, 2 + PREFIX, 2 + PREFIX + 8]))
        a, b = list_pairs(keys, prints, np.concatenate(base) + offsets.astype(np.int64), limit, classes)
        return pa.table({"place_a": a, "place_b": b})

    return posted.groupBy("bucket").applyInArrow(run, "place_a long, place_b long")


def _tallied(rows: DataFrame, least: int, apart: int) -> DataFrame:
    """Pairs (a, b, bits) of (a, b, x, y) that share the least bytes and differ in so many bits at most."""

    def run(batches):
        for batch in batches:
            x, y = _matrix(batch.column("x")), _matrix(batch.column("y"))
            bits = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32)
            near = pa.array(((x == y).sum(axis=1) >= least) & (bits <= apart))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(bits)], names=["a", "b", "bits"]).filter(near)

    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, bits int")


def candidates(sigs: DataFrame, tables: range, similarity: float = SIMILARITY, limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """Pairs (a, b, bits) of nodes of `sigs` (node, sig, class) that meet in some tables, are not of one class, and pass the tally."""
    places = checkpointed(sigs.select("node", "sig", "class").withColumn("place", F.monotonically_increasing_id()))
    slices = max(1, -(-places.count() // group))
    pairs = kept(_meeting(_posted(places, slices, tables), limit).distinct())
    left = places.select(F.col("place").alias("place_a"), F.col("node").alias("a"), F.col("sig").alias("x")).hint("merge")
    right = places.select(F.col("place").alias("place_b"), F.col("node").alias("b"), F.col("sig").alias("y")).hint("merge")
    rows = pairs.join(left, "place_a").join(right, "place_b")
    return _tallied(rows, least_shared(similarity), most_apart(similarity))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).hint("merge")
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).hint("merge")
    shared = F.size(F.array_intersect("x", "y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def nearest_of(pairs: DataFrame) -> DataFrame:
    """(node, other) for every node of `pairs`: the other end of its pair of fewest bits, then the smallest.

    Each end is summed up by itself, so no row is made for a pair: a cloud of near copies has many.
    """
    sides = [pairs.groupBy(F.col(x).alias("node")).agg(F.min(F.struct("bits", F.col(y).alias("other"))).alias("o")) for x, y in ("ab", "ba")]
    return sides[0].unionByName(sides[1]).groupBy("node").agg(F.min("o").alias("o")).select("node", "o.other")


def near_links(sigs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """Links (a, b) of `sigs` (node long, sig, small), one row a node; `sets_of` gives (node, shingles) of some nodes."""
    early = candidates(sigs.withColumn("class", F.lit(0).cast("long")), range(EARLY), similarity, limit, group)
    early = kept(early.unionByName(small_pairs(sigs)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = [early.select(F.col(x).alias("node")).distinct() for x in "ab"]
    sets = kept(sets_of(ends[0].unionByName(ends[1]).distinct()))
    first = kept(verified(early, sets, similarity))
    classes = components(first).select("node", F.col("root").alias("class")).hint("merge")
    classed = sigs.join(classes, "node", "left").withColumn("class", F.coalesce("class", F.lit(0)))  # a root of 0 only costs rows
    later = kept(candidates(classed, range(EARLY, TABLES), similarity, limit, group))
    nearest = kept(nearest_of(later))
    best = nearest.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    sets = sets.unionByName(kept(sets_of(nearest.select("node").join(sets.select("node").hint("merge"), "node", "left_anti"))))
    first = first.unionByName(kept(verified(best, sets, similarity)))
    roots = components(first)
    rest = later.select("a", "b")
    for end in ("a", "b"):
        of = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")).hint("merge")
        rest = rest.join(of, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    rest = rest.where("root_a != root_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = rest.join(best.hint("merge"), ["a", "b"], "left_anti")  # those have failed
    return first.unionByName(verified(rest, sets, similarity))
