"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts and documents are lower-cased over A-Z and cut into words of ASCII
letters, digits and characters beyond ASCII. Each word of the benchmark has a code of
WIDTH characters, so every run of `window` consecutive item words (all words of a shorter
item) is a pattern of that many codes; each document becomes a line of codes, is scanned
once, and matches are mapped back to words and to code points of the original.

A benchmark above `block_bytes` is too large for one automaton in a worker. One pass over
the documents then looks up the hashes of their windows among those of the benchmark, 8
bytes each, and keeps the texts that hit any; only these are scanned by one automaton a
block, and the blocks' runs are merged.

Defined results: null or wordless text has no words and no hits; a benchmark without
words marks nothing; repeated items count once; hits of an item with a null id count
as hit words but not as an item. Runs are disjoint and not adjacent, however many blocks
there are.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from functools import reduce
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import kept, map_texts, salted_join, small_batches, table

WINDOW = 10
WIDTH = 3
#: UTF-8 bytes of benchmark text that one automaton takes: about 20 nodes of 40 bytes a word, 130 MB in a worker.
BLOCK_BYTES = 1_000_000
#: Window hashes that one pass over the documents looks up, 8 bytes each in a worker: those of about 200 MB of benchmark.
HASHES = 1 << 25

_KEEP = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
_TABLE = bytes(b if b in _KEEP else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_UNKNOWN = "\0"

_PAIRS = T.ArrayType(T.ArrayType(T.LongType()))
FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", _PAIRS),
        T.StructField("hit_words", _PAIRS),
    ]
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE).split()


def codes(vocabulary: set[bytes]) -> dict[bytes, str]:
    """WIDTH characters for each word, so that no node of the automaton has many children.

    The first character is of an alphabet of its own, so matches start at words only.
    """
    base = max(2, math.ceil(len(vocabulary) ** (1 / WIDTH)))
    while base**WIDTH < len(vocabulary):
        base += 1
    digits = lambda i: ((i // base**k) % base + 1 + base * (k > 0) for k in range(WIDTH))
    return {w: "".join(map(chr, digits(i))) for i, w in enumerate(sorted(vocabulary))}


def automaton(items: list[tuple[str | None, str | None]], window: int = WINDOW):
    """(codes, automaton) over all windows, or None without any; a value is (words in it, ids of its items)."""
    cut = [(item, words(text)) for item, text in items]
    code = codes({w for _, line in cut for w in line})
    found: dict[str, tuple[int, set]] = {}
    for item, line in cut:
        for at in range(max(1, len(line) - window + 1) if line else 0):
            part = line[at : at + window]
            found.setdefault("".join(map(code.__getitem__, part)), (len(part), set()))[1].add(item)
    if not found:
        return None
    built = ahocorasick.Automaton()
    for pattern, value in found.items():
        built.add_word(pattern, value)
    built.make_automaton()
    return code, built


def hits(built, parts: list[bytes]) -> tuple[list[list[int]], set]:
    """Runs [first, after) of words in occurrences of a window, and the items that occur."""
    if built is None or not parts:
        return [], set()
    code, machine = built
    read = list(map(code.get, parts, repeat(_UNKNOWN)))
    matches = list(machine.iter("".join(read)))
    if not matches:
        return [], set()
    ends = np.cumsum(np.fromiter(map(len, read), np.int64, len(read)))
    edge, items = np.zeros(len(parts) + 2, np.int64), set()
    for last, (n, ids) in matches:
        after = int(np.searchsorted(ends, last)) + 1
        edge[after - n + 1] += 1  # shifted by one, so that runs at the start show
        edge[after + 1] -= 1
        items |= ids
    inside = (np.cumsum(edge) > 0).astype(np.int8)
    return np.flatnonzero(np.diff(np.append(inside, 0))).reshape(-1, 2).tolist(), items


def spans(text: str, runs: list[list[int]]) -> list[list[int]]:
    """Runs of words as [start, end) in code points of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw)]
    out, seen, chars = [], 0, 0
    for first, after in runs:
        run = []
        for byte in (at[first][0], at[after - 1][1]):
            chars += len(raw[seen:byte].decode("utf-8", "surrogatepass"))
            seen = byte
            run.append(chars)
        out.append(run)
    return out


_BUILT: dict[str, object] = {}


def _scan(key: str, block, window: int):
    """A function over texts that runs one block's automaton; built once per worker."""

    def make():
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = automaton(block.value, window)
        built = _BUILT[key]

        def scan(texts):
            out: dict[str, list] = {f.name: [] for f in FIELDS}
            for text in texts:
                parts = words(text)
                runs, items = hits(built, parts)
                ids = sorted({str(i) for i in items if i is not None})
                n = sum(b - a for a, b in runs)
                row = (len(parts), n, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), n > 0, ids, spans(text, runs) if runs else [], runs)
                for f, v in zip(FIELDS, row, strict=True):
                    out[f.name].append(v)
            return out

        return scan

    return make


def window_hashes(parts: list[bytes], lengths: list[int]) -> np.ndarray:
    """The hash of every run of words of the given lengths."""
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in parts), np.uint64, len(parts))
    out, acc = [], np.zeros(len(h), np.uint64)
    for n in range(1, min(max(lengths, default=0), len(h)) + 1):
        acc = acc[: len(h) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + h[n - 1 :]
        if n in lengths:
            out.append((acc ^ (acc >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _hashed(items: DataFrame, window: int) -> DataFrame:
    """(n, h): word counts and hashes of all benchmark windows, distinct."""
    small_batches(items.sparkSession)

    def run(batches):
        for batch in batches:
            for text in batch.column(0):
                line = words(text.as_py())
                n = min(len(line), window)
                h = np.unique(window_hashes(line, [n])).view(np.int64) if n else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n), pa.int32()), pa.array(h)], names=["n", "h"])

    return items.select("t").mapInArrow(run, "n int, h long").distinct()


def _suspects(docs: DataFrame, text_col: str, hashes: DataFrame, lengths: list[int], keys: list[str]) -> DataFrame:
    """(keys, text), once, of the texts in which a window's hash occurs."""
    known = docs.sparkSession.sparkContext.broadcast(np.sort(hashes.select("h").toArrow()["h"].to_numpy().view(np.uint64)))

    def make():
        def run(texts):
            out = []
            for text in texts:
                h = window_hashes(words(text), lengths)
                at = np.minimum(np.searchsorted(known.value, h), len(known.value) - 1)
                out.append(bool((known.value[at] == h).any()) if len(h) else False)
            return {"__suspect": out}

        return run

    found = map_texts(docs, text_col, T.StructType([T.StructField("__suspect", T.BooleanType())]), make, [*keys, text_col])
    return found.where("__suspect").dropDuplicates(keys).select(*keys, F.col(f"`{text_col}`").alias("__text"))


def _merged(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One row of (keys, items, runs) from the hits of several blocks, whose runs may overlap or touch."""
    runs = F.array_sort(F.flatten(F.collect_list(F.zip_with("hit_words", "hit_spans", lambda w, c: F.struct(w[0].alias("a"), w[1].alias("b"), c[0].alias("c"), c[1].alias("d"))))))
    rows = hits.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("__items"), runs.alias("__runs"))
    kind = "array<struct<a:bigint,b:bigint,c:bigint,d:bigint>>"

    def step(done, r):
        last = F.element_at(done, -1)
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], r["b"]).alias("b"), last["c"].alias("c"), F.greatest(last["d"], r["d"]).alias("d"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (r["a"] <= F.try_element_at(done, F.lit(-1))["b"]), joined).otherwise(F.concat(done, F.array(r)))

    return rows.withColumn("__runs", F.aggregate("__runs", F.array().cast(kind), step))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
    hashes: int = HASHES,
) -> DataFrame:
    """`docs` with the columns of FIELDS; hit_words are runs [first, after) of word numbers.

    The benchmark is a stated query set: its size is measured, and it reaches the
    executors in blocks of about `block_bytes`, or as `hashes` window hashes at a time.
    """
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))

    def scan(df: DataFrame, b: int, column: str, columns: list[str] | None) -> DataFrame:
        rows = items if n == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == b)
        block = sc.broadcast([(r.i, r.t) for r in rows.collect()])
        return map_texts(df, column, FIELDS, _scan(uuid.uuid4().hex, block, window), columns)

    if n == 1:
        return scan(docs, 0, text_col, keep)
    # what a text hits depends on nothing else, so its two hashes name it
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    keys = ["__hash", "__hash2"]
    keyed = docs.withColumns({"__hash": F.xxhash64(text), "__hash2": F.xxhash64(F.lit(1), text)})
    windows = kept(_hashed(items, window))
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # at most `window` numbers
    passes = max(1, math.ceil(windows.count() / hashes))
    parts = [windows.where(F.pmod("h", F.lit(passes)) == k) for k in range(passes)]
    suspects = kept(reduce(lambda a, b: a.unionByName(b), [_suspects(keyed, text_col, p, lengths, keys) for p in parts]).dropDuplicates(keys))
    hits = [kept(scan(suspects, b, "__text", keys).where("contaminated").select(*keys, "item_ids", "hit_spans", "hit_words")) for b in range(n)]
    merged = _merged(reduce(lambda a, b: a.unionByName(b), hits), keys)

    def make():
        return lambda texts: {"n_words": [len(words(t)) for t in texts]}

    names = {f.name.lower() for f in FIELDS}
    columns = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    counted = map_texts(keyed.withColumn("__row", F.monotonically_increasing_id()), text_col, T.StructType([FIELDS["n_words"]]), make, [*columns, *keys, "__row"])
    rows = salted_join(counted, merged, keys, ["__row"], how="left")
    pairs = lambda a, b: F.coalesce(F.transform("__runs", lambda r: F.array(r[a], r[b])), F.array().cast(_PAIRS))
    rows = rows.withColumns({"item_ids": F.coalesce("__items", F.array().cast("array<string>")), "hit_spans": pairs("c", "d"), "hit_words": pairs("a", "b")})
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda acc, r: acc + r[1] - r[0])
    rows = rows.withColumns({"n_hit": n_hit, "n_items": F.size("item_ids").cast("long"), "items_sha256": F.sha2(F.array_join("item_ids", ","), 256)})
    return rows.withColumn("contaminated", F.col("n_hit") > 0).select(*[F.col(f"`{c}`") for c in columns], *FIELDS.names)


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n,
               array_to_string(list_slice(w, pos, pos + 9), ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, n, pos, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS k
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM dw, lens WHERE len(w) >= n)),
m AS (SELECT d.doc_id, d.pos, d.n, b.item_id FROM dwin d JOIN win b ON d.n = b.n AND d.k = b.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
