"""Masked pseudo-likelihood: a bidirectional window network scores documents.

Every word is predicted from the two words on either side; a document's score is the sum
of the conditional log-probabilities of its words. Words are counted over all documents.
The vocabulary, whose words have ids of their own, is the most frequent ones; it grows with
the words that occur LEAST times, up to MAX_BASE digits cubed. A word outside it has one
of RARE hashed ids and the probability of that id times its share of the id's tokens, where
one token more stands for all words never seen. Shares are exact for the words of the
largest counts, as many as KNOWN holds; those of smaller counts share alike.

Documents are dealt by a hash of id and text over shards of about SHARD tokens, in the
order of that hash, so the model does not depend on how the table is partitioned. Each
shard trains the network in numpy, from one seeded start, on every position of every
document in it, once; the weights are averaged by windows seen, FAN shards at a time, so
what is gathered grows with the corpus while no task holds more than FAN models. The
model that is broadcast has a fixed size.

The network sums the rows of the words around, each scaled by its place; the output layer
is three softmaxes: a word id is three digits of a base that follows the vocabulary, and
each digit is predicted given those before it, which is a normalised distribution over ids.

Defined results: null or wordless text has no tokens, log-likelihood 0 and a null mean;
an empty table gives no rows; repeated rows repeat.
"""

from __future__ import annotations

import io
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import checkpointed, map_texts, small_batches, table
from weftgraph.llm.decontam import words

SIDE, BASE, HIDDEN = 2, 10, 32
#: Ids of the smallest network; there are more when more words occur LEAST times.
IDS = BASE**3
LEAST, MAX_BASE = 200, 32
#: Ids that all words outside the vocabulary share by hash, and words whose share of them is kept.
RARE, KNOWN = 64, 1_000_000
#: Positions of a training step, and of a stretch of one line in it.
BATCH, STRETCH, RATE, SEED = 2048, 64, 0.05, 3
#: Tokens of a shard, of which there are as many as the corpus needs, and models that one task averages.
SHARD, FAN = 8_000_000, 16
#: Distinct words that a counting task holds before it hands counts on, and tokens scored at once.
HELD, PIECE = 400_000, 8_192
#: Tokens that a training task holds before it learns from them, and hashes that a scoring task remembers.
LINE, MEMO = 256 * BATCH, 200_000
FIELDS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType()), T.StructField("mean_log_likelihood", T.DoubleType())])
_OFFSETS = [j for j in range(-SIDE, SIDE + 1) if j]


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents; counts are combined in each task before the shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        held: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in batch.column(0):
                held.update(words(text.as_py()))
                if len(held) > HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    part = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(dict):
    """Ids of words; unknown words are hashed to a shared id and not kept.

    `base` is that of the digits of ids. `hashes` (sorted) and `shares` are the words
    outside the vocabulary and their log share of an id's tokens, `other` the log share
    that any other word of an id has. `tokens` counts all words of the corpus.
    """

    def __init__(self, ids=(), base: int = BASE, hashes=(), shares=(), other=None, tokens: int = 0) -> None:
        super().__init__(ids)
        self.base, self.tokens, self.memo = base, tokens, {}
        self.hashes, self.shares, self.other = np.asarray(hashes, np.uint64), np.asarray(shares, np.float32), np.zeros(RARE) if other is None else other

    def __reduce__(self):
        return Vocabulary, (dict(self), self.base, self.hashes, self.shares, self.other, self.tokens)

    def bare(self) -> Vocabulary:
        """The ids alone, as training needs them."""
        return Vocabulary(dict(self), self.base, tokens=self.tokens)

    def __missing__(self, word: bytes) -> int:
        return self.hash_of(word) % RARE

    def hash_of(self, word: bytes) -> int:
        """The hash of a word outside the vocabulary; some are remembered, as most come again."""
        h = self.memo.get(word)
        if h is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            h = self.memo[word] = word_hash(word)
        return h

    def log_shares(self, parts: list[bytes], ids: np.ndarray) -> float:
        """The sum of log p(word | id) over words with their ids."""
        h = np.fromiter((self.hash_of(parts[i]) for i in np.flatnonzero(ids < RARE).tolist()), np.uint64)
        return float(self.shares_of(h).sum())

    def shares_of(self, h: np.ndarray) -> np.ndarray:
        """log p(word | id) of words outside the vocabulary, by their hashes; a word of the vocabulary is alone in its id."""
        out = self.other[(h % np.uint64(RARE)).astype(np.int64)]
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == h, self.shares[at], out)
        return out


def word_hash(word: bytes) -> int:
    """Spark's xxhash64 of a string, unsigned."""
    return xxhash.xxh64_intdigest(word, 42)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The most frequent words and their ids, and the shares of the rest in theirs.

    What is gathered is bounded: the words of the vocabulary, one row a distinct count,
    KNOWN hashes, and RARE sums.
    """
    counts = checkpointed(counts)
    levels = sorted(((r.n, r["count"]) for r in counts.groupBy("n").count().collect()), reverse=True)
    often = sum(c for n, c in levels if n >= LEAST)
    base = BASE
    while base < MAX_BASE and base**3 < often + RARE:
        base += 1
    rows = counts.orderBy(F.col("n").desc(), "word").limit(base**3 - RARE).collect()
    ids = {r.word.encode(): RARE + i for i, r in enumerate(rows)}
    if not rows:
        return Vocabulary()
    last = rows[-1]
    rest = counts.where((F.col("n") < last.n) | ((F.col("n") == last.n) & (F.col("word") > last.word)))
    cut, room = last.n + 1, KNOWN
    for n, c in levels:
        if n <= last.n:
            if c > room:
                break
            cut, room = n, room - c
    rest = rest.select(F.xxhash64("word").alias("h"), "n", (F.col("n") < cut).alias("other"))
    sums = rest.groupBy(F.pmod("h", F.lit(RARE)).cast("int").alias("b")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("other"), F.col("n")).otherwise(0)).alias("tokens"), F.sum(F.col("other").cast("long")).alias("words"))
    total, tokens, others = np.zeros(RARE), np.zeros(RARE), np.zeros(RARE)
    for r in sums.collect():
        total[r.b], tokens[r.b], others[r.b] = r.n, r.tokens, r.words
    known = rest.where("not other").select("h", "n").toArrow()
    h, n = known["h"].to_numpy().view(np.uint64), known["n"].to_numpy()
    order = np.argsort(h)
    h, n = h[order], n[order]
    shares = np.log(n) - np.log(total[(h % np.uint64(RARE)).astype(np.int64)] + 1)
    return Vocabulary(ids, base, h, shares, np.log(tokens + 1) - np.log(others + 1) - np.log(total + 1), sum(n * c for n, c in levels))


def ids_of_words(parts: list[bytes], vocab: Vocabulary) -> np.ndarray:
    return ids_and_hashes(parts, vocab)[0]


def ids_and_hashes(parts: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words, and the hashes of those outside the vocabulary, in order; each is hashed once."""
    ids = np.fromiter(map(vocab.get, parts, repeat(-1)), np.int32, len(parts))
    rare = np.flatnonzero(ids < 0)
    h = np.fromiter((vocab.hash_of(parts[i]) for i in rare.tolist()), np.uint64, len(rare))
    ids[rare] = h % np.uint64(RARE)
    return ids, h


def token_ids(text: str | None, vocab: Vocabulary) -> np.ndarray:
    return ids_of_words(words(text), vocab)


def start(seed: int = SEED, base: int = BASE) -> dict[str, np.ndarray]:
    """Rows of words (the last stands beyond a text), scales of places, three digits' weights and rows given earlier digits.

    The last hidden number is always 1, so the last weight of a digit is its bias.
    """
    rng = np.random.default_rng(seed)
    normal = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    m = {"rows": normal(base**3 + 1, HIDDEN), "place": np.ones((2 * SIDE, HIDDEN), np.float32), "out": normal(3, HIDDEN, base), "given": normal(2, base, HIDDEN)}
    m["given"][..., -1] = 0
    return m


def _digits(target: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return target // (base * base), target // base % base, target % base


def _hidden(m: dict, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, 1 + |sum|, softsign of the sum) for stretches of ids with SIDE more on either end; the sum is of the scaled rows around."""
    rows = m["rows"].take(windows, axis=0)
    n = windows.shape[1] - 2 * SIDE
    total = rows[:, :n] * m["place"][0]
    for j, o in enumerate(_OFFSETS[1:], 1):
        total += rows[:, SIDE + o : SIDE + o + n] * m["place"][j]
    total = total.reshape(-1, HIDDEN)
    scale = 1 + np.abs(total)
    h = total / scale
    h[:, -1] = 1
    return rows, scale, h


def _inputs(m: dict, h: np.ndarray, digits) -> list[np.ndarray]:
    """What each digit is predicted from: the words around and the digits before it."""
    second = h + m["given"][0].take(digits[0], axis=0)
    return [h, second, second + m["given"][1].take(digits[1], axis=0)]


def padded_line(ids: list[np.ndarray], base: int = BASE) -> np.ndarray:
    """All documents in one line with pads before, between and after."""
    pad = np.full(SIDE, base**3, np.int32)
    return np.concatenate([pad, *[x for i in ids for x in (i, pad)]])


def window_scores(m: dict, windows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(target | words around) for the middles of some stretches of ids, in order."""
    digits = _digits(target, m["out"].shape[2])
    n, out = np.arange(len(target)), np.zeros(len(target))
    ones = np.ones(m["out"].shape[2], np.float32)
    for i, (k, d) in enumerate(zip(_inputs(m, _hidden(m, windows)[2], digits), digits, strict=True)):
        z = k @ m["out"][i]
        if max(z.max(initial=0), -z.min(initial=0)) > 60:  # only then exp can leave the 32-bit numbers, and maxima of rows are slow
            z -= z.max(axis=1)[:, None]
        out += z[n, d]
        np.exp(z, out=z)
        out -= np.log(z @ ones)
    return out


def log_probabilities(m: dict, ids: list[np.ndarray]) -> np.ndarray:
    """log p(id | both sides) of every token of the documents, in order."""
    base = m["out"].shape[2]
    line = padded_line(ids, base)
    out = [np.zeros(0)]
    for at in range(SIDE, len(line) - SIDE, PIECE):
        part = line[at - SIDE : at + PIECE + SIDE]
        target = part[SIDE : len(part) - SIDE]
        real = target < base**3
        out.append(window_scores(m, part[None], np.where(real, target, 0))[real])
    return np.concatenate(out)


def fresh_sums(m: dict) -> dict[str, np.ndarray]:
    """Adagrad's sums of squares: one a row of the words, one a number elsewhere."""
    return {k: np.zeros(len(v) if k == "rows" else v.shape, np.float32) for k, v in m.items()}


def stretches(line: np.ndarray, base: int, seed: int) -> Iterator[np.ndarray]:
    """Batches of stretches that have every position of a line in their middles once, in a seeded order."""
    n = -(-(len(line) - 2 * SIDE) // STRETCH)
    line = np.concatenate([line, np.full(n * STRETCH + 2 * SIDE - len(line), base**3, np.int32)])
    starts = np.random.default_rng(seed).permutation(n) * STRETCH
    for i in range(0, n, BATCH // STRETCH):
        yield line[starts[i : i + BATCH // STRETCH, None] + np.arange(STRETCH + 2 * SIDE)]


def train_step(m: dict, seen: dict, windows: np.ndarray, rate: float = RATE) -> int:
    """One Adagrad step on the mean negative log-probability of the middles of some stretches; their number."""
    base = m["out"].shape[2]
    target = windows[:, SIDE:-SIDE].reshape(-1)
    real = target < base**3
    n, at = int(real.sum()), np.arange(len(target))
    if not n:
        return 0
    digits = _digits(np.where(real, target, 0), base)
    pads = np.flatnonzero(~real)
    rows, scale, h = _hidden(m, windows)
    ones = np.ones(base, np.float32)
    backs = []
    for i, (k, d) in enumerate(zip(_inputs(m, h, digits), digits, strict=True)):
        z = k @ m["out"][i]
        np.minimum(z, 60, out=z)  # exp of more is no 32-bit number
        np.exp(z, out=z)
        z *= (1 / (z @ ones))[:, None]
        z[at, d] -= 1
        z[pads] = 0
        backs.append(z @ m["out"][i].T)
        backs[i][:, -1] = 0
        _descend(m["out"][i], seen["out"][i], k.T @ z / n, rate)
    below = backs[2]
    for i in (1, 0):  # the rows given a digit take what comes back from all digits after it
        one = np.zeros((len(at), base), np.float32)
        one[at, digits[i]] = 1
        _descend(m["given"][i], seen["given"][i], one.T @ below / n, rate)
        below += backs[i]
    below /= scale * scale * n
    below = below.reshape(len(windows), -1, HIDDEN)
    g, g_place = np.zeros_like(rows), np.empty_like(m["place"])
    for j, o in enumerate(_OFFSETS):
        here = slice(SIDE + o, SIDE + o + below.shape[1])
        g[:, here] += below * m["place"][j]
        g_place[j] = np.einsum("slh,slh->h", rows[:, here], below)
    _descend(m["place"], seen["place"], g_place, rate)
    ids = windows.reshape(-1)
    order = np.argsort(ids.astype(np.uint16), kind="stable")  # ids are at most MAX_BASE cubed; 16 bits sort faster
    ids = ids[order]
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    ids = ids[first]
    sums = np.add.reduceat(g.reshape(-1, HIDDEN).take(order, axis=0), first, axis=0)
    seen["rows"][ids] += np.einsum("ij,ij->i", sums, sums) / HIDDEN
    m["rows"][ids] -= rate * sums / np.sqrt(seen["rows"][ids] + 1e-12)[:, None]
    return n


def _descend(weights: np.ndarray, seen: np.ndarray, g: np.ndarray, rate: float) -> None:
    seen += g * g
    weights -= rate * g / np.sqrt(seen + 1e-12)


def _pack(m: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **m)
    return out.getvalue()


def _unpack(data: bytes) -> dict:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def _merge(packed) -> tuple[int, dict]:
    total, n = None, 0
    for windows, data in packed:
        m = _unpack(data)
        n += windows
        total = {k: v.astype(np.float64) * windows + (0 if total is None else total[k]) for k, v in m.items()}
    return n, {k: (v / n).astype(np.float32) for k, v in total.items()}


def sharded_ids(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> tuple[DataFrame, int]:
    """(shard, h, ids as 16-bit numbers) of all documents that have words, and the number of shards."""
    n = max(1, math.ceil(vocab.tokens / shard))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocab.bare())

    def run(batches):
        ids_of = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [token_ids(t, ids_of).astype("<u2").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["h", "ids"])

    h = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")) if id_col in docs.columns else F.xxhash64(F.col(f"`{text_col}`"))
    found = docs.select(h.alias("h"), F.col(f"`{text_col}`").alias("t")).mapInArrow(run, "h long, ids binary").where(F.length("ids") > 0)
    return found.select(F.pmod("h", F.lit(n)).cast("int").alias("shard"), "h", "ids"), n


def fit(docs: DataFrame, vocab: Vocabulary, text_col: str = "text", id_col: str = "doc_id", shard: int = SHARD) -> dict[str, np.ndarray]:
    """The network, trained on every position of every document; the same for any partitioning."""
    base = vocab.base
    found, n_shards = sharded_ids(docs, vocab, id_col, text_col, shard)
    dealt = found.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "h")

    def train(batches):
        m = seen = None
        held, size, n, now = [], 0, 0, None

        def learn():
            nonlocal held, size, n
            if held:
                n += sum(train_step(m, seen, w) for w in stretches(padded_line(held, base), base, SEED + size))
                held, size = [], 0

        def done():
            learn()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([n], pa.int64()), pa.array([_pack(m)], pa.binary())], names=["part", "n", "model"])

        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != now:
                    if now is not None:
                        yield done()
                    m, n, now = start(base=base), 0, k
                    seen = fresh_sums(m)
                held.append(np.frombuffer(ids.as_buffer(), "<u2").astype(np.int32))
                size += len(held[-1])
                if size >= LINE:
                    learn()
        if now is not None:
            yield done()

    def average(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        n, m = _merge(zip(frame["n"], frame["model"], strict=True))
        return pd.DataFrame({"part": [int(frame["part"].min()) // FAN], "n": [n], "model": [_pack(m)]})

    schema = "part long, n long, model binary"
    models = checkpointed(dealt.select("shard", "ids").mapInArrow(train, schema))
    while n_shards > FAN:
        models = checkpointed(models.groupBy((F.col("part") / FAN).cast("long").alias("g")).applyInPandas(average, schema))
        n_shards = math.ceil(n_shards / FAN)
    rows = models.collect()  # at most FAN models of fixed size
    return _merge((r.n, bytes(r.model)) for r in sorted(rows, key=lambda r: r.part))[1] if rows else start(base=base)


def _sums(x: np.ndarray, parts) -> np.ndarray:
    """The sums of consecutive stretches of `x`, as long as the parts."""
    upto = np.concatenate(([0.0], np.cumsum(x, dtype=np.float64)))
    return np.diff(upto[np.cumsum([0, *map(len, parts)])])


def score(docs: DataFrame, model: dict, vocab: Vocabulary, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with n_tokens, log_likelihood and mean_log_likelihood of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast((model, vocab))

    def make():
        m, ids_of = shared.value

        def run(texts):
            sums, sizes = [], []
            for at in range(0, len(texts), 64):
                parts = [words(t) for t in texts[at : at + 64]]
                ids, rare = zip(*[ids_and_hashes(p, ids_of) for p in parts], strict=True)
                shares = ids_of.shares_of(np.concatenate(rare))
                sums += (_sums(log_probabilities(m, ids), ids) + _sums(shares, rare)).tolist()
                sizes += [len(i) for i in ids]
            return {"n_tokens": sizes, "log_likelihood": sums, "mean_log_likelihood": [s / n if n else None for s, n in zip(sums, sizes, strict=True)]}

        return run

    return map_texts(docs, text_col, FIELDS, make, keep)


def op6_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocab = vocabulary(count_words(docs))
    return score(docs, fit(docs, vocab), vocab, keep=["doc_id"])
