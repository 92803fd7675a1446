"""What keeps the driver's memory and the methods of stages as they should be at size."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import common, lmscore, minwise, pii, simhash, widehash


def test_salted_joins_broadcast_nothing(spark):
    """A table below Spark's bound is larger by far once it is repeated and hashed."""
    many = spark.range(1000).select((F.col("id") % 10).alias("k"), F.col("id").alias("v"))
    one = spark.range(10).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    for how in ("inner", "left"):
        found = common.salted_join(many, one, ["k"], ["v"], how=how)
        assert found.count() == 1000
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def shingles(text):
    return set(minwise.shingle_hashes(text).tolist())


def test_wide_simhash():
    """A bit is 1 if it is set in over half of the distinct shingles."""
    text = " ".join(words(random.Random(1), 700)) + " a b c d e a b c d e a b c d e"
    m = (1 << 64) - 1
    ones, sets = [0] * 1024, shingles(text)
    for h in sets:
        for w in (0, 9, 15):
            x = (h * int(widehash._FACTORS[w]) + int(widehash._OFFSETS[w])) & m
            x = ((x ^ x >> 31) * 0xBF58476D1CE4E5B9) & m
            for k, byte in enumerate((x ^ x >> 29).to_bytes(8, "little")):
                for bit in range(8):
                    ones[64 * w + 8 * k + bit] += byte >> (7 - bit) & 1
    got = np.unpackbits(np.frombuffer(widehash.wide_simhash(text), np.uint8))
    for w in (0, 9, 15):
        assert got[64 * w : 64 * w + 64].tolist() == [2 * n > len(sets) for n in ones[64 * w : 64 * w + 64]]
    assert widehash.wide_simhash(None) == widehash.wide_simhash(" ") == bytes(widehash.BYTES)
    assert len(np.unique(widehash.POSITIONS[:42])) == 126 and all(len(set(p)) == 3 for p in widehash.POSITIONS.tolist())


@pytest.mark.parametrize("limit", [3, 2048])
def test_near_dedup_keeps_the_steps_of_its_method(spark, limit):
    """SimHash, index of positional bytes, tally, verification; the links are those of brute force."""
    rng = random.Random(3)
    texts = []
    for n in (8, 9, 14, 40, 300):
        for _ in range(12):
            base = words(rng, n)
            texts += [base, base + words(rng, 1), base[: n // 2] + words(rng, max(1, n // 80)) + base[n // 2 :], base[: n // 2] + words(rng, n - n // 2)]
    cloud = words(rng, 200)  # a list longer than the limit
    texts += [cloud[:k] + words(rng, 1) + cloud[k + 1 :] for k in rng.choices(range(200), k=40)]
    texts = [" ".join(t) for t in texts] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    sigs = widehash.signatures(rows, "text", ["node"])
    sets = minwise.shingle_sets(rows)
    links = {(r.a, r.b) for r in widehash.near_links(sigs, lambda nodes: sets.join(nodes, "node", "left_semi"), limit=limit, group=100).collect()}
    all_sets = [shingles(t) for t in texts]
    near = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if all_sets[a] and 5 * len(all_sets[a] & all_sets[b]) >= 4 * len(all_sets[a] | all_sets[b])}
    assert {(min(p), max(p)) for p in links if all_sets[p[0]]} <= near
    roots, truth = ({x: r for x, r in simhash_classes(some, len(texts)).items()} for some in (links, near))
    together = [(a, b) for a, b in near if truth[a] == truth[b]]
    assert np.mean([roots[a] == roots[b] for a, b in together]) >= 0.97
    small = [(a, b) for a, b in near if len(all_sets[a] | all_sets[b]) <= widehash.SMALL + 1]
    assert len(small) >= 12 and all(roots[a] == roots[b] for a, b in small)
    found = simhash.near_duplicates(rows, "node", shingle=5, similarity=0.8).where("id = 7").first()
    want = spark.createDataFrame([(bytearray(widehash.wide_simhash(texts[7])),)], "sig binary").select(F.xxhash64("sig").alias("h")).first().h
    assert found["print"] == want


def simhash_classes(links, n):
    from weftgraph.llm.components import union_find

    return {x: x for x in range(n)} | union_find(links)


def test_nearest_pairs_are_found_without_a_row_for_each_pair(spark):
    """Of a cloud's many pairs each node has one, and no plan turns a pair into two rows."""
    rng = random.Random(4)
    both = {(a, b): rng.randrange(9) for a, b in itertools.combinations(range(40), 2)}
    pairs = spark.createDataFrame([(*(p if rng.random() < 0.5 else p[::-1]), n) for p, n in both.items()], "a long, b long, bits int")
    found = widehash.nearest_of(pairs)
    want = {x: min((n, a + b - x) for (a, b), n in both.items() if x in (a, b))[1] for x in range(40)}
    assert sorted(map(tuple, found.collect())) == sorted(want.items())
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_clouds_do_not_meet_again_in_every_table(spark, monkeypatch):
    """What is in one class by the first tables is no pair of the others; what is not in it still meets all."""
    rng = random.Random(6)
    cloud, other = words(rng, 150), words(rng, 150)
    texts = [cloud[:k] + words(rng, 1) + cloud[k + 1 :] for k in rng.sample(range(150), 80)]  # 0.87 with each other
    texts += [cloud + words(rng, 20), other, other[:75] + words(rng, 2) + other[77:]]
    rows = spark.createDataFrame(list(enumerate(map(" ".join, texts), 1)), "node long, text string")
    meeting, made = widehash._meeting, []
    monkeypatch.setattr(widehash, "_meeting", lambda *args: made.append(found := meeting(*args)) or found)
    sets = minwise.shingle_sets(rows)
    links = widehash.near_links(widehash.signatures(rows, "text", ["node"]), lambda nodes: sets.join(nodes, "node", "left_semi"))
    roots = simhash_classes([(r.a, r.b) for r in links.collect()], len(texts) + 1)
    assert len({roots[x] for x in range(1, 82)}) == 1 and roots[82] == roots[83] != roots[1]
    assert sum(found.count() for found in made) <= 2 * widehash.EARLY * len(texts)
    place, classes = np.arange(6), np.array([7, 7, 0, 0, 8, 7], np.uint64)
    a, b = widehash.list_pairs(np.array([0, 0, 1, 1, 2, 2], np.uint64), np.zeros(6, np.uint64), place, classes=classes)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(2, 3), (4, 5)]


def test_hot_lists_are_linked_whole():
    """Postings of one key above every limit stay connected, in links that grow with their number only."""
    rng = np.random.default_rng(5)
    print_ = np.uint64(rng.integers(1 << 48))
    prints = np.array([print_ ^ np.uint64(1 << int(b)) for b in rng.integers(0, 48, 5000)], np.uint64)
    a, b = widehash.list_pairs(np.zeros(5000, np.uint64), prints, np.arange(5000), limit=64)
    assert len(set(simhash_classes(zip(a.tolist(), b.tolist(), strict=True), 5000).values())) == 1 and len(a) <= 15_000
    assert widehash.list_pairs(np.arange(9, dtype=np.uint64), prints[:9], np.arange(9))[0].size == 0


def test_pii_copies_no_text_without_a_mark(spark, monkeypatch):
    """One search tells whether a text holds any mark; the seven patterns and their marks see only those that do."""
    rng = random.Random(7)
    texts = [t for t, _ in pii.samples(3, 200)] + ["".join(rng.choices("aZ09@+.[(t) at]-/\u00fc", k=rng.randrange(30))) for _ in range(2000)]
    texts += ["no mark (a) [b] 1 Q +", "a [at] b", "a (at) b", "AB12", "1.2", "+4", "1 2 3 4 5 6 7", "", None]
    seen, spans = [], pii.with_spans
    monkeypatch.setattr(pii, "with_spans", lambda df, col, *rest: seen.append(df.select("i", col)) or spans(df, col, *rest))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert pii.proposals(rows, "text").columns == ["i", "text", *pii.BASE, *pii.GENERATORS]
    marks = [re.compile(p) for p in (pii.MARKS | pii.GENERATOR_MARKS).values()]
    want = [t if t and any(p.search(t) for p in marks) else None for t in texts]
    assert [t for _, t in sorted(map(tuple, seen[0].collect()))] == want and 100 < sum(t is None for t in want) < len(texts) - 100


def test_scoring_hashes_a_word_once():
    """Ids and shares of words outside the vocabulary come from one hash of each."""

    class Counted(lmscore.Vocabulary):
        calls = 0

        def hash_of(self, word):
            self.calls += 1
            return super().hash_of(word)

    known = np.array([lmscore.word_hash(b"x")], np.uint64)
    vocab = Counted({b"a": lmscore.RARE, b"b": lmscore.RARE + 1}, hashes=known, shares=[-0.5], other=np.linspace(-9, -3, lmscore.RARE), tokens=9)
    parts = [b"a", b"x", b"b", b"y", b"x", b"a"]
    ids, h = lmscore.ids_and_hashes(parts, vocab)
    assert vocab.calls == 3 and h.tolist() == [lmscore.word_hash(w) for w in (b"x", b"y", b"x")]
    assert ids.tolist() == [vocab[w] for w in parts] == lmscore.ids_of_words(parts, vocab).tolist()
    assert np.isclose(vocab.shares_of(h).sum(), vocab.log_shares(parts, ids)) and vocab.shares_of(h)[[0, 2]].tolist() == [-0.5, -0.5]
    empty = lmscore.ids_and_hashes([], vocab)
    assert [len(x) for x in empty] == [0, 0] and vocab.shares_of(empty[1]).size == 0


@pytest.mark.parametrize("scale", [1, 3e3])
def test_scores_are_normalised_at_any_size_of_weights(scale):
    """The maximum of a row is only taken off where exp needs it; what exp cannot hold is no error."""
    m = {k: v * np.float32(scale if k == "out" else 1) for k, v in lmscore.start().items()}
    around = np.tile(np.array([[3, 5, 0, 7, lmscore.IDS]], np.int32), (lmscore.IDS, 1))
    got = lmscore.window_scores(m, around, np.arange(lmscore.IDS))
    assert np.isfinite(got).all() and abs(np.exp(got).sum() - 1) < 1e-3
    h = lmscore._hidden(m, around[:1])[2]
    z = (h @ m["out"][0]).astype(float)[0]
    first = np.exp(got).reshape(lmscore.BASE, -1).sum(axis=1)
    assert np.allclose(first, np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-3) and (abs(z).max() > 60) == (scale > 1)
