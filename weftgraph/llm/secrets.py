"""Secret scan with DataFrame functions: fixed patterns, and tokens that read as random.

The method beside the patterns: two character Markov chains, one of random strings and
one of ordinary identifiers, are trained from labelled samples; a token is a secret when
the log-likelihood ratio of its characters passes the threshold for its length, which was
calibrated on identifiers and words held out from training. Nothing but the ratio decides
over tokens of LEAST characters or more; shorter ones hold too little to tell.

Defined results: null text has no spans; spans count code points, end exclusive; a token
that overlaps a fixed pattern's span is not listed again; repeated rows repeat; a table
without words is scanned with a model of a few common ones.
"""

from __future__ import annotations

import math
import random
import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import table
from weftgraph.llm.spans import listed, overlaps, with_spans

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Longest runs, so the least length can stand in the pattern without changing matches.
BASE = {"assign": _ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
LEAST = 16
TOKEN = rf"[A-Za-z0-9+/=_-]{{{LEAST},}}"
#: Sampled documents (about so many, by a hash), distinct words kept of all their text, and made strings of each kind.
SAMPLE_DOCS, SAMPLE_WORDS, MADE = 400, 8_000, 8_000
#: The share of held-out identifiers of a length that may pass as random, and the first lengths of the classes.
ALPHA, SEED = 0.0005, 11
LENGTHS = (16, 18, 20, 24, 28, 32, 40, 56)
#: Words of names in programs and addresses, for tables that have few of their own.
COMMON = """name value index count total user file path list data type time date number string test error message service client server
request response config default version update delete create table column query result output input account address project image style
script source target method module package public private static final class object property element content page node link
example abstract factory context export import job exit next text max box key quick jump proxy bean view expression function variable
the of and that with from this have which their about would there other people water world through between because before little
system program question government company night point home room mother area money story fact month right study book word business
issue side kind head house friend father power hour game line end member law car city community president team minute idea body
information back parent face others level office door health person art war history party change morning reason research girl guy
moment air teacher force education foot boy age policy music market sense nation plan college interest death experience effect""".split()
_ALPHABET = string.ascii_letters + string.digits
_N = len(_ALPHABET) + 1  # and one code for all other characters


def _codes(token: str) -> list[int]:
    return [_ALPHABET.find(c) % _N for c in token]  # find gives -1 for the rest


def chain(tokens: Iterable[str], smooth: float = 0.5) -> list[list[float]]:
    """Log transition probabilities between character codes."""
    counts = [[smooth] * _N for _ in range(_N)]
    for t in tokens:
        c = _codes(t)
        for a, b in zip(c, c[1:], strict=False):
            counts[a][b] += 1
    return [[math.log(x / sum(row)) for x in row] for row in counts]


def random_strings(rng: random.Random, n: int) -> list[str]:
    kinds = ["0123456789abcdef", _ALPHABET, _ALPHABET, _ALPHABET + "+/", _ALPHABET + "-_", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters]
    return ["".join(rng.choices(rng.choice(kinds), k=rng.randint(LEAST, 64))) for _ in range(n)]


def identifiers(rng: random.Random, words: list[str], n: int) -> list[str]:
    """Names, paths, slugs, dates and numbers as programs and addresses have them, of given words."""
    out = []
    for _ in range(n):
        parts = [w.strip("_") or "x" for w in rng.choices(words, k=rng.randint(2, 9))]
        parts = [w if rng.random() < 0.3 else w.lower() for w in parts]
        kind = rng.randrange(8)
        if kind == 0:
            name = "_".join(parts)
        elif kind == 1:
            name = "-".join(parts)
        elif kind == 2:
            name = "/".join(parts)
        elif kind == 3:
            name = "".join(p[:1].upper() + p[1:] for p in parts)
        elif kind == 4:
            name = parts[0] + "".join(p[:1].upper() + p[1:] for p in parts[1:])
        elif kind == 5:
            name = "".join(parts)
        elif kind == 6:  # rulers and counts
            unit = rng.choice([rng.choice("=-_/+"), rng.choice(_ALPHABET), "=-", "01", "1234567890", "abcdefghijklmnopqrstuvwxyz", "/-", "+-"])
            name = (unit * 80)[: rng.randint(LEAST, 80)]
        else:
            number = lambda: str(rng.randrange(10 ** rng.randint(1, 6)))
            date = f"{rng.randint(1950, 2035)}{rng.choice(['-', '/', ''])}{rng.randint(1, 12):02d}{rng.choice(['-', '/', ''])}{rng.randint(1, 31):02d}"
            bits = [rng.choice([number(), date, *parts[:2]]) for _ in range(rng.randint(3, 6))]
            name = rng.choice("-_/").join(bits)
        if rng.random() < 0.4:
            name += rng.choice(["", "_", "-", "/"]) + str(rng.randrange(10 ** rng.randint(1, 5)))
        out.append(name.upper() if rng.random() < 0.12 else name)
    return out


def train(words: list[str], seed: int = SEED) -> tuple[list[float], list[float]]:
    """(log ratios by pair of character codes, thresholds by class of length) from ordinary words.

    A threshold is at least the logarithm of 1 / ALPHA; a class of few held-out names has at least that of the class before.
    """
    rng = random.Random(seed)
    words = sorted({*words, *COMMON})
    rng.shuffle(words)
    half = words[::2], words[1::2]
    learn, held = identifiers(rng, half[0], MADE), identifiers(rng, half[1], 4 * MADE) + [w for w in half[1] if len(w) >= LEAST]
    repeats = [c * 40 for c in _ALPHABET for _ in range(4)]  # any character may be drawn out, not only those that chance has shown
    noise, plain = chain(random_strings(rng, MADE)), chain([*half[0], *learn, *repeats])
    ratio = [noise[a][b] - plain[a][b] for a in range(_N) for b in range(_N)]
    held = [(len(t), score(ratio, t)) for t in held if len(t) >= LEAST]
    least, bounds = [], [*LENGTHS, math.inf]
    for low, high in zip(bounds, bounds[1:], strict=False):
        scores = sorted(s for n, s in held if low <= n < high)
        cut = scores[min(len(scores) - 1, int((1 - ALPHA) * len(scores)))] if scores else 0.0
        least.append(max(-math.log(ALPHA), cut, *([] if len(scores) >= 1 / ALPHA else least[-1:])))
    return ratio, least


def score(ratio: list[float], token: str) -> float:
    c = _codes(token)
    return sum(ratio[a * _N + b] for a, b in zip(c, c[1:], strict=False))


def score_column(ratio: list[float], token: Column) -> Column:
    numbers = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")  # folded into one literal
    where = F.split(F.lit(",".join(str(_ALPHABET.find(chr(i)) % _N) for i in range(128))), ",").cast("array<int>")
    code = lambda at: F.coalesce(F.get(where, F.ascii(F.substring(token, at, F.lit(1)))), F.lit(_N - 1))
    step = lambda acc, i: acc + F.element_at(numbers, code(i - 1) * _N + code(i) + 1)
    return F.aggregate(F.sequence(F.lit(2), F.length(token)), F.lit(0.0), step)


def threshold_column(least: list[float], token: Column) -> Column:
    out = F.lit(least[0])
    for n, cut in zip(LENGTHS[1:], least[1:], strict=True):
        out = F.when(F.length(token) >= n, cut).otherwise(out)
    return out


def sample_words(docs: DataFrame, id_col: str, text_col: str) -> list[str]:
    """At most SAMPLE_WORDS ordinary words of the whole texts of about SAMPLE_DOCS documents, both chosen by a hash."""
    n = docs.count()
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(SEED)), F.lit(1 << 30))
    some = docs.where(draw < min(1.0, SAMPLE_DOCS / max(n, 1)) * (1 << 30))
    words = some.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit("[A-Za-z_]{2,40}"), F.lit(0)))).alias("w")).distinct()
    return [r.w for r in words.orderBy(F.xxhash64("w", F.lit(SEED)), "w").limit(SAMPLE_WORDS).collect()]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with arrays of spans assign, access, hex and random (start s, end e, match m, context)."""
    ratio, least = train(sample_words(docs, id_col, text_col))
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*BASE, "random"}])
    found = with_spans(kept, text_col, BASE | {"random": TOKEN})
    strong = F.filter(F.col("assign"), lambda x: F.length(F.regexp_extract(x["m"], _ASSIGN, 2)) >= 8)
    found = found.withColumn("assign", strong)
    base = [F.col(k) for k in BASE]
    passes = lambda x: score_column(ratio, x["m"]) > threshold_column(least, x["m"])
    return found.withColumn("random", F.filter(F.filter(F.col("random"), passes), lambda x: ~overlaps(x, base)))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = {k: F.col(k) for k in BASE}
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    digest = F.sha2(listed(base, by_start=True), 256).alias("base_sha256")
    every = base | {"random": F.col("random")}
    n = sum((F.size(k) for k in every), F.lit(0)).cast("long").alias("n_spans")
    return found.select("doc_id", *counts, digest, listed(every, by_start=True).alias("spans"), n)
