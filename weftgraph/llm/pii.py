"""Personal data: base patterns, and proposed spans scored by boosted trees.

High-recall generators propose overlapping spans (loose addresses, digit groups, account
numbers); boosted trees, fitted in numpy on generated labelled samples whose features
come from the same DataFrame expressions, score each by its format and context; a span
is redacted when its score passes a threshold calibrated on held-out samples. Everything
that touches documents is DataFrame functions.

Defined results: null text has no spans; spans count code points, end exclusive; spans of
the method that overlap a base span are not listed; of spans of the method that overlap
each other the best-scored is, ties go to the longer, then the earlier, then the kind
first in GENERATORS; repeated rows repeat.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.boost import Boosted, fit, threshold
from weftgraph.llm.common import table
from weftgraph.llm.spans import listed, overlaps, with_spans

#: Possessive forms of the base patterns: nothing follows that could need a shorter match,
#: and a local part can only start where a run of its characters starts or a match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The least that a base match must hold, asked before its pattern runs.
MARKS = {"email": "@", "ip": "[0-9][.][0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
GENERATORS = {
    "contact": r"(?:\G|(?<=[\s<>()\[\]\"',;:|]))[^\s<>()\[\]\"',;:|@]++\x20?(?:@|\[at\]|\(at\))\x20?[^\s<>()\[\]\"',;:|@]++",
    "digits": r"(?<![A-Za-z0-9])[(+]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+(?![A-Za-z0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){10,}+(?![A-Za-z0-9])",
}
GENERATOR_MARKS = {"contact": r"@|\[at\]|\(at\)", "digits": r"[0-9](?:[\x20().\-/]{0,2}[0-9]){6}", "account": "[A-Z]{2}[0-9]{2}"}
#: What a mark starts with: where nothing does, a search for any of them tries none.
MARK_STARTS = r"(?=[0-9A-Z@+(\[])"
#: Words near a span that speak for a kind.
CONTEXT_WORDS = {
    "phone": "phone|tel|call|mobile|fax|dial|reach|whatsapp",
    "bank": "iban|account|card|bank|ssn|passport|social|tax|konto",
    "mail": "mail|contact|write|reach|skype|e-mail",
    "number": "order|invoice|version|isbn|issue|page|serial|total|ref|item|build|part",
}
PRECISION, TREES, DEPTH, SAMPLES, SEED = 0.98, 40, 4, 3_000, 5
_BREAK = "\x1e"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(acc, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return acc + F.coalesce(twice, F.lit(0))

    return (F.length(digits) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _ip_ok(match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(F.lit(False)))


def _card_ok(match: Column) -> Column:
    d = _digits(match)
    return F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))


VALID = {
    "email": lambda m: F.lit(True),
    "ip": _ip_ok,
    "card": _card_ok,
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def features(kind: str, x: Column) -> Column:
    """The features of a span as an array of doubles."""
    m, pre, post = x["m"], F.lower(x["pre"]), F.lower(x["post"])
    d = _digits(m)
    size = lambda pattern: F.length(m) - F.length(F.regexp_replace(m, pattern, ""))
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: F.length(g) > 0)
    lengths = F.transform(groups, lambda g: F.length(g))
    numbers = [
        F.lit(list(GENERATORS).index(kind)),
        F.length(m),
        F.length(d),
        size("[A-Za-z]"),
        size("[A-Z]"),
        size(r"[\x20().\-/]"),
        size(r"[.]"),
        size(r"[/]"),
        F.size(groups),
        F.coalesce(F.array_max(lengths), F.lit(0)),
        F.coalesce(F.get(lengths, F.lit(0)), F.lit(0)),
        F.coalesce(F.get(lengths, F.size(lengths) - 1), F.lit(0)),
        m.startswith("+").cast("int"),
        m.rlike(r"^[(0]").cast("int"),
        m.rlike(r"(?:@|at[\])])\x20?[\p{L}0-9-]{2,}(?:[.](?:[\p{L}0-9-]+))+$").cast("int"),
        m.rlike(r"^[\p{L}0-9._%+-]{2,}\x20?[@\[(]").cast("int"),
        F.when(F.length(d).between(12, 19), luhn(d).cast("int")).otherwise(F.lit(-1)),
        *[pre.rlike(f"(?:{w})").cast("int") for w in CONTEXT_WORDS.values()],
        pre.rlike(r"[\p{L}0-9_]$").cast("int"),
        post.rlike(r"^[\p{L}0-9_]").cast("int"),
        pre.rlike(r"[$€#=]\x20?$").cast("int"),
    ]
    return F.array(*[n.cast("double") for n in numbers])


def proposals(df: DataFrame, text_col: str, base: bool = True) -> DataFrame:
    """`df` with the base spans (all that match and hold) and the proposed spans of each generator."""
    marks = (MARKS if base else {}) | GENERATOR_MARKS
    # most texts hold no mark at all, and every question to a text makes a copy of it
    marked = F.when(F.col(text_col).rlike(f"{MARK_STARTS}(?:{'|'.join(marks.values())})"), F.col(text_col))
    df = df.select(*[F.col(f"`{c}`") for c in df.columns], marked.alias("__marked"))
    guards = {k: F.col("__marked").isNotNull() & F.col("__marked").rlike(p) for k, p in marks.items()}
    found = with_spans(df, "__marked", (BASE if base else {}) | GENERATORS, guards).drop("__marked")
    for k in BASE if base else ():
        found = found.withColumn(k, _kept(k))
    return found


def _kept(kind: str) -> Column:
    check = VALID[kind]
    return F.filter(F.col(kind), lambda x: check(x["m"]))


def margin(model: Boosted, f: Column) -> Column:
    """The trees' sum for an array of features."""

    def tree(splits, leaves):
        at = F.lit(1)
        for level, (k, t) in enumerate(splits):
            at = at + F.when(F.get(f, F.lit(k)) > t, 1 << level).otherwise(0)
        return F.element_at(F.array(*[F.lit(float(v)) for v in leaves]), at)

    total = F.lit(model.base)
    for splits, leaves in model.trees:
        total = total + tree(splits, leaves)
    return total


def samples(seed: int = SEED, n: int = SAMPLES) -> list[tuple[str, list[tuple[int, int]]]]:
    """Generated texts with the [start, end) of their personal data."""
    rng = random.Random(seed)
    syllables = ["an", "ber", "con", "de", "el", "fir", "ge", "ha", "in", "ka", "lo", "mi", "no", "per", "ra", "sto", "ti", "un", "ver", "wo"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    num = lambda k: "".join(rng.choices("0123456789", k=k))
    lead = lambda k: rng.choice("123456789") + num(k - 1)

    def luhned(k):
        body = lead(k - 1)
        total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    card = lambda: "/".join((c := luhned(16))[i : i + 4] for i in range(0, 16, 4))
    iban = lambda: " ".join((c := rng.choice(["DE", "FR", "ES", "GB"]) + num(2) + num(18))[i : i + 4] for i in range(0, 22, 4))
    private = [
        (["call ", "phone ", "tel: ", "mobile ", "fax ", "dial ", ""], lambda: rng.choice([f"({num(3)}) {lead(3)}-{num(4)}", f"{lead(3)}-{num(3)}-{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"0{num(2)}/{num(7)}", f"00{lead(2)} {num(3)} {num(6)}"])),
        (["mail ", "contact ", "write to ", "e-mail: ", ""], lambda: rng.choice([f"{word()}.{word()} [at] {word()}.com", f"{word()}(at){word()}.org", f"{word()}ü@{word()}.de", f"{word()}{num(2)}@{word()}ö.fr"])),
        (["iban ", "account ", "bank: ", "konto ", ""], iban),
        (["card ", "card no. ", "bank card ", ""], card),
        (["ssn ", "social security ", "tax id "], lambda: f"{lead(3)}-{num(2)}-{num(4)}"),
    ]
    public = [
        (["order ", "invoice ", "serial ", "item ", "ref ", "", ""], lambda: rng.choice([lead(16), lead(10), lead(13), lead(8), f"{num(4)}-{num(6)}", f"{lead(5)}-{num(5)}-{num(5)}"])),
        (["on ", "since ", "version ", "build ", ""], lambda: rng.choice([f"20{num(2)}-0{rng.randint(1, 9)}-1{num(1)}", f"1{num(1)}.0{rng.randint(1, 9)}.20{num(2)}", f"{num(1)}.{num(2)}.{num(3)}.{num(4)}.{num(2)}", f"20{num(2)}-01-01 10.{num(2)}.{num(2)}", f"{num(2)}/{num(2)}/20{num(2)}"])),
        (["total ", "page ", "from ", ""], lambda: rng.choice([f"{lead(3)} {num(3)} {num(3)}", f"{lead(1)} {num(1)} {num(1)} {num(1)} {num(2)} {num(2)}", f"{lead(4)}-{num(4)}", f"1{num(3)}-1{num(3)}", f"{lead(7)}.{num(4)}"])),
        (["", "the ", "see "], lambda: rng.choice([f"@{word()}", f"{word()}@", f"{num(2)} @ {num(1)}", f"{word()} @{word()}", f"x@{num(1)}"])),
        (["part ", "isbn ", "item ", ""], lambda: rng.choice([f"{rng.choice(['AB', 'ZX', 'QW'])}{num(2)}" + "".join(rng.choices("ABCDEFGHJK", k=12)), f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"AA{num(2)} BB{num(2)} CC{num(2)} DD{num(2)}"])),
    ]
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.randint(1, 8))) + " ", []
        for _ in range(rng.randint(1, 3)):
            is_private = rng.random() < 0.5
            before, make = rng.choice(private if is_private else public)
            text += rng.choice(before)
            thing = make()
            if is_private:
                spans.append((len(text), len(text) + len(thing)))
            text += thing + rng.choice([" ", ". ", ", "]) + " ".join(word() for _ in range(rng.randint(1, 6))) + " "
        out.append((text, spans))
    return out


_MODEL: dict[tuple, tuple[Boosted, float]] = {}


def model(spark: SparkSession, seed: int = SEED, n: int = SAMPLES) -> tuple[Boosted, float]:
    """(trees, least margin), fitted once a process: it depends on the seed and size only."""
    if (seed, n) not in _MODEL:
        made = samples(seed, n)
        texts = spark.range(1).select(F.posexplode(F.split(F.lit(_BREAK.join(t for t, _ in made)), _BREAK)).alias("i", "text"))
        found = proposals(texts, "text", base=False)
        rows = found.select("i", *[_scored_spans(k).alias(k) for k in GENERATORS]).collect()
        x, y, fold = [], [], []
        for r in rows:
            for k in GENERATORS:
                for c in r[k]:
                    near = [min(c.e, e) - max(c.s, s) for s, e in made[r.i][1]]
                    whole = [max(c.e, e) - min(c.s, s) for s, e in made[r.i][1]]
                    x.append(c.f)
                    y.append(float(any(a >= 0.8 * b for a, b in zip(near, whole, strict=True))))
                    fold.append(r.i % 4 == 3)
        x, y, fold = np.array(x), np.array(y), np.array(fold)
        trees = fit(x[~fold], y[~fold], TREES, DEPTH)
        least = threshold(trees.probability(x[fold]), y[fold], PRECISION)
        least = min(max(least, 0.5), 1 - 1e-9)
        _MODEL[seed, n] = trees, float(np.log(least / (1 - least)))
    return _MODEL[seed, n]


def _scored_spans(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), features(kind, x).alias("f")))


def scan_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with arrays of spans email, ip, card, phone and, by the trees, contact, digits, account."""
    trees, least = model(docs.sparkSession)
    new = {*BASE, *GENERATORS, "__best", "__marked"}
    found = proposals(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]), text_col)
    taken = [F.col(k) for k in BASE]
    cols = [F.col(f"`{c}`") for c in found.columns if c not in GENERATORS]
    # one step a projection, so that no expression is computed twice
    found = found.select(*cols, *[F.filter(F.col(k), _outside(taken)).alias(k) for k in GENERATORS])
    found = found.select(*cols, *[F.transform(F.col(k), _with_features(k)).alias(k) for k in GENERATORS])
    found = found.select(*cols, *[F.transform(F.col(k), _with_score(trees, i)).alias(k) for i, k in enumerate(GENERATORS)])
    strong = F.filter(F.concat(*GENERATORS), lambda x: x["score"] >= least)
    found = found.select(*cols, best_apart(strong).alias("__best"))
    return found.select(*cols, *[F.filter("__best", _of_kind(i)).alias(k) for i, k in enumerate(GENERATORS)])


def best_apart(spans: Column) -> Column:
    """Of spans (score, s, e, kind, m) those that overlap no better one, in order of their place."""
    order = lambda x: F.struct((-x["score"]).alias("a"), (x["s"] - x["e"]).alias("b"), x["s"].alias("c"), x["kind"].alias("d"), x.alias("x"))
    ranked = F.array_sort(F.transform(spans, order))
    none = F.slice(spans, 1, 0)
    kept = F.aggregate(ranked, none, lambda done, r: F.when(F.exists(done, lambda d: (d["s"] < r["x"]["e"]) & (r["x"]["s"] < d["e"])), done).otherwise(F.concat(done, F.array(r["x"]))))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x.alias("x")))), lambda r: r["x"])


def _of_kind(i: int):
    return lambda x: x["kind"] == i


def _with_score(trees: Boosted, i: int):
    return lambda x: F.struct(margin(trees, x["f"]).alias("score"), x["s"].alias("s"), x["e"].alias("e"), F.lit(i).alias("kind"), x["m"].alias("m"))


def _outside(others: list[Column]):
    return lambda x: ~overlaps(x, others)


def _with_features(kind: str):
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), features(kind, x).alias("f"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with `redacted`: every found span replaced by [kind]. Input columns named like a kind are replaced."""
    found = scan_pii(docs.drop("redacted", "__done"), text_col)
    every = F.array_sort(F.concat(*[F.transform(k, _named(k)) for k in (*BASE, *GENERATORS)]))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def step(acc, x):
        gap = F.substring(text, acc["n"] + 1, F.greatest(x["s"] - acc["n"], F.lit(0)))
        fresh = x["s"] >= acc["n"]
        return F.struct(F.greatest(acc["n"], x["e"]).alias("n"), F.when(fresh, F.concat(acc["t"], gap, F.lit("["), x["k"], F.lit("]"))).otherwise(acc["t"]).alias("t"))

    done = F.aggregate(every, F.struct(F.lit(0).alias("n"), F.lit("").alias("t")), step)
    return found.withColumn("__done", done).withColumn("redacted", F.concat(F.col("__done.t"), F.substring(text, F.col("__done.n") + 1, F.length(text)))).drop("__done")


def _named(kind: str):
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("k"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = {k: F.col(k) for k in BASE}
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    digest = F.sha2(listed(base, by_start=False), 256).alias("base_sha256")
    every = base | {k: F.col(k) for k in GENERATORS}
    n = sum((F.size(k) for k in every), F.lit(0)).cast("long").alias("n_spans")
    return found.select("doc_id", *counts, digest, listed(every, by_start=False).alias("spans"), n)
