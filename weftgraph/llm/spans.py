"""Regular-expression matches as spans, with DataFrame functions only.

`split` and `regexp_extract_all` cut a text into gaps and matches in one left-to-right
pass each; running sums of their lengths give [start, end) in code points. Sums run in
chunks, so a text with very many matches stays near linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256
#: Characters of context kept on each side of a match.
CONTEXT = 24
SPAN = "struct<s:int,e:int,m:string,pre:string,post:string>"
SPANS = f"array<{SPAN}>"


def _shift(span: Column, by: Column) -> Column:
    return F.struct((span["s"] + by).alias("s"), (span["e"] + by).alias("e"), span["m"].alias("m"), span["pre"].alias("pre"), span["post"].alias("post"))


def _running(cuts: Column) -> Column:
    """struct(length covered, spans) of some cuts from position 0."""

    def step(acc, c):
        start = acc["n"] + c["gap"]
        end = start + F.coalesce(F.length(c["m"]), F.lit(0))
        span = F.struct(start.alias("s"), end.alias("e"), c["m"].alias("m"), c["pre"].alias("pre"), c["post"].alias("post"))
        return F.struct(end.alias("n"), F.when(c["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    return F.aggregate(cuts, F.struct(F.lit(0).alias("n"), F.array().cast(SPANS).alias("out")), step)


def with_spans(df: DataFrame, text_col: str, patterns: dict[str, str], guards: dict[str, Column] | None = None) -> DataFrame:
    """`df` with one column of spans (empty, never null) for each named Java pattern.

    A pattern must not match the empty string. `guards` are conditions that must hold
    wherever the pattern can match.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = {k: (guards or {}).get(k, F.lit(True)) & text.rlike(p) for k, p in patterns.items()}
    cols = [F.col(f"`{c}`") for c in df.columns]
    df = df.select(
        *cols,
        *[F.when(found[k], F.split(text, p, -1)).alias(f"__gaps_{k}") for k, p in patterns.items()],
        *[F.when(found[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(f"__found_{k}") for k, p in patterns.items()],
    )

    def cuts(k: str) -> Column:
        gaps, found = F.col(f"__gaps_{k}"), F.col(f"__found_{k}")
        near = F.zip_with(gaps, F.slice(gaps, F.lit(2), F.size(gaps)), lambda a, b: F.struct(F.length(a).alias("gap"), F.right(a, F.lit(CONTEXT)).alias("pre"), F.left(b, F.lit(CONTEXT)).alias("post")))
        return F.zip_with(near, found, lambda a, m: F.struct(a["gap"].alias("gap"), a["pre"].alias("pre"), a["post"].alias("post"), m.alias("m")))

    df = df.select(*cols, *[cuts(k).alias(f"__cuts_{k}") for k in patterns])

    def all_spans(k: str) -> Column:
        c = F.col(f"__cuts_{k}")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / CHUNK).cast("int")), lambda i: _running(F.slice(c, (i * CHUNK + 1).cast("int"), F.lit(CHUNK))))

        def join(acc, part):
            moved = F.transform(part["out"], lambda s: _shift(s, acc["n"]))
            return F.struct((acc["n"] + part["n"]).alias("n"), F.concat(acc["out"], moved).alias("out"))

        spans = F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.array().cast(SPANS).alias("out")), join)["out"]
        return F.when(c.isNull(), F.array().cast(SPANS)).otherwise(spans)

    return df.select(*cols, *[all_spans(k).alias(k) for k in patterns])


def overlaps(span: Column, others: list[Column]) -> Column:
    out = F.lit(False)
    for o in others:
        out = out | F.exists(o, lambda b: (b["s"] < span["e"]) & (span["s"] < b["e"]))
    return out


def listed(kinds: dict[str, Column], by_start: bool) -> Column:
    """kind:start:end of all spans, comma-joined, by start then kind as listed or the other way."""
    order = list(kinds)

    def tagged(k: int, spans: Column) -> Column:
        a, b = ("s", "k") if by_start else ("k", "s")
        value = {"s": lambda x: x["s"], "k": lambda x: F.lit(k)}
        return F.transform(spans, lambda x: F.struct(value[a](x).alias("a"), value[b](x).alias("b"), x["e"].alias("e")))

    names = F.array(*[F.lit(n) for n in order])
    rows = F.array_sort(F.concat(*[tagged(k, kinds[n]) for k, n in enumerate(order)]))
    start, kind = ("a", "b") if by_start else ("b", "a")
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", F.element_at(names, x[kind] + 1), x[start].cast("string"), x["e"].cast("string"))), ",")
