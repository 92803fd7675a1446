"""Validation rules as predicates that are true where a record fails."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftgraph.config import ValidationConfig, ValidationRuleConfig
from weftgraph.functions.patterns import to_java
from weftgraph.functions.pyvalues import column, is_float_text, is_int_text, pystr, try_float, type_of
from weftgraph.sources.paths import reads_files

log = logging.getLogger(__name__)

ERRORS = "_errors"
#: Names of declared types and of the Python types that values have.
EXPECTED = ("str", "int", "float", "bool")
PYTHON_TYPES = {"string": "str", "boolean": "bool", "double": "float", "float": "float", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime"}


def _type_fails(x: Column, kind: T.DataType, expected: str) -> Column:
    if expected == "int":
        if isinstance(kind, T.StringType):
            return ~is_int_text(x)
        return F.isnan(x) | (F.abs(x) == float("inf")) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(not isinstance(kind, (T.NumericType, T.BooleanType)))
    if expected == "float":
        return ~is_float_text(x) if isinstance(kind, T.StringType) else F.lit(not isinstance(kind, (T.NumericType, T.BooleanType)))
    return F.lit(False)


def _regex_fails(text: Column, pattern: str) -> Column:
    """Where `re.match` finds nothing; only what Java cannot say runs as Arrow-batched Python."""
    java = to_java(pattern)
    if java is None:
        return ~F.udf(lambda v: v is None or re.match(pattern, v) is not None, "boolean", useArrow=True)(text)
    return ~text.rlike(java)


def _bound_fails(x: Column, kind: T.DataType, value: Any, low: bool) -> Column:
    """Plain comparisons for numbers, which readers can push down; NaN passes both bounds, as in Python."""
    try:
        bound = float(value)
    except (TypeError, ValueError):
        return F.lit(False)
    n = try_float(x, kind)
    if low:
        fails = n < bound  # NaN is the greatest value, so never below
    else:
        fails = (n > bound) & ~F.isnan(n) if isinstance(kind, (T.StringType, T.DoubleType, T.FloatType)) else n > bound
    return fails if isinstance(kind, (T.NumericType, T.BooleanType)) else F.coalesce(fails, F.lit(False))


def _one_of_fails(x: Column, kind: T.DataType, values: list[Any]) -> Column:
    """Python equality: text equals text only; numbers and booleans are one family."""
    if isinstance(kind, T.StringType):
        same = [v for v in values if isinstance(v, str)]
        return ~x.isin(same) if same else F.lit(True)
    numbers = [v for v in values if isinstance(v, (int, float)) and v == v]
    if isinstance(kind, (T.IntegralType, T.BooleanType)):  # compared as integers, as doubles would take neighbours for equal
        same = {int(v) for v in numbers if abs(v) < 1 << 63 and v == int(v)}
        return ~x.cast("long").isin(sorted(same)) if same else F.lit(True)
    if isinstance(kind, T.DecimalType):
        exact = {Decimal(v) for v in numbers if abs(v) != float("inf")}
        same = [v for v in exact if len(v.as_tuple().digits) <= 38 and v.as_tuple().exponent >= -kind.scale]
        return ~x.isin(same) if same else F.lit(True)
    if isinstance(kind, T.NumericType):
        same = {float(v) for v in numbers if isinstance(v, float) or abs(v) < 1 << 1023 and int(float(v)) == v}
        return ~x.cast("double").isin(sorted(same)) if same else F.lit(True)
    return F.lit(True)


def failure(df: DataFrame, rule: ValidationRuleConfig) -> tuple[Column, Column] | None:
    """Where a rule fails (never null) and its message there. Unknown rules pass and give None."""
    x = column(df, rule.field)
    kind = type_of(df, x)
    text, field, p = pystr(x, kind), rule.field, rule.params
    message: Any = None
    if rule.rule == "required":
        fails = x.isNull() | (x == "") if isinstance(kind, T.StringType) else x.isNull()
        return fails, F.lit(rule.message or f"Field '{field}' is required")
    if rule.rule == "type" and (expected := p.get("expected", "str")) in EXPECTED:
        fails = _type_fails(x, kind, expected)
        named = PYTHON_TYPES.get(kind.simpleString(), "int" if isinstance(kind, T.IntegralType) else "Decimal" if isinstance(kind, T.DecimalType) else "dict")
        message = f"Field '{field}' expected type {expected}, got {named}"
    elif rule.rule == "regex":
        pattern = p.get("pattern", "")
        fails, message = _regex_fails(text, pattern), f"Field '{field}' does not match pattern '{pattern}'"
    elif rule.rule in ("min", "max") and p.get("value") is not None:
        low = rule.rule == "min"
        fails = _bound_fails(x, kind, p["value"], low)
        message = f"Field '{field}' {'below minimum' if low else 'above maximum'} {p['value']}"
    elif rule.rule == "one_of":
        values = p.get("values", [])
        fails = _one_of_fails(x, kind, values)
        message = F.concat(F.lit(f"Field '{field}' must be one of {values}, got '"), text, F.lit("'"))
    else:
        return None
    message = rule.message or message
    return x.isNotNull() & fails, F.lit(message) if isinstance(message, str) else message


def _place(df: DataFrame) -> dict[str, Column]:
    """The split that a row was read from and its number: by file and block where `df` reads files, by partition else."""
    row = F.monotonically_increasing_id()
    part = F.spark_partition_id()
    if reads_files(df):
        return {"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__part": F.lit(0), "__row": row}
    return {"__file": F.lit(""), "__block": F.lit(0).cast("long"), "__part": part, "__row": row}


def _splits(df: DataFrame) -> DataFrame:
    """For each split its first row number and how many records come before it, in the order of files."""
    found = df.select(*[c.alias(n) for n, c in _place(df).items()]).groupBy("__file", "__block", "__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    upto = Window.orderBy("__file", "__block", "__part").rowsBetween(Window.unboundedPreceding, -1)
    return found.select("__file", "__block", "__part", "__first", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__start"))


@dataclass
class Validated:
    """Rows and what each rule makes of them.

    Valid rows are a filter of plain predicates, which stays in generated code; messages
    are made only where rejects are asked for.
    """

    df: DataFrame
    failures: list[tuple[Column, Column]]

    @property
    def bad(self) -> Column:
        return reduce(lambda a, b: a | b, [f for f, _ in self.failures], F.lit(False))

    @property
    def valid(self) -> DataFrame:
        return reduce(lambda d, f: d.where(~f[0]), self.failures, self.df)

    @property
    def checked(self) -> DataFrame:
        """All rows with `_errors`, the messages of all failed rules in rule order."""
        found = [F.when(f, m) for f, m in self.failures]
        errors = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
        return self.df.withColumn(ERRORS, errors)

    def rejects(self) -> DataFrame:
        """(record_index, record, errors); the index is the record's place in its source, from 0."""
        names = self.df.columns
        rows = self.checked.withColumns(_place(self.df)).where(F.size(ERRORS) > 0)
        index = (F.col("__start") + F.col("__row") - F.col("__first")).alias("record_index")
        # both sides hold the columns of _place, which name a split; one row a split is joined
        found = rows.join(_splits(self.df), ["__file", "__block", "__part"])
        return found.select(index, F.struct(*[F.col(f"`{c}`") for c in names]).alias("record"), F.col(ERRORS).alias("errors"))


def apply_rules(df: DataFrame, rules: list[ValidationRuleConfig]) -> Validated:
    return Validated(df, [f for r in rules if (f := failure(df, r)) is not None])


def validate(df: DataFrame, cfg: ValidationConfig | None) -> Validated | None:
    """None without rules. Strategy `fail` raises at the first failed record, with one small job."""
    if cfg is None or not cfg.rules:
        return None
    out = apply_rules(df, cfg.rules)
    if cfg.on_error == "fail":
        first = out.rejects().orderBy("record_index").limit(1).collect()
        if first:
            raise ValueError(f"Validation failed at record {first[0].record_index}: {'; '.join(first[0].errors)}")
    return out
