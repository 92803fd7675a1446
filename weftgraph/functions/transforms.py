"""Field transforms: each a function from a column (and its type) to a column.

Null stays null in all but `default`. A value that a transform cannot take is an error
that fails the job, as no transform has a null meaning for it.
"""

from __future__ import annotations

import datetime
import string
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.config import TransformConfig
from weftgraph.functions.datetimes import spark_pattern
from weftgraph.functions.pyvalues import empty, pyfloat, pyint, pystr, strip, type_of
from weftgraph.registry import transform_registry


def _built_in(name: str) -> Callable:
    """Register a transform that is told the column's type."""

    def add(fn: Callable) -> Callable:
        fn.typed = True
        return transform_registry.register(name)(fn)

    return add


def _number(read: Callable) -> Callable:
    return lambda x, kind, **_: F.when(~empty(x, kind), read(x, kind))


_built_in("to_int")(_number(pyint))
_built_in("to_float")(_number(pyfloat))


@_built_in("to_string")
def to_string(x: Column, kind: T.DataType, **_: Any) -> Column:
    return pystr(x, kind)


@_built_in("concat")
def concat(x: Column, kind: T.DataType, **_: Any) -> Column:
    """One value has nothing to be joined with, so this is its text."""
    return pystr(x, kind)


@_built_in("to_bool")
def to_bool(x: Column, kind: T.DataType, **_: Any) -> Column:
    return x if isinstance(kind, T.BooleanType) else F.lower(pystr(x, kind)).isin("true", "1", "yes", "y")


@_built_in("uppercase")
def uppercase(x: Column, kind: T.DataType, **_: Any) -> Column:
    return F.upper(pystr(x, kind))


@_built_in("lowercase")
def lowercase(x: Column, kind: T.DataType, **_: Any) -> Column:
    return F.lower(pystr(x, kind))


@_built_in("strip")
def stripped(x: Column, kind: T.DataType, **_: Any) -> Column:
    return strip(pystr(x, kind))


@_built_in("to_datetime")
def to_datetime(x: Column, kind: T.DataType, format: str = "%Y-%m-%dT%H:%M:%S", **_: Any) -> Column:
    """ISO text of a parsed date; formats that Spark cannot read run through Arrow-batched Python."""
    text, known = pystr(x, kind), spark_pattern(format)
    if known is None:
        read = F.udf(lambda v: None if not v else datetime.datetime.strptime(v, format).isoformat(), "string", useArrow=True)
        return F.when(~empty(x, kind), read(text))
    pattern, guard = known
    one_space = F.regexp_replace(text, r"\s+", " ") if " " in format else text
    parsed = F.to_timestamp_ntz(one_space, F.lit(" ".join(pattern.split()) if " " in format else pattern))
    iso = F.replace(parsed.cast("string"), F.lit(" "), F.lit("T"))
    wrong = F.raise_error(F.concat(F.lit("time data '"), text, F.lit(f"' does not match format '{format}'"))).cast("string")
    return F.when(~empty(x, kind), F.when(text.rlike(guard), iso).otherwise(wrong))


@_built_in("replace")
def replace(x: Column, kind: T.DataType, old: str = "", new: str = "", **_: Any) -> Column:
    text = pystr(x, kind)
    if old:
        return F.replace(text, F.lit(old), F.lit(new))
    between = F.array_join(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1))), F.array(F.lit(""))), new)
    return F.when(text == "", new).when(text.isNotNull(), between)


@_built_in("default")
def or_default(x: Column, kind: T.DataType, default: Any = None, **_: Any) -> Column:
    """`default` for null and ''; both become text where their types differ."""
    if default is None:
        return F.when(~empty(x, kind), x)
    number = isinstance(default, (int, float)) and not isinstance(default, bool)
    same = isinstance(kind, T.StringType) and isinstance(default, str) or isinstance(kind, T.NumericType) and number or isinstance(kind, T.BooleanType) and isinstance(default, bool)
    if not same:
        return F.when(empty(x, kind), F.lit(str(default))).otherwise(pystr(x, kind))
    return F.when(empty(x, kind), F.lit(default)).otherwise(x)


@_built_in("template")
def template(x: Column, kind: T.DataType, template: str = "{value}", **_: Any) -> Column:
    """str.format with the field `value` and no attribute or index access."""
    parts, plain = [], True
    for text, field, spec, conversion in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if field is None:
            continue
        if field != "value":
            raise ValueError(f"template field '{field}' is not 'value'")
        plain &= not spec and conversion in (None, "s")
        parts.append(pystr(x, kind))
    if plain:
        return F.when(x.isNotNull(), F.concat(F.lit(""), *parts))
    return F.udf(lambda v: None if v is None else template.format(value=v), "string", useArrow=True)(x)


@_built_in("sha256")
def sha256(x: Column, kind: T.DataType, length: int = 16, **_: Any) -> Column:
    return F.when(~empty(x, kind), F.substring(F.sha2(pystr(x, kind), 256), 1, length))


def apply(df: DataFrame, x: Column, t: TransformConfig) -> Column:
    """One transform over an expression of `df`; an unknown name fails before any data is read."""
    fn = transform_registry.get(t.type)
    if fn is None:
        raise ValueError(f"Unknown transform type: '{t.type}'. Known: {sorted(transform_registry.keys())}")
    return fn(x, type_of(df, x), **t.params) if getattr(fn, "typed", False) else fn(x, **t.params)


def apply_chain(df: DataFrame, x: Column, chain: Iterable[TransformConfig]) -> Column:
    return reduce(lambda c, t: apply(df, c, t), chain, x)
