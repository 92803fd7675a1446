"""Text and numbers as Python writes and reads them, as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What str.strip removes.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
_DIGITS = r"\d+(?:_\d+)*"
INT_RX = rf"^{WS}*[+-]?{_DIGITS}{WS}*$"
FLOAT_RX = rf"(?i)^{WS}*[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf(?:inity)?|nan){WS}*$"


def type_of(df: DataFrame, col: Column) -> T.DataType:
    """The type of an expression over `df`; analysis only, no job."""
    return df.select(col.alias("x")).schema[0].dataType


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name; null text where `df` has none."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with `value` computed once and its code written once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shortest(x: Column, text: Column) -> Column:
    """The text of a double with the fewest digits that tell it apart; the JVM may print one or two more."""
    long = F.length(F.regexp_replace(F.substring_index(text, "E", 1), "[-.]|^-?0[.]0*", ""))
    for digits in (17, 16):
        fewer = F.format_string(f"%.{digits - 1}E", x)
        text = F.when((long > digits) & (fewer.try_cast("double") == x), fewer).otherwise(text)
    return text


def _unscaled(text: Column) -> Column:
    """Text like -1.25E-7 as Python writes it."""
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), "^-|[.]?0+$", "")
    parts = F.struct(sign.alias("sign"), mantissa.alias("mantissa"), F.regexp_replace(mantissa, "[.]", "").alias("digits"), F.substring_index(text, "E", -1).cast("int").alias("power"))

    def written(p: Column) -> Column:
        digits, power = p["digits"], p["power"]
        whole = F.rpad(digits, F.greatest(F.length(digits), power + 1), F.lit("0"))
        after = F.coalesce(F.nullif(F.substring(whole, power + 2, F.length(whole)), F.lit("")), F.lit("0"))
        big = F.concat(F.substring(whole, F.lit(1), power + 1), F.lit("."), after)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-power - 1, F.lit(0))), digits)
        size = F.abs(power).cast("string")
        exponent = F.concat(p["mantissa"], F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(size, F.greatest(F.length(size), F.lit(2)), F.lit("0")))
        return F.concat(p["sign"], F.when(power.between(0, 15), big).when(power.between(-4, -1), small).otherwise(exponent))

    return _let(parts, written)


def _double_text(x: Column) -> Column:
    """repr() of a float: positional from 1e-4 up to 1e16, else with a two-digit exponent.

    Short plain texts, the common case, stay in generated code; the rest is interpreted,
    as its code would grow beyond what the JVM compiles.
    """
    short = x.cast("string")
    common = ~short.contains("E") & (F.length(short) <= 17) & ~F.isnan(x) & (F.abs(x) < 1e7)
    rare = _let(x, lambda v: _let(_shortest(v, v.cast("string")), lambda t: F.when(t.contains("E"), _unscaled(t)).otherwise(t)))
    names = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.when(common, short).otherwise(F.coalesce(names, rare))


def pystr(x: Column, kind: T.DataType) -> Column:
    """str(x); null stays null. Nested values are written as JSON."""
    if isinstance(kind, T.StringType):
        return x
    if isinstance(kind, T.BooleanType):
        return F.when(x, "True").when(~x, "False")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(x.isNotNull(), _double_text(x.cast("double")))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = x.cast("string")  # a fraction has six digits or is absent
        return F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(x)
    return x.cast("string")


def empty(x: Column, kind: T.DataType) -> Column:
    """x is None or x == ''."""
    return x.isNull() | (x == "") if isinstance(kind, T.StringType) else x.isNull()


def is_int_text(text: Column) -> Column:
    return text.rlike(INT_RX)


def is_float_text(text: Column) -> Column:
    return text.rlike(FLOAT_RX)


def _number_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), "_", "")


def try_float(x: Column, kind: T.DataType) -> Column:
    """float(x), null where that fails."""
    if isinstance(kind, T.StringType):
        return F.when(is_float_text(x), _number_text(x).try_cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return x.cast("double")
    return F.lit(None).cast("double")


def pyfloat(x: Column, kind: T.DataType) -> Column:
    """float(x); text that is no number is an error."""
    if isinstance(kind, T.StringType):
        return F.when(is_float_text(x), _number_text(x).try_cast("double")).otherwise(F.raise_error(F.concat(F.lit("could not convert string to float: "), x)).cast("double"))
    return x.cast("double")


def pyint(x: Column, kind: T.DataType) -> Column:
    """int(x) as a long; text that is no integer, or out of range, is an error."""
    if isinstance(kind, T.StringType):
        return F.when(is_int_text(x), _number_text(x).cast("long")).otherwise(F.raise_error(F.concat(F.lit("invalid literal for int(): "), x)).cast("long"))
    return x.cast("long")
