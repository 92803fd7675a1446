"""Column transforms, rules and ids against small Python functions over awkward values."""

import datetime
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.config import IdGenerationConfig, TransformConfig, ValidationConfig, ValidationRuleConfig
from weftgraph.functions.ids import generate_id
from weftgraph.functions.transforms import apply_chain
from weftgraph.operators.validation import apply_rules, validate
from weftgraph.registry import Registry, transform_registry

TEXTS = ["3.7", " 42 ", "1_000", "1__0", "", "  ", "+5", "1.5d", "1.5f", "0x1p3", "+inf", "nan", "1e3", "1_0.5", "x", "True", "yes", "Y", "\t a ", "\u001cq ", "ß", "😀a", None, "2024-1-5", "-7", ".5", "5.", "Infinity"]
DOUBLES = [0.0, -0.0, 1.0, 3.7, -3.7, 1e16, 1.5e16, 1e15, 123456789.125, 1e-5, 0.0001, 0.00012, -2.5e-7, 1e100, 12345678.9, math.inf, -math.inf, math.nan, None, 1e7]


def run(spark, values, kind, *chain):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.LongType()), T.StructField("v", kind)]))
    out = df.select("i", apply_chain(df, F.col("v"), [TransformConfig(**t) for t in chain]).alias("o"))
    return [r.o for r in sorted(out.collect(), key=lambda r: r.i)]


def test_text_of_doubles_and_booleans(spark):
    assert run(spark, DOUBLES, T.DoubleType(), {"type": "to_string"}) == [None if d is None else str(d) for d in DOUBLES]
    assert run(spark, [True, False, None], T.BooleanType(), {"type": "to_string"}) == ["True", "False", None]
    stamps = [datetime.datetime(2024, 1, 5, 3, 4, 5), datetime.datetime(2024, 1, 5, 3, 4, 5, 1200)]
    assert run(spark, stamps, T.TimestampNTZType(), {"type": "to_string"}) == [str(s) for s in stamps]


@pytest.mark.parametrize(("name", "spec"), [("to_int", int), ("to_float", float)])
def test_numbers_from_text(spark, name, spec):
    good, bad = [], []
    for t in TEXTS:
        try:
            good.append((t, spec(t) if t not in ("", None) else None))
        except ValueError:
            bad.append(t)
    got = run(spark, [t for t, _ in good], T.StringType(), {"type": name})
    assert [repr(g) for g in got] == [repr(w) for _, w in good]
    for t in bad[:4]:
        with pytest.raises(Exception, match="convert|invalid literal"):
            run(spark, [t], T.StringType(), {"type": name})


def test_text_transforms(spark):
    both = lambda f: [None if t is None else f(t) for t in TEXTS]
    s = T.StringType()
    assert run(spark, TEXTS, s, {"type": "uppercase"}) == both(str.upper)
    assert run(spark, TEXTS, s, {"type": "lowercase"}) == both(str.lower)
    assert run(spark, TEXTS, s, {"type": "strip"}) == both(str.strip)
    assert run(spark, TEXTS, s, {"type": "concat", "params": {"separator": "-"}}) == TEXTS
    assert run(spark, TEXTS, s, {"type": "to_bool"}) == both(lambda t: t.lower() in {"true", "1", "yes", "y"})
    assert run(spark, TEXTS, s, {"type": "replace", "params": {"old": "a", "new": "$1"}}) == both(lambda t: t.replace("a", "$1"))
    assert run(spark, TEXTS, s, {"type": "replace", "params": {"new": "-"}}) == both(lambda t: t.replace("", "-"))
    assert run(spark, TEXTS, s, {"type": "default", "params": {"default": "n"}}) == [t or "n" for t in TEXTS]
    assert run(spark, TEXTS, s, {"type": "template", "params": {"template": "<{value}>{{}}"}}) == both(lambda t: f"<{t}>{{}}")
    assert run(spark, TEXTS, s, {"type": "template", "params": {"template": "{value:>9}"}}) == both(lambda t: f"{t:>9}")
    assert run(spark, TEXTS, s, {"type": "sha256", "params": {"length": 10}}) == [hashlib.sha256(t.encode()).hexdigest()[:10] if t else None for t in TEXTS]
    assert run(spark, [1, None], T.LongType(), {"type": "default", "params": {"default": "N/A"}}) == ["1", "N/A"]


@pytest.mark.parametrize("fmt", ["%Y-%m-%d", "%d/%m/%Y %H:%M", "%Y%m%d", "%b %d, %Y", "%d %B %Y %I:%M %p", "%y-%m-%d", "%Y-%m-%dT%H:%M:%S.%f"])
def test_dates(spark, fmt):
    for when in (datetime.datetime(2024, 1, 5, 13, 45), datetime.datetime(1999, 12, 31, 0, 0)):
        text = when.strftime(fmt)
        want = datetime.datetime.strptime(text, fmt).isoformat()
        assert run(spark, [text, None, ""], T.StringType(), {"type": "to_datetime", "params": {"format": fmt}}) == [want, None, None]


@pytest.mark.parametrize("text", ["2024-001-05", "2024-13-01", "2024-02-30", "2024-1-5 x", "24-1-5"])
def test_wrong_dates_fail(spark, text):
    with pytest.raises(Exception, match="does not match|could not be parsed|CANNOT_PARSE"):
        run(spark, [text], T.StringType(), {"type": "to_datetime", "params": {"format": "%Y-%m-%d"}})


def test_chains_and_plugins(spark):
    assert run(spark, ["  alice  "], T.StringType(), {"type": "strip"}, {"type": "uppercase"}) == ["ALICE"]
    with pytest.raises(ValueError, match="Unknown transform type"):
        run(spark, ["a"], T.StringType(), {"type": "nope"})
    with pytest.raises(ValueError, match="not 'value'"):
        run(spark, ["a"], T.StringType(), {"type": "template", "params": {"template": "{value.__class__}"}})
    transform_registry.register("twice_for_test")(lambda col, sep="": F.concat(col, F.lit(sep), col))
    transform_registry.register_python("reverse_for_test", "string")(lambda v: v and v[::-1])
    assert run(spark, ["ab"], T.StringType(), {"type": "twice_for_test", "params": {"sep": "+"}}, {"type": "reverse_for_test"}) == ["ba+ba"]


def test_registry():
    r = Registry("t")
    r.register("a")(len)
    assert "a" in r and r.get("a") is len and r.get("b") is None and r.keys() == ["a"]


def py_check(value, rule, p):
    """What a rule does to one value; True where it fails."""
    if rule == "required":
        return value is None or value == ""
    if value is None:
        return False
    if rule == "type":
        kinds = {"int": int, "float": float, "str": str, "bool": bool}
        if p["expected"] not in kinds:
            return False
        try:
            kinds[p["expected"]](value)
        except (ValueError, TypeError, OverflowError):
            return True
        return False
    if rule == "regex":
        return not re.match(p["pattern"], str(value))
    if rule == "one_of":
        return value not in p["values"]
    if rule not in ("min", "max"):
        return False
    try:
        return float(value) < float(p["value"]) if rule == "min" else float(value) > float(p["value"])
    except (ValueError, TypeError):
        return False


RULES = [("required", {}), ("type", {"expected": "int"}), ("type", {"expected": "float"}), ("type", {"expected": "bool"}), ("type", {"expected": "odd"}), ("regex", {"pattern": "[0-9]"}), ("regex", {"pattern": "a|^\\s"}), ("regex", {"pattern": ""}), ("min", {"value": 5}), ("max", {"value": "5"}), ("max", {"value": "x"}), ("one_of", {"values": ["x", "+5", 42]}), ("one_of", {"values": [1, 3.7]}), ("unknown", {})]


@pytest.mark.parametrize(("rule", "params"), RULES)
def test_rules(spark, rule, params):
    for values, kind in ((TEXTS, T.StringType()), (DOUBLES, T.DoubleType()), ([1, 5, 9, None], T.LongType()), ([True, False, None], T.BooleanType())):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.LongType()), T.StructField("v", kind)]))
        v = apply_rules(df, [ValidationRuleConfig(field="v", rule=rule, params=params)])
        got = {r.i for r in v.checked.collect() if r["_errors"]}
        assert got == {i for i, x in enumerate(values) if py_check(x, rule, params)}, kind
        assert {r.i for r in v.valid.collect()} == set(range(len(values))) - got


def test_strategies(spark):
    rows = [(1, "Alice", "alice@example.com", "30"), (2, "", "bad-email", "25"), (None, "Charlie", "c@example.com", "200")]
    df = spark.createDataFrame(rows, "id int, name string, email string, age string").coalesce(1)
    rules = [ValidationRuleConfig(field="name", rule="required"), ValidationRuleConfig(field="email", rule="regex", params={"pattern": "[^@]+@"}, message="bad mail"), ValidationRuleConfig(field="age", rule="max", params={"value": 150})]
    v = apply_rules(df, rules)
    assert [r.id for r in v.valid.collect()] == [1]
    rejects = sorted(v.rejects().collect(), key=lambda r: r.record_index)
    assert [r.errors for r in rejects] == [["Field 'name' is required", "bad mail"], ["Field 'age' above maximum 150"]]
    assert rejects[0].record.email == "bad-email"
    with pytest.raises(ValueError, match="Validation failed at record .*required; bad mail"):
        validate(df, ValidationConfig(rules=rules, on_error="fail"))
    assert validate(df, None) is None and validate(df, ValidationConfig()) is None


def test_ids(spark):
    df = spark.createDataFrame([("r", "p", "C", 1), ("r", None, "", 2)], "repo string, pkg string, class string, n int")
    ids = lambda **c: [r[0] for r in df.orderBy("n").select(generate_id(df, IdGenerationConfig(**c))).collect()]
    sha = lambda t, n=16: hashlib.sha256(t.encode()).hexdigest()[:n]
    assert ids(fields=["repo", "pkg", "class"]) == [sha("r:p:C"), sha("r::")]
    assert ids(fields=["repo", "absent"], prefix="x-", hash_length=8) == ["x-" + sha("r:", 8)] * 2
    assert ids(strategy="composite", fields=["repo", "n"], separator="/") == ["r/1", "r/2"]
    assert ids(strategy="passthrough", fields=["n"], prefix="n") == ["n1", "n2"]
    with pytest.raises(Exception, match="is null"):
        ids(strategy="passthrough", fields=["pkg"])
    with pytest.raises(ValueError):
        ids(strategy="passthrough")
    with pytest.raises(ValueError, match="share one id"):
        ids(fields=["nope"])


PATTERNS = [
    r"\d+", r"\w+$", r"\W", r"[\w.-]+@[\w-]+", r"\s*\S", r"a.b", r"(?i)é", r"(?i:STRASSE) x", r"x\b", r"\bx", r"a\Bb", r"[^\d\s]+$", r"[[a]", r"[a&&b]+$", r"[]x]", r"[^]x]", r"a{,2}b", r"a{2}$", r"a{x", r"}x",
    r"\x41\u00e9", r"a|b$", r"^a$", r"a\Z", r"(a)\1", r"(?s)a.b", r"(?P<n>a)(?P=n)", r"(?x) a  b", r"(?m)^a$", r"a\.b\-c", r"[\b]", r"(?<=a)b", r"(?=a)\w", r"\v", r"[a~|#]", r"\141", r"a++b", r"(?>a|b)c", r"", r"(?a)\w",
    r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4})+", r"^[^@\s]+@[^@\s]+\.[^@\s]+$", r"[\W\d]+$", r"[\S]", r"(?-i:a)", r"\t|\n", r"€+", r"[à-ü]+$",
]
SUBJECTS = ["", "a", "b", "ab", "a\nb", "a\rb", "a\u2028b", "a\u0085b", "É", "é", "x", "x y", "xé", "٣", "½", "²", "_", "a_b-c.d@e-f", "e\u0301", "\u00a0x", "\x1cx", "\u2003", "aab", "aaa", "aa", "a{x", "}x", "A\u00e9", "a\n", "aa\n", "a.b-c", "\x08", "]", "[", "[a", "&", "a&&b", "\x0b", "~|#", "straße x", "STRASSE x", "strasse x", "\u212a", "DE89 3704 0044", "jo@x.org", "jo@x", "ab\tc", "€€", "äöü", "中文", "😀", "bc", "ac", "aac", "\t", None]


def test_patterns_match_as_in_python(spark):
    import re

    from weftgraph.config import ValidationRuleConfig
    from weftgraph.functions.patterns import to_java
    from weftgraph.operators.validation import apply_rules

    df = spark.createDataFrame([(i, t) for i, t in enumerate(SUBJECTS)], "i int, t string").coalesce(1)
    in_python = [p for p in PATTERNS if to_java(p) is None]
    assert in_python == [r"(?P<n>a)(?P=n)", r"(?x) a  b", r"(?m)^a$", r"\141", r"(?a)\w"]
    for p in PATTERNS:
        valid = {r.i for r in apply_rules(df, [ValidationRuleConfig(field="t", rule="regex", params={"pattern": p})]).valid.collect()}
        assert valid == {i for i, t in enumerate(SUBJECTS) if t is None or re.match(p, t)}, (p, to_java(p), [(SUBJECTS[i], bool(re.match(p, SUBJECTS[i] or ""))) for i in valid ^ {i for i, t in enumerate(SUBJECTS) if t is None or re.match(p, t)}])
    plan = apply_rules(df, [ValidationRuleConfig(field="t", rule="regex", params={"pattern": r"(?i)\w+\s\d{3}\b"})]).valid._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_one_of_compares_exactly(spark):
    from decimal import Decimal

    from weftgraph.config import ValidationRuleConfig
    from weftgraph.operators.validation import apply_rules

    big = 9007199254740993
    df = spark.createDataFrame([(big, True, 0.1, Decimal("0.10")), (big - 1, False, float(big - 1), Decimal("2.00")), (None, None, None, None)], "l long, b boolean, d double, e decimal(10,2)")
    valid = lambda f, *values: [r[f] for r in apply_rules(df, [ValidationRuleConfig(field=f, rule="one_of", params={"values": list(values)})]).valid.where(f"{f} is not null").collect()]
    assert valid("l", big - 1) == [big - 1] and valid("l", big) == [big] and valid("l", float(big - 1), "x") == [big - 1] and valid("l", 2**70, 0.5) == [] and valid("l", "1") == []
    assert valid("b", 1) == [True] and valid("b", False) == [False]
    assert valid("d", big - 1, 0.1) == [0.1, float(big - 1)] and valid("d", big) == [] and valid("d", float("nan")) == []
    assert valid("e", 2) == [Decimal("2.00")] and valid("e", 0.1) == []  # 0.1 is no decimal 0.10, as in Python
    assert valid("l", True) == []


def test_number_text_has_small_code(spark):
    """str() of a double compiles, whatever the number, also several times in one projection."""
    from weftgraph.functions.pyvalues import pystr

    numbers = [0.0, -0.0, 1.5, 1e16, 1e15, 123456789.125, 1e-5, 1e-4, 2.5e-320, 1.7976931348623157e308, 2.0**70, 0.1 + 0.2, 1 / 3, 1e22, float("inf"), float("-inf"), float("nan"), 9007199254740993.0, -1.25e-7, 100.0]
    df = spark.createDataFrame([(x,) for x in numbers], "x double").coalesce(1)
    text = pystr(F.col("x"), T.DoubleType())
    got = df.select("x", *[text.alias(f"t{i}") for i in range(5)]).collect()
    assert [r.t4 for r in got] == [repr(x) for x in numbers]
    spark.conf.set("spark.sql.codegen.fallback", "false")  # code that does not compile is an error
    try:
        assert df.select(*[F.concat(text, F.lit(str(i))).alias(f"t{i}") for i in range(12)]).where("t3 <> t4").count() == len(numbers)
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
