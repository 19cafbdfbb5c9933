"""Filters: builder, parser, both field layouts, against direct evaluation of the stated rules."""

import math

import pytest
from pyspark.sql import functions as F
from quernstone.errors import SchemaError
from quernstone.plans import (
    Compare, Eq, Everything, FaithfulMeta, Fields, In, Neq, Not, NotPresent, Present, Range, coerce_where, conjoin, filter_column, parse_where, value_column,
)
from quernstone.plans.predicate import META_TYPE
from quernstone.schema import tagged

ROWS = [
    (1, dict(year=2020, lang="en", score=5.5, ok=True)),
    (2, dict(year=2**53 + 1, lang="de", score=float("nan"), ok=False)),
    (3, dict(score=30.5)),
    (4, dict(year=5, score=5.0, lang="it's")),
    (5, {}),
    (6, dict(year=-3, score=-math.inf, ok=False, raw=b"\x00\x01")),
]
FIELDS = {"year": "bigint", "lang": "string", "score": "double", "ok": "boolean", "raw": "binary"}


@pytest.fixture(scope="module")
def typed(spark):
    rows = [(i, *[bytearray(m[f]) if f == "raw" and f in m else m.get(f) for f in FIELDS]) for i, m in ROWS]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} {t}" for f, t in FIELDS.items())).cache()


@pytest.fixture(scope="module")
def faithful(spark):
    return spark.createDataFrame([(i, tagged(m)) for i, m in ROWS], f"id long, meta {META_TYPE}").cache()


CASES = [
    ("year = 2020", [1]),
    ("year = 2020.0", []),
    ("year != 2020", [2, 3, 4, 5, 6]),
    ("year <> 2020", [2, 3, 4, 5, 6]),
    ("NOT year = 2020", [2, 3, 4, 5, 6]),
    ("NOT NOT year = 2020", [1]),
    ("score > 5", [1, 3]),
    ("score >= 5", [1, 3, 4]),
    ("score < 5.5", [4, 6]),
    ("score <= 5.5", [1, 4, 6]),
    ("NOT score > 5", [2, 4, 5, 6]),
    ("year > 5", [1, 2]),
    ("year > 4.5", [1, 2, 4]),
    ("year < -2.5", [6]),
    (f"year > {2**53}", [2]),
    (f"year >= {2**53 + 1}", [2]),
    ("year < +6", [4, 6]),
    ("score < .5", [6]),
    ("lang IN ('en', \"de\", 3)", [1, 2]),
    ("lang IS NULL", [3, 5, 6]),
    ("lang IS NOT NULL", [1, 2, 4]),
    ("is_null = 1 OR ok = true", [1]),
    ("ok = false", [2, 6]),
    ("lang = 'it\\'s'", [4]),
    ('lang = "it\'s"', [4]),
    ("lang = 'en' OR year = 5 AND score = 6.0", [1]),
    ("(lang = 'en' OR year = 5) AND score = 5.0", [4]),
    ("not_field IS NULL and NOT(ok = true)", [2, 3, 4, 5, 6]),
    ("", [1, 2, 3, 4, 5, 6]),
    (" \t\n", [1, 2, 3, 4, 5, 6]),
    ("year > 9223372036854775808", []),
    ("missing != 'x'", [1, 2, 3, 4, 5, 6]),
    ("lang > 3", []),
]


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize("text,want", CASES)
def test_where_string(typed, faithful, text, want):
    node = parse_where(text)
    assert ids(typed.where(filter_column(node, Fields.of(typed, "id")))) == want
    assert ids(typed.where(value_column(node, Fields.of(typed, "id")))) == want
    assert ids(faithful.where(filter_column(node, FaithfulMeta()))) == want


def test_value_column_is_never_null(typed, faithful):
    for text, _ in CASES:
        node = parse_where(text)
        assert typed.where(value_column(node, Fields.of(typed, "id")).isNull()).isEmpty()
    assert faithful.where(value_column(parse_where("NOT score > 5 AND lang != 'x'"), FaithfulMeta()).isNull()).isEmpty()


BUILT = [
    (Range("score", 5, 40), [4]),  # whole bounds: a fraction in a float field never matches
    (Range("score", 5.0, 40.5), [1, 3, 4]),
    (Range("year", 5, 2020), [1, 4]),
    (Range("year", 4.5, 2020.5), [1, 4]),
    (Range("year", 10, 5), []),
    (Range("lang", 1, 5), []),
    (Eq("score", float("nan")), []),
    (Neq("score", float("nan")), [1, 2, 3, 4, 5, 6]),
    (Eq("raw", b"\x00\x01"), [6]),
    (Eq("ok", 1), []),
    (In("year", (5, True, "5")), [4]),
    (In("year", ()), []),
    (Present("ok"), [1, 2, 6]),
    (NotPresent("ok") & ~Eq("year", 5), [3, 5]),
    (Compare("year", ">", 5) | Eq("lang", "de"), [1, 2]),
    (conjoin(Everything(), Eq("year", 5), Everything()), [4]),
    (Not(Everything()), []),
    (Range("score", -math.inf, math.inf), [1, 3, 4, 6]),
]


@pytest.mark.parametrize("node,want", BUILT, ids=lambda x: repr(x)[:60])
def test_builder(typed, faithful, node, want):
    assert ids(typed.where(filter_column(node, Fields.of(typed, "id")))) == want
    assert ids(faithful.where(filter_column(node, FaithfulMeta()))) == want


def test_duplicate_and_mixed_keys(spark):
    df = spark.createDataFrame([(1, tagged([("tag", "a"), ("tag", "b")])), (2, tagged([("tag", 7)])), (3, None)], f"id long, meta {META_TYPE}")
    assert ids(df.where(filter_column(Eq("tag", "b"), FaithfulMeta()))) == [1]
    assert ids(df.where(filter_column(Eq("tag", 7), FaithfulMeta()))) == [2]
    assert ids(df.where(filter_column(Neq("tag", "a"), FaithfulMeta()))) == [2, 3]


@pytest.mark.parametrize("bad", [
    "year", "year =", "= 5", "year == 5", "year = null", "year IN ()", "year IN (1", "year IN 1", "year > 'a'", "year > ", "year = +5", "year = .5", "lang = 'a",
    "lang = 'it''s'", "lang = 'a\\n'", "(year = 5", "year = 5)", "year = 5 extra", "year = 5 AND", "NOT", "year BETWEEN 1 AND 2", "lang LIKE 'x'", "year IS 5", "year IS NOT 5",
    "a.b = 1", "year = 1.2.3", "year = 1e5", "year = 9223372036854775808", "'year' = 5", "year ! 5", "year = -",
])
def test_parse_errors(bad):
    with pytest.raises(SchemaError, match="where-string"):
        parse_where(bad)


def test_coercion_forms():
    assert coerce_where(None) == Everything() == coerce_where({}) == coerce_where([])
    assert coerce_where({"a": 1, "b": "x"}) == conjoin(Eq("a", 1), Eq("b", "x"))
    got = coerce_where([{"eq": {"field": "a", "value": True}}, {"in": {"field": "b", "values": [1, 2]}}, {"range": {"field": "c", "lo": 1, "hi": 2.5}}, {"present": "d"}])
    assert got == conjoin(Eq("a", True), In("b", (1, 2)), Range("c", 1, 2.5), Present("d"))
    for bad in (5, [{"like": 1}], [{"eq": {"field": "a"}}], [5], {"a": [1]}, [{"range": {"field": "c", "lo": "x", "hi": 2}}]):
        with pytest.raises(SchemaError):
            coerce_where(bad)


def test_nan_bound_is_an_error(typed):
    with pytest.raises(SchemaError):
        filter_column(Range("score", float("nan"), 1.0), Fields.of(typed))


def test_filters_reach_the_scan(spark, typed, tmp_path):
    typed.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for text, want in (("lang = 'en'", "lang"), ("lang != 'en'", "lang"), ("year > 5", "year"), ("year IN (1, 2)", "year")):
        plan = df.where(filter_column(parse_where(text), Fields.of(df)))._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        assert want in pushed, (text, pushed)


def test_clashing_column_names(spark):
    df = spark.createDataFrame([(1, 2, "x")], "id long, `a.b` long, k string")
    assert ids(df.where(filter_column(Eq("a.b", 2), Fields.of(df)))) == [1]
    assert df.where(F.lit(True)).count() == 1
