"""Predicate conformance: every case's text against the codes it must select."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrazzo.functions.geometry import point
from terrazzo.model import Every, FeatureQuery, PlanError
from terrazzo.plans import execute
from terrazzo.plans.dataset import Dataset
from terrazzo.plans.parse import from_wire, parse_filter, parse_where, render, validate_where

# The conformance rows (GUID, SEEN, ROWS), and the cases with the codes that they must select.
GUID = "11111111-2222-3333-4444-555555555555"
SEEN = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=1700000000000)
ROWS = [
    ("alpha", 3664000, 1.5, True, GUID, SEEN, 13.4, 52.5),
    ("beta", 2000000, 2.5, False, GUID, SEEN - timedelta(days=400), 2.35, 48.85),
    ("gamma", 900000, 0.5, True, None, None, -0.12, 51.5),
    ("delta", None, None, None, GUID, None, 12.5, 41.9),
    ("epsilon", 9007199254740993, 3.5, True, GUID, SEEN, 13.0, 52.0),
    ("_bravo", 1200000, None, False, None, None, 5.0, 5.0),
    ("Delta", None, None, None, None, None, 5.5, 5.5),
]
SCHEMA = T.StructType(
    [
        T.StructField("code", T.StringType(), False),
        T.StructField("population", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("active", T.BooleanType()),
        T.StructField("reference", T.StringType(), True, {"kind": "guid"}),
        T.StructField("seen", T.TimestampType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)
CASES = [
    ("code = 'alpha'", "alpha"),
    ("code != 'alpha'", "Delta _bravo beta delta epsilon gamma"),
    ("code <> 'alpha'", "Delta _bravo beta delta epsilon gamma"),
    ("code < 'delta'", "Delta _bravo alpha beta"),
    ("code <= 'delta'", "Delta _bravo alpha beta delta"),
    ("code >= '_bravo' AND code <= 'delta'", "_bravo alpha beta delta"),
    ("population > 2000000", "alpha epsilon"),
    ("score >= 1.5 AND score < 3.5", "alpha beta"),
    ("population = 9007199254740993", "epsilon"),
    ("score = 2", ""),
    ("score > -1", "alpha beta epsilon gamma"),
    ("active = TRUE", "alpha gamma epsilon"),
    ("active < TRUE", ""),
    (f"reference = '{GUID}'", "alpha beta delta epsilon"),
    (f"reference = '{GUID.upper()}'", "alpha beta delta epsilon"),
    ("reference = 'no guid'", ""),
    ("population > 0", "alpha _bravo beta epsilon gamma"),
    ("population != 900000", "alpha _bravo beta epsilon"),
    ("population IS NULL", "Delta delta"),
    ("population IS NOT NULL", "alpha _bravo beta epsilon gamma"),
    ("seen >= TIMESTAMP '2023-01-01 00:00:00'", "alpha epsilon"),
    ("seen > TIMESTAMP '2022-01-01 00:00:00' AND seen < TIMESTAMP '2023-01-01 00:00:00'", "beta"),
    ("seen = 1700000000000", "alpha epsilon"),
    ("seen > 1699999999999.5", "alpha epsilon"),
    ("seen = 1699999999999.5", ""),
    ("seen < 99999999999999999", "alpha beta epsilon"),
    ("code LIKE 'a%'", "alpha"),
    ("code LIKE '_elta'", "Delta delta"),
    ("code LIKE 'lph'", ""),
    ("code LIKE 'ALPH%'", ""),
    ("code ILIKE 'ALPH%'", "alpha"),
    ("code ILIKE 'delta'", "Delta delta"),
    ("code ILIKE '%LTA'", "delta Delta"),
    ("code ILIKE '_BRAVO'", "_bravo"),
    ("code ILIKE 'lph'", ""),
    ("code ILIKE 'Épsilon'", ""),
    ("population ILIKE '3%'", ""),
    ("code IN ('alpha', 'gamma', NULL, 3)", "alpha gamma"),
    ("code NOT IN ('alpha', 'gamma')", "Delta _bravo beta delta epsilon"),
    ("population NOT IN ('x', NULL)", "alpha _bravo beta epsilon gamma"),
    ("population IN (2000000.0, 99999999999999999999)", "beta"),
    ("population = 'x'", ""),
    ("code = 5", ""),
    ("code = NULL", ""),
    ("population > 99999999999999999999", ""),
    ("population < 99999999999999999999", "alpha _bravo beta epsilon gamma"),
    ("code = 'alpha' OR (population >= 2000000 AND active = FALSE)", "alpha beta"),
]


@pytest.fixture(scope="module")
def ds(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("geometry", point(F.col("x"), F.col("y")))
    return Dataset(df.cache(), ("code",), ("code",), "places")


@pytest.mark.parametrize("text,codes", CASES)
def test_case(ds, text, codes):
    got = {r[0] for r in execute.features(ds, FeatureQuery(where=parse_filter(text), projection=("code",))).select("code").collect()}
    assert got == set(codes.split())


@pytest.mark.parametrize("text,codes", CASES[:12])
def test_rendered_text_means_the_same(ds, text, codes):
    again = parse_where(render(parse_where(text)))
    assert {r[0] for r in execute.select(ds, FeatureQuery(where=again)).df.select("code").collect()} == set(codes.split())


def test_where_grammar(ds):
    now = datetime(2023, 11, 15, tzinfo=timezone.utc)
    for text, codes in [
        ("1=1", "alpha beta gamma delta epsilon _bravo Delta"),
        ("1=0", ""),
        ('"code" = \'alpha\' AND 1=1', "alpha"),
        ("score BETWEEN 1 AND 3", "alpha beta"),
        ("seen >= CURRENT_TIMESTAMP - INTERVAL '2' DAY", "alpha epsilon"),
        ("seen < CURRENT_TIMESTAMP - INTERVAL '1' YEAR", "beta"),
    ]:
        assert {r[0] for r in execute.select(ds, FeatureQuery(where=parse_where(text, now))).df.select("code").collect()} == set(codes.split()), text
    assert parse_filter(" ") is None


@pytest.mark.parametrize("text", ["code", "code =", "= 3", "code = 'x", "(code = 'a'", "code LIKE", "code NOT 'x'", "code = 'a' extra", "code IN ()", "1=1", "a ; b"])
def test_malformed_text_is_refused(text):
    with pytest.raises(PlanError):
        parse_filter(text)


def test_unknown_field_and_validation(ds):
    with pytest.raises(PlanError):
        execute.features(ds, FeatureQuery(where=parse_filter("nope = 1")))
    assert validate_where("code = 'a'", {"code"}) == (True, None, "")
    assert validate_where("code = ", {"code"})[1] == 3001
    assert validate_where("x = 1", {"code"})[1] == 3002
    assert validate_where(" ", {"code"})[1] == 3008


def test_wire(ds):
    node = {"op": "and", "terms": [{"op": "isIn", "field": "code", "values": [{"kind": "string", "text": "alpha"}], "negated": True}, {"op": "constant", "truth": True}]}
    assert isinstance(from_wire(node), Every)
    assert execute.count(ds, FeatureQuery(where=from_wire(node))) == 6
    for bad in ({"op": "not"}, {"op": "isNull", "field": "a", "terms": [1]}, {"op": "compare", "field": "a"}, {"op": "constant", "truth": True, "field": "a"}):
        with pytest.raises(PlanError):
            from_wire(bad)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(path)
    ds = Dataset(spark.read.schema(SCHEMA).parquet(path), ("code",))
    plan = execute.features(ds, FeatureQuery(where=parse_filter("score >= 1.5 AND seen < 1700000000000 AND population = 3"), projection=("code",)))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(score,1.5)" in plan and "LessThan(seen," in plan and "EqualTo(population,3)" in plan
