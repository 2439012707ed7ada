"""Expressions, time, relationships, rasters and edits."""


import pytest
from pyspark.sql import functions as F

from terrazzo.functions.expressions import compile_expression, legacy_filter
from terrazzo.model import PlanError
from terrazzo.operators import edits, raster, related, temporal
from terrazzo.plans.dataset import Dataset
from terrazzo.plans.parse import parse_filter

DAY = 86_400_000


@pytest.mark.parametrize(
    "e,expected",
    [
        (["+", 1, 2, 3], 6.0),
        (["+", ["get", "s"], 1], "x1.0"),
        (["-", 5], -5.0),
        (["/", 1, 0], float("inf")),
        (["%", 7, 4], 3.0),
        (["*", ["get", "missing"], 2], None),
        (["==", ["get", "missing"], 1], False),
        (["!=", 1, 2], True),
        (["!=", ["get", "s"], "x"], False),
        (["<", ["get", "s"], "y"], False),
        (["all", ["has", "n"], [">", ["get", "n"], 2]], True),
        (["any", ["has", "nope"], False], False),
        (["in", "b", "abc"], True),
        (["in", ["get", "n"], ["literal", [1, 3]]], True),
        (["concat", "a", ["get", "missing"], "b"], "ab"),
        (["match", ["get", "s"], ["q", "x"], "hit", "miss"], "hit"),
        (["coalesce", ["get", "missing"], ["get", "n"]], 3.0),
        (["step", ["get", "n"], "a", 1, "b", 3, "c"], "c"),
        (["interpolate", ["linear"], ["get", "n"], 1, 0, 5, 8], 4.0),
        (["interpolate", ["exponential", 2], ["get", "n"], 1, 0, 5, 8], 2.0),
        (["interpolate", ["linear"], 99, 1, 0, 5, 8], 8.0),
        (["let", "v", ["+", ["get", "n"], 1], ["*", ["var", "v"], 2]], 8.0),
        (["case", ["==", ["zoom"], 4.0], "z", "other"], "z"),
        (["at-interpolate", 3, ["interpolate", ["linear"], ["get", "n"], 1, 0, 5, 8]], 4.0),
    ],
)
def test_expressions(spark, e, expected):
    df = spark.createDataFrame([("x", 3)], "s string, n int")
    got = df.select(compile_expression(df, e, {"zoom": 4})).first()[0]
    assert got == pytest.approx(expected) if isinstance(expected, float) and expected != float("inf") else got == expected


def test_bezier_and_errors(spark):
    df = spark.createDataFrame([(3,)], "n int")
    mid = df.select(compile_expression(df, ["interpolate", ["cubic-bezier", 0.25, 0.25, 0.75, 0.75], ["get", "n"], 1, 0, 5, 8])).first()[0]
    assert mid == pytest.approx(4.0, abs=1e-6)
    for bad in ([], ["nope", 1], ["var", "v"]):
        with pytest.raises(PlanError):
            compile_expression(df, bad)
    keep = compile_expression(df, legacy_filter(["any", ["!has", "q"], ["in", "n", 4, 5]]))
    assert df.where(keep).count() == 1


def test_colours(spark):
    df = spark.createDataFrame([("x", 3, "#0f08")], "s string, n int, c string")
    get = lambda e: df.select(compile_expression(df, e)).first()[0]
    assert tuple(get(["to-color", 0.5])) == (128, 128, 128, 255) and tuple(get(["to-color", ["get", "c"]])) == (0, 255, 0, 136)
    assert tuple(get(["to-color", "rgba(1, 2, 3, 0.5)"])) == (1, 2, 3, 128) and tuple(get(["to-color", "Orange"])) == (255, 165, 0, 255)
    assert tuple(get(["interpolate", ["linear"], ["get", "n"], 1, "black", 5, "#ffffff"])) == (128, 128, 128, 255)
    assert get(["to-color", ["get", "missing"]]) is None
    with pytest.raises(Exception, match="not a colour"):
        get(["to-color", ["get", "s"]])


@pytest.fixture(scope="module")
def spans(spark):
    rows = [(1, 0, 10), (2, 5, None), (3, None, 3), (4, 9, 2), (5, None, None), (6, 20, 30)]
    ts = lambda c: F.timestamp_millis(F.col(c) * DAY)
    df = spark.createDataFrame(rows, "id long, a long, b long").select("id", ts("a").alias("a"), ts("b").alias("b"))
    return Dataset(df, ("id",), ("id",), "spans", "a", "b")


@pytest.mark.parametrize("relation,expected", [("overlaps", {1, 2, 3, 5}), ("contains", {5}), ("within", set())])
def test_time_window(spans, relation, expected):
    start, end = (2 * DAY, 12 * DAY)
    assert {r[0] for r in temporal.extent(spans, start, end, relation).select("id").collect()} == expected


def test_time_within_and_any(spans):
    assert {r[0] for r in temporal.extent(spans, 0, 10 * DAY, "within").select("id").collect()} == {1}
    assert {r[0] for r in temporal.any_date(spans, 8 * DAY, 9 * DAY).select("id").collect()} == {4, 5}
    with pytest.raises(PlanError):
        temporal.extent(spans, 0, 1, "meets")


def test_related(spark):
    origin = Dataset(spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id long, k string"), ("id",))
    target = Dataset(spark.createDataFrame([(10, "a", 5), (11, "a", 7), (12, None, 9)], "rid long, k string, v int"), ("rid",))
    r = related.Relationship("k", "k")
    rows = related.related(origin, target, r, parse_filter("v > 5"), projection=("rid",)).collect()
    assert [tuple(x) for x in rows] == [("1", 11)]
    through = spark.createDataFrame([("a", 5), ("a", 5), ("a", 7)], "o string, t int")
    many = related.related(origin, target, related.Relationship("k", "v", "o", "t"), through=through, projection=("rid",))
    assert sorted(tuple(x) for x in many.collect()) == [("1", 10), ("1", 11)]
    assert related.grouped(many).first()["n_related"] == 2


def test_raster(spark):
    cells = spark.createDataFrame([("r", 1, 0, 0, 3.0), ("r", 1, 0, 1, 3.0), ("r", 2, 0, 0, 0.0), ("r", 2, 0, 1, 255.0), ("r", 2, 0, 2, None)], "raster_id string, band int, row int, col int, value double")
    assert {(x["band"], x["bin"], x["n"]) for x in raster.histogram(cells).collect()} == {(1, 128, 2), (2, 0, 1), (2, 255, 1)}
    assert {(x["band"], x["bin"]) for x in raster.histogram(cells, eight_bit=True).collect()} == {(1, 3), (2, 0), (2, 255)}
    assert {(x["band"], x["value"]) for x in raster.identify(cells, "r", 0, 1).collect()} == {(1, 3.0), (2, 255.0)}
    assert {x["band"]: x["mean"] for x in raster.band_statistics(cells).collect()} == {1: 3.0, 2: 127.5}


def test_edits(spark):
    ds = Dataset(spark.createDataFrame([(10, "Alpha"), (13, "Delta")], "code long, name string"), ("code",))
    outcomes, snapshot = edits.add(ds, spark.createDataFrame([(10, "again"), (14, "E"), (14, "E2")], "code long, name string"))
    assert sorted((r["code"], r["ok"]) for r in outcomes.collect()) == [(10, False), (14, False), (14, True)]
    assert sorted(tuple(r) for r in snapshot.collect()) == [(10, "Alpha"), (13, "Delta"), (14, "E")]
    outcomes, snapshot = edits.update(ds, spark.createDataFrame([(13, "D"), (99, "x")], "code long, name string"))
    assert sorted((r["code"], r["ok"]) for r in outcomes.collect()) == [(13, True), (99, False)]
    assert sorted(tuple(r) for r in snapshot.collect()) == [(10, "Alpha"), (13, "D")]
    outcomes, snapshot = edits.delete(ds, spark.createDataFrame([(10,), (77,)], "code long"))
    assert [r[0] for r in snapshot.select("code").collect()] == [13]
    assert edits.delete_where(ds, parse_filter("name LIKE 'A%'")).count() == 1
    assert edits.content_version(ds.df) == edits.content_version(ds.df.orderBy(F.desc("code"))) != edits.content_version(snapshot)
    t = edits.Transaction({"a": ds.df})
    t.stage("a", snapshot)
    t.rollback()
    assert t.tables["a"].count() == 2
    t.stage("a", snapshot)
    t.commit()
    assert t.tables["a"].count() == 1
