"""Query conformance over the six-row fixture: order, pages, distinct, reductions, refusals."""

import pytest
from pyspark.sql import functions as F

from terrazzo.functions.geometry import point
from terrazzo.model import AggregateQuery, AggregateSpec, Box, FeatureQuery, OrderTerm, PlanError
from terrazzo.operators import shapes
from terrazzo.plans import execute
from terrazzo.plans.dataset import ID, Dataset, schema_extends
from terrazzo.plans.parse import parse_filter

ROWS = [
    (1, "a", 10, 1.5, "Alpha", 1.0),
    (2, "a", 15, 2.5, "bravo", 1.0),
    (3, "A", None, 0.5, "_charlie", 2.0),
    (4, "A", 30, None, "Charlie", 2.0),
    (5, None, 20, 4.5, "a-delta", 3.0),
    (6, "_c", 20, 4.5, "echo", 9.0),
]


@pytest.fixture(scope="module")
def ds(spark):
    df = spark.createDataFrame(ROWS, "id long, category string, score long, ratio double, name string, x double")
    return Dataset(df.withColumn("shape", point(F.col("x"), F.col("x"))).cache(), ("id",), ("id",), "six")


def ids(df):
    return [int(r[ID]) for r in df.collect()]


@pytest.mark.parametrize(
    "order,expected",
    [
        ((), [1, 2, 3, 4, 5, 6]),
        ((OrderTerm("score"),), [1, 2, 5, 6, 4, 3]),
        ((OrderTerm("score", True),), [3, 4, 5, 6, 2, 1]),
        ((OrderTerm("category"), OrderTerm("score", True)), [3, 4, 6, 2, 1, 5]),
        ((OrderTerm("category", True),), [5, 1, 2, 6, 3, 4]),
        ((OrderTerm("name"),), [1, 4, 3, 5, 2, 6]),
    ],
)
def test_order(ds, order, expected):
    assert ids(execute.features(ds, FeatureQuery(order=order, limit=10))) == expected


def test_ids_tie_as_text(spark):
    df = spark.createDataFrame([(2, 1), (10, 1), (1, 1)], "id long, v int")
    assert ids(execute.features(Dataset(df, ("id",)), FeatureQuery(order=(OrderTerm("v"),)))) == [1, 10, 2]


def test_nan_is_smallest(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None), (4, float("-inf"))], "id long, v double")
    ds = Dataset(df, ("id",))
    assert ids(execute.features(ds, FeatureQuery(order=(OrderTerm("v"),)))) == [1, 4, 2, 3]
    assert ids(execute.features(ds, FeatureQuery(order=(OrderTerm("v", True),)))) == [3, 2, 4, 1]
    assert execute.count(ds, FeatureQuery(where=parse_filter("v > 0"))) == 1


def test_box_ids_projection(ds):
    assert ids(execute.features(ds, FeatureQuery(box=Box(0.5, 0.5, 4.5, 4.5)))) == [1, 2, 3, 4, 5]
    assert ids(execute.features(ds, FeatureQuery(box=Box(-50, -50, -40, -40)))) == []
    assert ids(execute.features(ds, FeatureQuery(box=Box(9, 9, 20, 20)))) == [6]
    assert ids(execute.features(ds, FeatureQuery(ids=("2", "6", "x")))) == [2, 6]
    assert ids(execute.features(ds, FeatureQuery(ids=()))) == []
    assert ids(execute.features(ds, FeatureQuery(ids=tuple(map(str, range(2, 3000)))))) == [2, 3, 4, 5, 6]
    assert execute.features(ds, FeatureQuery(projection=("name", "id"))).columns == [ID, "name", "id"]


def test_walk_pages(ds):
    seen, q = [], FeatureQuery(order=(OrderTerm("score", True),), limit=2)
    page = execute.page(ds, q)
    while True:
        seen += ids(page.rows)
        if not page.has_more:
            break
        page = execute.page(ds, FeatureQuery(order=q.order, limit=2, cursor=page.next_cursor))
    assert seen == [3, 4, 5, 6, 2, 1] and page.next_cursor is None and page.total == 6
    assert ids(execute.features(ds, FeatureQuery(limit=0))) == []


def test_count_and_distinct(ds):
    assert execute.count(ds, FeatureQuery(where=parse_filter("score >= 0"))) == 5
    first_seen = [tuple(r) for r in execute.distinct(ds, FeatureQuery(), ("category",)).collect()]
    assert first_seen == [("a",), ("A",), (None,), ("_c",)]
    by_order = [r[0] for r in execute.distinct(ds, FeatureQuery(order=(OrderTerm("category", True),)), ("category",)).collect()]
    assert by_order == [None, "a", "_c", "A"]


SPECS = (
    AggregateSpec("count", "*", "rows"),
    AggregateSpec("count", "score", "scored"),
    AggregateSpec("sum", "score", "total"),
    AggregateSpec("avg", "score", "mean"),
    AggregateSpec("min", "name", "first"),
    AggregateSpec("max", "name", "last"),
    AggregateSpec("var", "score", "var"),
    AggregateSpec("percentile_cont", "score", "p90", 0.9),
    AggregateSpec("percentile_disc", "score", "p50", 0.5),
    AggregateSpec("envelope", "shape", "box"),
)


def test_aggregate_groups(ds):
    rows = {r["category"]: r for r in execute.aggregate(ds, FeatureQuery(), AggregateQuery(SPECS, ("category",))).collect()}
    assert rows["a"]["total"] == 25 and rows["a"]["mean"] == 12.5 and rows["a"]["var"] == 12.5 and rows["a"]["p90"] == pytest.approx(14.5)
    assert rows["A"]["scored"] == 1 and rows["A"]["var"] is None and rows["A"]["rows"] == 2 and rows["A"]["first"] == "Charlie"
    assert rows[None]["rows"] == 1 and tuple(rows["A"]["box"]) == (2.0, 2.0, 2.0, 2.0)


def test_aggregate_over_nothing(ds):
    q = FeatureQuery(where=parse_filter("score > 1000"))
    row = execute.aggregate(ds, q, AggregateQuery(SPECS)).first()
    assert row["rows"] == 0 and all(row[s.name] is None for s in SPECS[1:])
    assert all(v is None for v in shapes.served_statistics(ds, q, AggregateQuery(SPECS)).first())
    assert execute.aggregate(ds, q, AggregateQuery(SPECS, ("category",))).count() == 0


def test_having_and_group_page(ds):
    a = AggregateQuery(SPECS[:2], ("category",), parse_filter("scored >= 1 AND rows < 5"), (OrderTerm("rows", True), OrderTerm("category")), 1, 1)
    page = execute.group_page(ds, FeatureQuery(), a)
    assert [r["category"] for r in page.rows.collect()] == ["a"] and page.total == 4 and page.has_more


@pytest.mark.parametrize(
    "q",
    [
        FeatureQuery(projection=("nope",)),
        FeatureQuery(projection=("id", "id")),
        FeatureQuery(order=(OrderTerm("nope"),)),
        FeatureQuery(order=(OrderTerm("shape"),)),
        FeatureQuery(limit=-1),
        FeatureQuery(offset=-1),
        FeatureQuery(cursor="v1.0.abc", offset=1),
        FeatureQuery(cursor="v1.5.deadbeefdeadbeef"),
        FeatureQuery(cursor="nonsense"),
        FeatureQuery(ids=(" ",)),
    ],
)
def test_bad_plans(ds, q):
    with pytest.raises(PlanError) as e:
        execute.features(ds, q)
    assert e.value.code == "invalid.arguments" and str(e.value)


@pytest.mark.parametrize(
    "a",
    [
        AggregateQuery(()),
        AggregateQuery((AggregateSpec("sum", "name", "s"),)),
        AggregateQuery((AggregateSpec("sum", "*", "s"),)),
        AggregateQuery((AggregateSpec("percentile_cont", "score", "p", 1.5),)),
        AggregateQuery((AggregateSpec("median", "score", "m"),)),
        AggregateQuery((AggregateSpec("envelope", "score", "e"),)),
        AggregateQuery((AggregateSpec("count", "*", "n"),), ("category",), parse_filter("score > 1")),
        AggregateQuery((AggregateSpec("count", "*", "n"),), ("category",), limit=0),
        AggregateQuery((AggregateSpec("count", "*", "category"),), ("category",)),
    ],
)
def test_bad_reductions(ds, a):
    with pytest.raises(PlanError):
        execute.aggregate(ds, FeatureQuery(), a)


def test_shapes(ds):
    assert [tuple(r) for r in shapes.class_breaks(ds, FeatureQuery(), "score", 2).collect()] == [(1, 10.0, 20.0), (2, 20.0, 30.0)]
    assert sorted(r[0] for r in shapes.unique_values(ds, FeatureQuery(), "category").collect()) == ["A", "_c", "a"]
    with pytest.raises(PlanError):
        shapes.unique_values(ds, FeatureQuery(), "name", most=2)
    found = shapes.find_text(ds, "CHARLIE").select("id", "found_field").orderBy("id").collect()
    assert [tuple(r) for r in found] == [(3, "name"), (4, "name")]
    with pytest.raises(PlanError):
        shapes.check_shapes({"ids_only", "extent_only"})
    assert tuple(shapes.extent_only(ds, FeatureQuery()).first()) == (1.0, 1.0, 9.0, 9.0, 6)


def test_schema_evolution(ds):
    fields = ds.df.schema.fields
    assert schema_extends(ds.df.schema, fields[:3]) and not schema_extends(ds.df.schema, fields[1:3])


def test_top_k_plan(ds):
    plan = execute.features(ds, FeatureQuery(order=(OrderTerm("score"),), limit=2, offset=1))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
