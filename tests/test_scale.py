"""What keeps plans whole at any size: brackets for percentiles, rounds of merging, grid levels, typed lookups; and masks, systems, tiles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrazzo.functions import crs, tiles
from terrazzo.functions import geometry as geo
from terrazzo.model import AggregateQuery, AggregateSpec, FeatureQuery, OrderTerm, PlanError
from terrazzo.operators import edits, identify, raster, related, served, shapes, spatial
from terrazzo.plans import execute
from terrazzo.plans.dataset import Dataset
from terrazzo.sources import vector_tiles


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def wkt(text):
    return geo.call("st_fromtext", F.lit(text))


# --- percentiles -------------------------------------------------------------------------------


def rank(values, fraction, kind, descending):
    values = sorted(values, reverse=descending)
    if not values:
        return None
    if kind == "percentile_disc":
        return values[max(math.ceil(fraction * len(values)) - 1, 0)]
    at = fraction * (len(values) - 1)
    low = math.floor(at)
    return values[low] + (values[math.ceil(at)] - values[low]) * (at - low)


@pytest.mark.parametrize("in_memory", [0, 1 << 60])
@pytest.mark.parametrize("fractions", [(0.0, 0.5, 1.0), (0.001, 0.25, 0.999)])
def test_percentiles_are_exact_beyond_the_sketch(spark, fractions, in_memory):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 7.0, round(rng.gauss(0, 50), 2), float(rng.randint(0, 9))])) for _ in range(90_000)] + [("c", None), ("d", 4.0)]
    ds = Dataset(spark.createDataFrame(rows, "g string, v double").repartition(4))
    specs = [AggregateSpec(kind, "v", f"{kind[11]}{k}{d}", f, d) for kind in ("percentile_cont", "percentile_disc") for k, f in enumerate(fractions) for d in (False, True)]
    by_group = execute.aggregate(ds, FeatureQuery(), AggregateQuery((AggregateSpec("count", "*", "n"), *specs), ("g",)), in_memory).collect()
    assert {r["g"] for r in by_group} == {"a", "b", "c", "d", None}
    whole = execute.aggregate(ds, FeatureQuery(), AggregateQuery(tuple(specs)), in_memory).collect()
    for r, values in [(r, [v for g, v in rows if g == r["g"] and v is not None]) for r in by_group] + [(whole[0], [v for _, v in rows if v is not None])]:
        for s in specs:
            assert r[s.name] == pytest.approx(rank(values, s.fraction, s.statistic, s.descending)), (r, s)


def test_brackets_hold_few_values(spark):
    """Whatever the size of a group: distinct values, ties, a third of all rows equal; all fields and ranks in the same rounds."""
    rng = random.Random(8)
    rows = [("big", rng.gauss(0, 1), float(rng.randrange(3)), 7.0 if k % 3 else rng.random()) for k in range(60_000)] + [("small", float(k), 1.0, 2.0) for k in range(30)] + [("none", None, None, None)]
    ds = Dataset(spark.createDataFrame(rows, "g string, a double, b double, c double").repartition(3))
    specs = [AggregateSpec(kind, f, f"{f}{k}{kind[11]}{d}", p, d) for f in "abc" for k, p in enumerate((0.0, 0.1, 0.5, 0.9999)) for kind in ("percentile_cont", "percentile_disc") for d in (False, True)]
    for inside in (40, 5000):
        found = {r["g0"]: r for r in execute.percentiles(ds.df, ("g",), specs, inside).collect()}
        assert set(found) == {"big", "small"}
        for g, r in found.items():
            for k, s in enumerate(specs):
                values = [row["abc".index(s.field) + 1] for row in rows if row[0] == g]
                assert r[f"p{k}"] == pytest.approx(rank(values, s.fraction, s.statistic, s.descending)), (g, s)
    long = ds.df.where("a is not null").select(F.col("g").alias("g0"), F.lit(0).alias("f"), F.col("a").alias("v"))
    held = execute.brackets(long, ["g0"], [specs[4]], [0], 40).collect()
    assert {r["g0"] for r in held} == {"big", "small"} and all(min(r["m"], r["d"]) <= 40 and r["below"] <= r["under"] <= r["over"] < r["below"] + r["m"] for r in held)


def test_size_decides_how_percentiles_are_ranked(spark, tmp_path):
    spark.range(1000).withColumn("v", F.col("id") / 3).write.parquet(f"{tmp_path}/t")
    ds = Dataset(spark.read.parquet(f"{tmp_path}/t"))
    a = AggregateQuery((AggregateSpec("percentile_cont", "v", "p", 0.5),))
    plan = lambda most: execute.aggregate(ds, FeatureQuery(), a, most)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" in plan(execute.IN_MEMORY) and "percentile" not in plan(100)  # ranked from what was written


# --- merging and joining -----------------------------------------------------------------------


def test_dissolve_in_rounds(spark):
    df = spark.range(400).select((F.col("id") % 3).alias("k"), geo.box(F.col("id"), F.lit(0), F.col("id") + 1, F.lit(1)).alias("g"))
    got = {r[0]: r[1] for r in geo.dissolve(df, ["k"], F.col("g.wkb"), fan=4).select("k", geo.call("st_area", "wkb")).collect()}
    assert got == {0: 134.0, 1: 133.0, 2: 133.0}
    hull = geo.dissolve(df, [], F.col("g.wkb"), "hull", fan=4).select(geo.call("st_area", "wkb")).first()[0]
    assert hull == 400.0 and geo.dissolve(df.limit(0), ["k"], F.col("g.wkb")).count() == 0


def test_join_of_shapes_of_all_sizes(spark):
    rng = random.Random(2)

    def shapes(n):
        rows = [(k, rng.uniform(-100, 100), rng.uniform(-100, 100), 2 ** rng.uniform(-3, 8), 2 ** rng.uniform(-3, 8)) for k in range(n)]
        return [(k, x, y, x + w, y + h) for k, x, y, w, h in rows] + [(n, -1e4, -1e4, 1e4, 1e4)]

    def frame(rows, name):
        df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
        return df.select(F.col("id").alias(name), geo.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias(f"g_{name}"))

    left, right = shapes(80), shapes(60)
    pairs = [tuple(r) for r in spatial.join(frame(left, "l"), frame(right, "r"), "g_l", "g_r", 1.0).select("l", "r").collect()]
    brute = {(p[0], q[0]) for p in left for q in right if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]}
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute
    for mask in ("FF2FF1212", "F********"):
        with pytest.raises(PlanError):
            spatial.join(frame(left, "l"), frame(right, "r"), "g_l", "g_r", 1.0, mask=mask)


@pytest.mark.parametrize("mask,expected", [("FF2FF1212", [2]), ("F********", [2]), ("*********", [1, 2]), ("T********", [1]), ("FF*FF****", [2])])
def test_masks_that_hold_apart(spark, mask, expected):
    rows = spark.createDataFrame([(1, 0.0), (2, 50.0)], "id int, x double")
    df = rows.select("id", geo.box(F.col("x"), F.lit(0), F.col("x") + 2, F.lit(2)).alias("g")).unionByName(rows.limit(1).select(F.lit(3).alias("id"), geo.box(F.lit(None), F.lit(0), F.lit(1), F.lit(1)).alias("g")))
    q = spatial.QueryGeometry(geo.wkb_box(1, 1, 4, 4), (1, 1, 4, 4), 2)
    assert sorted(r["id"] for r in spatial.filter_by(df, "g", q, "relation", mask).collect()) == expected


# --- identities --------------------------------------------------------------------------------


def test_lookups_reach_the_scan(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("a"), (F.col("id") % 7).cast("int").alias("b")).write.parquet(f"{tmp_path}/t")
    ds = Dataset(spark.read.parquet(f"{tmp_path}/t"), ("a", "b"))
    found = execute.features(ds, FeatureQuery(ids=("8|1", "9|1", "10|3", "nonsense", "08|1")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["a"] for r in found.collect()) == [8, 10]
    assert "PushedFilters: [In(a" in plan or "In(a, [8,9,10])" in plan, plan
    single = execute.features(Dataset(ds.df, ("a",)), FeatureQuery(ids=("5", "x", "99999999999999999999")))
    assert [r["a"] for r in single.collect()] == [5] and "EqualTo(a,5)" in single._jdf.queryExecution().executedPlan().toString()
    many = execute.select(Dataset(ds.df, ("a",)), FeatureQuery(ids=tuple(map(str, range(0, 3000, 2))))).df
    assert many.count() == 500


def test_composite_ids_tell_keys_apart(spark):
    keys = [("a|b", "c"), ("a", "b|c"), ("a\\", "|c"), (None, "c"), ("\\N", "c"), ("c", None), ("", "")]
    ds = Dataset(spark.createDataFrame(keys, "x string, y string"), ("x", "y"))
    ids = [r[0] for r in execute.features(ds, FeatureQuery()).select("__feature_id").collect()]
    assert len(set(ids)) == len(keys)
    for k, i in enumerate(ids):
        assert ds.keys(i) == keys[k]
        assert [tuple(r)[1:] for r in execute.features(ds, FeatureQuery(ids=(i,))).collect()] == [keys[k]]


# --- coordinate systems ------------------------------------------------------------------------

CLARKE = crs.CLARKE_1866


def test_published_projection_examples(spark):
    """Worked examples of a published handbook of map projections, and of the national mapping agency."""
    frame = lambda method, ellipsoid, *p: ",".join([method, *(repr(float(v)) for v in (*ellipsoid, *p, *(0,) * 7))])
    place = frame("geographic", CLARKE, 0, 0, 1, 0, 0, 0, 0)
    cases = [
        (frame("albers", CLARKE, -96, 23, 1, 0, 0, 29.5, 45.5), place, (-75, 35), (1885472.7, 1535925.0)),
        (frame("lambert", CLARKE, -96, 23, 1, 0, 0, 33, 45), place, (-75, 35), (1894410.9, 1564649.5)),
        (frame("mercator", CLARKE, -180, 0, 1, 0, 0, 0, 0), place, (-75, 35), (11688673.7, 4139145.6)),
        (frame("tm", CLARKE, -75, 0, 0.9996, 0, 0, 0, 0), place, (-73.5, 40.5), (127106.5, 4484124.4)),
        (frame("polar", (6378388.0, 297.0), -100, -90, 1, 0, 0, -71, 0), frame("geographic", (6378388.0, 297.0), 0, 0, 1, 0, 0, 0, 0), (150, -75), (-1540033.6, -560526.4)),
        (crs._frame(crs.describe(27700)), crs._frame(crs.describe(4277)), (1 + 43 / 60 + 4.5177 / 3600, 52 + 39 / 60 + 27.2531 / 3600), (651409.903, 313177.270)),
        (crs._frame(crs.describe(2154)), crs._frame(crs.describe(4171)), (3, 46.5), (700000, 6600000)),
        (crs._frame(crs.describe(5070)), crs._frame(crs.describe(4269)), (-96, 23), (0, 0)),
    ]
    for system, geographic, at, planar in cases:
        there = one(spark, geo.call("st_moved", F.lit(float(at[0])), F.lit(float(at[1])), F.lit(geographic), F.lit(system)))[0]
        assert there == pytest.approx(planar, abs=0.1)
        back = one(spark, geo.call("st_moved", F.lit(there[0]), F.lit(there[1]), F.lit(system), F.lit(geographic)))[0]
        assert back == pytest.approx(at, abs=3e-8)


@pytest.mark.parametrize("code,at", [(3395, (20, -50)), (5070, (-100, 40)), (27700, (-3, 55)), (2154, (6, 43)), (2193, (175, -40)), (3031, (-60, -80)), (3032, (110, -70)), (3413, (100, 75)), (3976, (30, -65)), (3995, (-170, 88)), (3996, (5, 60)), (4267, (-100, 40)), (25832, (9.5, 51)), (3857, (179, 80))])
def test_every_system_returns(spark, code, at):
    x, y = crs.transform(F.lit(float(at[0])), F.lit(float(at[1])), 4326, code)
    there = one(spark, x, y)
    x, y = crs.transform(F.lit(there[0]), F.lit(there[1]), code, 4326)
    assert tuple(one(spark, x, y)) == pytest.approx(at, abs=1e-7)
    point = crs.transform_geometry(wkt(f"POINT({at[0]} {at[1]})"), 4326, code)
    assert one(spark, geo.call("st_bounds", point))[0][:2] == pytest.approx(list(there), abs=1e-6)


def test_datums(spark):
    # the airy ellipsoid's datum lies some hundred metres off
    x, y = crs.transform(F.lit(0.0), F.lit(51.4778), 4277, 4326)
    lon, lat = one(spark, x, y)
    assert 0.001 < math.hypot(lon, lat - 51.4778) < 0.003
    found = crs.find_transformations(27700, 4326)
    assert [c["method"] for c in found][0] == "position vector" and found[0]["accuracy"] == 2.0 and len(found) == 3 and found == sorted(found, key=lambda c: c["accuracy"])
    assert crs.find_transformations(4326, 3857) == [] and crs.find_transformations(4258, 4171)[0]["accuracy"] == pytest.approx(math.hypot(1, 1))
    assert crs.find_transformations(4258, 4269) == []  # no place is in both areas
    assert crs.find_transformations(27700, 4326, (10, 50, 11, 51)) == [] and crs.find_transformations(4167, 4326, (175, -40, 176, -39))
    assert crs.describe(102100).code == 3857 and crs.describe(4326).axes[0] == ("Longitude", "east", "degree") and len(crs.catalogue()) == 7 + 12 + 60 + 60 + 11 + 23


# --- the served surface, tiles, edits ----------------------------------------------------------


def places(spark):
    df = spark.range(30).select("id", geo.box(F.col("id"), F.lit(0), F.col("id") + 0.6, F.lit(0.37)).alias("g"))
    return Dataset(df, ("id",), ("id",), "places")


def test_page_says_that_rows_follow(spark):
    first = served.page(places(spark), {"resultRecordCount": "20"})
    assert first.rows.count() == 20 and first.has_more and first.next_cursor == "20"
    last = served.page(places(spark), {"resultRecordCount": "20", "resultOffset": "20"})
    assert last.rows.count() == 10 and not last.has_more and not served.page(places(spark), {"returnCountOnly": "true"}).has_more


def test_ordinates_of_all_shapes(spark):
    ds = places(spark)
    asked = {"objectIds": "3", "geometryPrecision": "1"}
    assert served.serve(ds, asked).select(geo.call("st_astext", F.col("g.wkb"))).first()[0] == "POLYGON ((3 0, 3.6 0, 3.6 0.4, 3 0.4, 3 0))"
    asked = {"objectIds": "3", "quantizationParameters": '{"tolerance":0.5,"extent":{"xmin":0,"ymax":10}}'}
    assert served.serve(ds, asked).select(geo.call("st_astext", F.col("g.wkb"))).first()[0] == "POLYGON ((3 0, 3.5 0, 3.5 0.5, 3 0.5, 3 0))"


def test_query_geometry_in_another_system(spark):
    x, y = crs.transform(F.lit(3.2), F.lit(0.1), 4326, 3857)
    at = one(spark, x, y)
    asked = {"geometry": f'{{"x":{at[0]},"y":{at[1]}}}', "inSR": "3857", "returnIdsOnly": "true"}
    assert [r[0] for r in served.serve(places(spark), asked).collect()] == [3]
    for units in ("esriSRUnit_Meter", "esriSRUnit_Furlong"):
        with pytest.raises(PlanError):
            served.serve(places(spark), {"geometry": "1,1", "distance": "3", "units": units})


def test_one_tile(spark):
    df = spark.range(3).select("id", geo.box(F.col("id") * 60 - 90, F.lit(-10), F.col("id") * 60 - 70, F.lit(10)).alias("g"))
    ds = Dataset(df, ("id",), ("id",), "t")
    whole = vector_tiles.tile(ds, 0, 0, 0, 4326).first()
    west = vector_tiles.tile(ds, 1, 0, 0, 4326).first()
    assert whole["n"] == 3 and west["n"] == 2 and vector_tiles.tile(ds, 3, 7, 0, 4326).count() == 0
    assert one(spark, F.sort_array(tiles.tiles_of(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)), 1)))[0] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    flagged = vector_tiles.encode(df.select("id", crs.transform_geometry(F.col("g.wkb"), 4326, 3857).alias("m")), 0, "m", ["id"], most=1).collect()
    assert [(r["over"], r["n"]) for r in flagged] == [(True, 3)] and not whole["over"]


def test_edits_together(spark):
    ds = Dataset(spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string"), ("id",))
    row = lambda *r: spark.createDataFrame(list(r), "id int, s string")
    outcomes, after = edits.apply_edits(ds, row((3, "c")), row((3, "C")), row((1, "")).select("id"))
    assert sorted(map(tuple, after.collect())) == [(2, "b"), (3, "C")] and outcomes.where("not ok").count() == 0
    outcomes, after = edits.apply_edits(ds, row((3, "c"), (1, "again")), rollback=True)
    assert after.count() == 2 and [(r["edit"], r["id"], r["error"]) for r in outcomes.where("not ok").collect()] == [("add", 1, "duplicate")]
    assert edits.apply_edits(ds, row((3, "c"), (1, "again")), rollback=False)[1].count() == 3
    with pytest.raises(PlanError):
        edits.apply_edits(ds)


def test_feature_info(spark):
    layers = {"places": (places(spark), "g")}
    found = identify.feature_info(layers, (0, -10, 100, 10), 1000, 200, 32, 98, pixels=1)
    assert [r["feature_id"] for r in found.collect()] == ["3"]
    assert identify.feature_info(layers, (0, -10, 100, 10), 1000, 200, 32, 98, pixels=1000, most=1).count() == 1
    with pytest.raises(PlanError):
        identify.feature_info(layers, (0, 0, 1, 1), 10, 10, 10, 0)


def test_equal_shapes_are_one(spark):
    """Ten thousand equal points, and as many scattered ones: no run holds more than its share, and the union is right."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(F.col("id") * 7 % 997).alias("x"), F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(F.col("id") * 13 % 991).alias("y"))
    df = rows.select(F.lit("a").alias("k"), geo.box(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1)["wkb"].alias("g"))
    cells = rows.distinct().count()
    row = geo.dissolve(df, ["k"], F.col("g")).select(geo.call("st_area", F.col("wkb"))).collect()
    assert len(row) == 1 and row[0][0] == pytest.approx(cells)
    assert geo.dissolve(df.where("false"), ["k"], F.col("g")).count() == 0
    nulls = df.limit(200).withColumn("g", F.lit(None).cast("binary"))
    assert [r["wkb"] for r in geo.dissolve(nulls, ["k"], F.col("g")).collect()] == [None]


def test_neighbours_merge_first(spark):
    """Along the curve, runs of neighbours lose their inner edges in the first round: fewer positions are left than by hash."""
    grid = spark.range(4096).select((F.col("id") % 64).cast("double").alias("x"), F.floor(F.col("id") / 64).cast("double").alias("y"))
    boxes = grid.select("x", "y", geo.box(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1)["wkb"].alias("g"))

    def left(order):
        runs = boxes.repartitionByRange(4, order).sortWithinPartitions(order).withColumn("run", F.expr("monotonically_increasing_id() div 64"))
        merged = runs.groupBy("run").agg(geo.call("st_union_all", F.collect_list("g")).alias("g"))
        return merged.agg(F.sum(F.size(geo.call("st_ordinates", F.col("g"))))).first()[0]

    assert left(geo.along_curve(F.col("x"), F.col("y"), (0.0, 0.0, 63.0, 63.0))) * 3 < left(F.xxhash64("g"))
    near = spark.range(1).select(*[geo.along_curve(F.lit(float(x)), F.lit(float(y)), (0.0, 0.0, 65535.0, 65535.0)) for x, y in ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (65535, 65535))]).first()
    assert list(near) == [0, 1, 2, 3, 4, (1 << 32) - 1]
    merged = geo.dissolve(boxes.select("g"), [], F.col("g")).first()
    assert spark.range(1).select(geo.call("st_area", F.lit(bytes(merged["wkb"])))).first()[0] == pytest.approx(4096)


def test_join_deals_keys_alone(spark):
    """Shapes of twenty levels on one side, one on the other: copies are few, and carry no shape."""
    from terrazzo.operators import spatial

    left = spark.range(300).select(F.col("id").alias("a"), geo.box(F.col("id"), F.lit(0.0), F.col("id") + F.pow(F.lit(2.0), F.col("id") % 20), F.lit(1.0)).alias("p"))
    right = spark.range(500).select(F.col("id").alias("b"), geo.box(F.col("id") * 3, F.lit(0.5), F.col("id") * 3 + 0.5, F.lit(2.0)).alias("q"))
    kept = spatial._kept(left, "p", 1.0, "_l")
    dealt = spatial._dealt(kept, "p", 1.0, [0], "_l")
    assert "wkb" not in dealt.schema.simpleString() and dealt.count() <= 4 * 300
    got = sorted((r["a"], r["b"]) for r in spatial.join(left, right, "p", "q", 1.0).select("a", "b").collect())
    want = sorted((a, b) for a in range(300) for b in range(500) if a <= b * 3 + 0.5 and a + 2 ** (a % 20) >= b * 3)
    assert got == want


def test_equal_shapes_join_once(spark, monkeypatch):
    """Two thousand rows a side of few shapes: the relation is looked at a pair of shapes, and pairs of rows are dealt over many tasks."""
    monkeypatch.setattr(spatial, "PART", 64)
    monkeypatch.setattr(spatial, "TASK", 100_000)
    box = lambda n, k: geo.box(F.col("id") % n * 2.0, F.lit(0.0), F.col("id") % n * 2.0 + k, F.lit(1.0))
    left = spark.range(2000).select(F.col("id").alias("a"), box(4, 1.0).alias("p"), (F.col("id") % 3).alias("w"))
    right = spark.range(2000).select(box(5, 2.0).alias("q"), F.col("id").alias("b"))
    joined = spatial.join(left, right, "p", "q", 1.0)
    assert joined.columns == ["a", "p", "w", "q", "b"] and joined.rdd.getNumPartitions() > 10
    assert "st_related" not in joined._jdf.queryExecution().optimizedPlan().toString()  # done already, for pairs of shapes
    meets = sum(i * 2 <= j * 2 + 2 and i * 2 + 1 >= j * 2 for i in range(4) for j in range(5))
    got = joined.agg(F.count("*"), F.countDistinct("a", "b"), F.max(F.abs(F.col("p.env.minx") - F.col("a") % 4 * 2)), F.max(F.abs(F.col("w") - F.col("a") % 3)), F.max(F.abs(F.col("q.env.minx") - F.col("b") % 5 * 2))).first()
    assert tuple(got) == (meets * 500 * 400, meets * 500 * 400, 0.0, 0, 0.0)


def test_tiles_of_an_edit(spark):
    """After random edits the refreshed tiles are those built anew, and only dirty ones were encoded."""
    from terrazzo.sources import tile_cache

    rng = random.Random(12)
    shape = lambda x, y, size: geo.call("st_box", x, y, x + size, y + size)
    rows = {k: (rng.uniform(-1.9e7, 1.9e7), rng.uniform(-1.9e7, 1.9e7), rng.choice([1.0, 3e6]), f"n{k % 4}") for k in range(120)}
    table = lambda: spark.createDataFrame([(k, *v) for k, v in rows.items()], "id long, x double, y double, size double, name string").withColumn("m", shape(F.col("x"), F.col("y"), F.col("size"))).select("id", "name", "m")
    zooms = [0, 2, 5]
    before = table()
    cached = tile_cache.build(before, zooms, "m", ["id", "name"]).cache()
    for k in rng.sample(list(rows), 6):
        x, y, size, name = rows[k]
        rows[k] = (x / 2, y, size, name) if k % 2 else (x, y, size, "renamed")
    del rows[3]
    rows[500] = (0.0, 0.0, 5.0, None)
    after = table()
    said = lambda df: {(r["z"], r["x"], r["y"]): (r["n"], bytes(r["tile"])) for r in df.collect()}
    lost = tile_cache.dirty(tile_cache.changed(before, after, ["id"], "m", ["id", "name"]), zooms)
    assert said(tile_cache.refreshed(cached, before, after, ["id"], zooms, "m", ["id", "name"])) == said(tile_cache.build(after, zooms, "m", ["id", "name"]))
    assert 3 <= lost.count() < cached.count() and said(tile_cache.refreshed(cached, before, before, ["id"], zooms, "m", ["id", "name"])) == said(cached)


def test_raster_at_a_location(spark):
    cells = spark.createDataFrame([("r", 1, 0, 0, 5.0), ("r", 2, 0, 0, 6.0), ("r", 1, 1, 2, 7.0), ("s", 1, 3, 3, 8.0)], "raster_id string, band int, row long, col long, value double")
    rasters = spark.createDataFrame([("r", 100.0, 50.0, 10.0, 5.0, 2, 3), ("s", 90.0, 60.0, 10.0, 5.0, 4, 4)], "raster_id string, minx double, maxy double, pixel_width double, pixel_height double, rows int, cols int")
    at = lambda x, y: sorted((r["raster_id"], r["band"], r["value"]) for r in raster.identify_at(cells, rasters, x, y).collect())
    assert at(100, 50) == [("r", 1, 5.0), ("r", 2, 6.0)] and at(120.1, 44.9) == [("r", 1, 7.0), ("s", 1, 8.0)] and at(99, 50) == [] and at(130, 41) == []
    items = Dataset(spark.createDataFrame([(1, 0.0), (2, 115.0)], "id int, x double").withColumn("g", geo.box(F.col("x"), F.lit(0.0), F.col("x") + 10, F.lit(60.0))), ("id",), ("id",), "items")
    assert [r["items"] for r in raster.identify_at(cells, rasters, 120.1, 44.9, items).collect()] == [["2"], ["2"]]


def test_object_ids(spark):
    ds = Dataset(spark.createDataFrame([("b", 5), ("a", 6)], "s string, n int").coalesce(1), ("s",))
    assert [r["object_id"] for r in shapes.with_object_ids(ds).collect()] == [1, 2]
    assert sorted(r["object_id"] for r in shapes.with_object_ids(Dataset(ds.df, ("n",))).collect()) == [5, 6]


def test_pages_over_layers(spark):
    a = Dataset(spark.createDataFrame([(1, "x"), (2, None)], "id int, s string"), ("id",))
    b = Dataset(spark.createDataFrame([("1", "x", 7), ("0", "w", 8)], "id string, s string, more int"), ("id",))
    page = shapes.layers_page({"b": b, "a": a}, order=(OrderTerm("s"),), limit=3)
    assert [(r["layer"], r["__feature_id"]) for r in page.rows.collect()] == [("b", "0"), ("b", "1"), ("a", "1")] and page.total == 4 and page.has_more and page.next_cursor == "3"
    with pytest.raises(PlanError):
        shapes.layers_page({"a": a}, order=(OrderTerm("nothing"),))


def test_shaping_and_batches(spark):
    ds = Dataset(spark.range(1300).withColumn("v", F.col("id") % 10), ("id",), ("id",))
    q = FeatureQuery(order=(OrderTerm("v", True),), limit=5, offset=2)
    assert execute.finish(ds, q).collect() == execute.features(ds, q).collect()
    assert [len(b) for b in execute.batches(ds.df)] == [512, 512, 276] and list(execute.batches(ds.df.limit(0))) == []


def test_guids_order_whatever_their_case(spark):
    rows = [("B0000000-0000-0000-0000-000000000000",), ("a0000000-0000-0000-0000-000000000000",), (None,)]
    df = spark.createDataFrame(rows, "g string").select(F.col("g").alias("g", metadata={"kind": "guid"}))
    assert [r["g"] and r["g"][0] for r in execute.features(Dataset(df), FeatureQuery(order=(OrderTerm("g"),))).collect()] == ["a", "B", None]


def test_related_requests_are_whole():
    related.check_parameters({"outFields": "*", "returnCountOnly": "false"})
    for name in related.REFUSED:
        with pytest.raises(PlanError):
            related.check_parameters({name: "true"})


def test_views_are_simplified(spark):
    df = spark.createDataFrame([(1, "POLYGON((0 0,50 0.01,100 0,100 100,0 100,0 0))"), (2, "POLYGON((500 500,600 500,600 600,500 500))"), (3, None)], "id int, t string").withColumn("g", geo.encode(geo.call("st_fromtext", F.col("t"))))
    shown = identify.simplified(df, "g", (-10, -10, 110, 110), 100).collect()
    assert [r["id"] for r in shown] == [1] and spark.range(1).select(F.size(geo.call("st_ordinates", F.lit(bytes(shown[0]["g"]["wkb"]))))).first()[0] == 10
    parts = spark.range(1).select(geo.call("st_parts", wkt("GEOMETRYCOLLECTION(POINT(1 2),MULTILINESTRING((0 0,1 1),(2 2,3 3)))"))).first()[0]
    assert len(parts) == 3


def test_links_categories_and_tile_coordinates(spark):
    pair = lambda *r: spark.createDataFrame(list(r), "a int, b int")
    joins = edits.link(pair((1, 2), (3, 4)), pair((3, 4), (5, 6)))
    assert sorted(map(tuple, edits.unlink(joins, pair((1, 2), (9, 9))).collect())) == [(3, 4), (5, 6)]
    cells = spark.createDataFrame([(1, 7), (2, 8)], "row int, value int")
    named = raster.classified(cells, spark.createDataFrame([(7, "water")], "value int, category string"))
    assert sorted((r["row"], r["category"]) for r in named.collect()) == [(1, "water"), (2, None)]
    x, y = tiles.quantized(F.lit(1.0), F.lit(3.0), (0.0, 0.0, 4.0, 4.0))
    assert tuple(one(spark, x, y)) == (1024, 1024)
