"""Geometry, relations, joins, coordinate systems and tiles against known shapes."""

import math
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from terrazzo.functions import crs, tiles
from terrazzo.functions import geometry as geo
from terrazzo.model import PlanError
from terrazzo.operators import spatial
from terrazzo.sources import demo, vector_tiles


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def wkt(text):
    return geo.call("st_fromtext", F.lit(text))


def test_measures(spark):
    ring = wkt("POLYGON((0 0,4 0,4 3,0 3,0 0),(1 1,2 1,2 2,1 2,1 1))")
    row = one(spark, geo.call("st_area", ring), geo.call("st_length", ring), geo.call("st_distance", wkt("POINT(7 0)"), ring), geo.call("st_astext", geo.call("st_centroid", wkt("LINESTRING(0 0,2 0)"))))
    assert row[0] == 11 and row[1] == 18 and row[2] == 3 and row[3] == "POINT (1 0)"
    assert one(spark, geo.call("st_area", F.lit(None).cast("binary")))[0] is None
    assert one(spark, geo.encode(wkt("POLYGON EMPTY")).alias("g"))["g"]["env"] is None


def test_constructions(spark):
    bow = wkt("POLYGON((0 0,2 2,2 0,0 2,0 0))")
    circle = geo.call("st_buffer", wkt("POINT(0 0)"), F.lit(1.0), F.lit(16))
    row = one(
        spark,
        geo.call("st_isvalid", bow).alias("bow"),
        geo.call("st_isvalid", geo.call("st_makevalid", bow)).alias("fixed"),
        geo.call("st_area", circle).alias("circle"),
        geo.call("st_area", geo.call("st_hull_all", F.array(wkt("POINT(0 0)"), wkt("POINT(4 0)"), wkt("POINT(0 4)"), wkt("POINT(1 1)")))).alias("hull"),
        geo.call("st_astext", geo.call("st_simplify", wkt("LINESTRING(0 0,1 0.01,2 0)"), F.lit(0.1))).alias("line"),
        geo.call("st_astext", geo.call("st_generalize", wkt("POLYGON((0 0,0.1 0,0.1 0.1,0 0))"), F.lit(5.0))).alias("kept"),
        geo.call("st_astext", geo.call("st_densify", wkt("LINESTRING(0 0,2 0)"), F.lit(1.0))).alias("dense"),
    )
    assert not row["bow"] and row["fixed"] and row["circle"] == pytest.approx(math.pi, rel=0.01) and row["hull"] == 8
    assert row["line"] == "LINESTRING (0 0, 2 0)" and row["kept"].startswith("POLYGON") and row["dense"] == "LINESTRING (0 0, 1 0, 2 0)"


@pytest.mark.parametrize(
    "name,feature,query,expected",
    [
        ("within", "POINT(1 1)", "POLYGON((0 0,2 0,2 2,0 2,0 0))", False),
        ("contains", "POINT(1 1)", "POLYGON((0 0,2 0,2 2,0 2,0 0))", True),
        ("touches", "POINT(0 0)", "POLYGON((0 0,2 0,2 2,0 2,0 0))", True),
        ("intersects", "POINT(0 0)", "POLYGON((0 0,2 0,2 2,0 2,0 0))", True),
        ("disjoint", "POINT(9 9)", "POLYGON((0 0,2 0,2 2,0 2,0 0))", True),
        ("overlaps", "POLYGON((1 1,3 1,3 3,1 3,1 1))", "POLYGON((0 0,2 0,2 2,0 2,0 0))", True),
        ("overlaps", "POINT(1 1)", "POLYGON((0 0,2 0,2 2,0 2,0 0))", False),
        ("crosses", "LINESTRING(-1 1,3 1)", "POLYGON((0 0,2 0,2 2,0 2,0 0))", True),
        ("crosses", "LINESTRING(0 0,2 2)", "LINESTRING(0 2,2 0)", True),
        ("equals", "LINESTRING(0 0,1 1)", "LINESTRING(1 1,0 0)", True),
    ],
)
def test_relations(spark, name, feature, query, expected):
    assert bool(one(spark, spatial.relation(wkt(feature), wkt(query), name))[0]) is expected


def test_mask_is_checked():
    for bad in ("T", "T*F**F**X", "T*F**F****"):
        with pytest.raises(PlanError):
            spatial.check_mask(bad)


def test_join_equals_the_product(spark):
    boxes = spark.range(60).select("id", F.expr("double(id * 7 % 40)").alias("x"), F.expr("double(id * 11 % 30)").alias("y"))
    left = boxes.select("id", geo.box(F.col("x"), F.col("y"), F.col("x") + 5, F.col("y") + 3).alias("a"))
    right = boxes.select(F.col("id").alias("other"), geo.box(F.col("x") - 2, F.col("y"), F.col("x") + 1, F.col("y") + 9).alias("b"))
    pairs = [tuple(r) for r in spatial.join(left, right, "a", "b", 4.0).select("id", "other").collect()]
    rows = [(i, i * 7 % 40, i * 11 % 30) for i in range(60)]
    brute = {(i, j) for i, x, y in rows for j, u, v in rows if x <= u + 1 and x + 5 >= u - 2 and y <= v + 9 and y + 3 >= v}
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute


def test_dissolve(spark):
    df = spark.range(40).select((F.col("id") % 2).alias("k"), geo.box(F.col("id"), F.lit(0), F.col("id") + 1, F.lit(1)).alias("g"))
    got = {r[0]: r[1] for r in geo.dissolve(df, ["k"], F.col("g.wkb")).select("k", geo.call("st_area", "wkb")).collect()}
    assert got == {0: 20.0, 1: 20.0}


def test_crs(spark):
    x, y = crs.transform(F.lit(9.0), F.lit(48.0), 4326, 32632)
    row = one(spark, x, y)
    assert row[0] == pytest.approx(500000, abs=1e-3) and row[1] == pytest.approx(5316300.2, abs=1.0)
    x, y = crs.transform(F.lit(180.0), F.lit(crs.MAX_LATITUDE), 4326, 3857)
    assert one(spark, x, y)[0] == pytest.approx(20037508.342789244) and one(spark, x, y)[1] == pytest.approx(20037508.342789244, rel=1e-9)
    assert crs.describe(32733).south and crs.describe(25832).name == "ETRS89 / UTM zone 32N"
    with pytest.raises(PlanError):
        crs.describe(1)


def test_tiles(spark):
    tx, ty = tiles.tile_of(F.lit(13.4), F.lit(52.5), 10)
    assert tuple(one(spark, tx, ty)) == (550, 335)
    assert tiles.tile_bounds(0, 0, 0)[2] == pytest.approx(20037508.342789244)
    assert tiles.resolution(0) == pytest.approx(156543.033928041)
    with pytest.raises(PlanError):
        tiles.tile_bounds(1, 2, 0)


def test_vector_tile_bytes(spark):
    bounds = F.array(*[F.lit(v) for v in (0.0, 0.0, 10.0, 10.0)])
    layer = lambda wkb, *properties: bytes(one(spark, geo.call("st_tilefeature", F.lit(wkb), F.struct(*properties), bounds, F.lit("l"), F.lit(10)))[0])
    point = layer(geo.wkb_point(5, 5), F.lit(1).alias("a"), F.lit("x").alias("b"))
    assert b"\x0a\x01l" in point and b"\x22\x03\x09\x0a\x0a" in point  # moveTo (5, 5)
    assert layer(geo.wkb_box(0, 0, 10, 10), F.lit(None).cast("int").alias("a")).count(b"\x0f") >= 1


def test_demo_sets(spark):
    ds = demo.points(spark)
    assert ds.df.count() == 110 and demo.world(spark).count() == 34135
    assert tuple(ds.df.agg(F.min("geometry.env.minx"), F.max("geometry.env.maxy")).first()) == (-5.0, 5.0)


def test_native_paths(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = F.array(p(0, 0), p(4, 0), p(4, 3), p(0, 3), p(0, 0))
    row = one(spark, geo.ring_area(ring), geo.path_length(ring), F.size(geo.densify_path(ring, 1.0)), geo.quantize(F.lit(2.5), 0.0, 1.0), geo.round_ordinates(F.lit(0.125), 2))
    assert tuple(row) == (12.0, 14.0, 15, 3.0, 0.12)


def test_jar_holds_what_the_source_declares():
    declared, held = set(), set()
    for source in (geo.JAR.parent / "src/terrazzo/geometry").glob("*.java"):
        names = re.findall(r"^  (?:public |private )?(?:static )?(?:final )?(?:class|interface|record) (\w+)", source.read_text(), re.M)
        declared |= {f"{source.stem}${n}" for n in names}
    with zipfile.ZipFile(geo.JAR) as jar:
        held = {m[1] for n in jar.namelist() if (m := re.fullmatch(r"terrazzo/geometry/(\w+\$[A-Za-z]\w*)\.class", n))}
    assert held == declared and {cls if "$" in cls else f"Functions${cls}" for _, cls, _ in geo.FUNCTIONS} <= held
