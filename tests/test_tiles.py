"""Mergeable tile layers: the same bytes however rows are dealt, one tile with all rows, every kind of shape and value."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from terrazzo.functions import geometry as geo
from terrazzo.functions import tiles
from terrazzo.sources import vector_tiles

SHAPES = ["POINT(1 2)", "POINT(-3 4)", "MULTIPOINT((1 1),(2 2))", "LINESTRING(0 0,10 10,20 0)", "MULTILINESTRING((0 0,5 5),(9 9,1 1))", "POLYGON((0 0,10 0,10 10,0 10,0 0),(2 2,2 4,4 4,4 2,2 2))", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))", "POINT EMPTY", None]


def shapes(spark, n=400, parts=7):
    df = spark.range(n).select("id", F.element_at(F.array(*[F.lit(s) for s in SHAPES]), (F.col("id") % len(SHAPES) + 1).cast("int")).alias("text"))
    wkb = geo.call("st_fromtext", F.col("text"))
    named = df.withColumns({"wkb": wkb, "name": F.concat(F.lit("n"), F.col("id") % 5), "odd": F.when(F.col("id") % 3 > 0, F.col("id") % 2 == 1), "size": F.col("id") / 4})
    return named.repartition(parts)


def tiles_of(df, **more):
    rows = vector_tiles.encode(df, 0, "wkb", ["id", "name", "odd", "size"], **more).collect()
    return {(r["x"], r["y"]): (r["n"], bytes(r["tile"])) for r in rows}


def test_bytes_do_not_depend_on_the_dealing(spark):
    whole = tiles_of(shapes(spark, parts=1).coalesce(1))
    assert tiles_of(shapes(spark, parts=9)) == whole and tiles_of(shapes(spark, parts=3).orderBy(F.rand(3))) == whole


def test_pieces_merge_to_the_tile(spark):
    df = shapes(spark)
    cut = vector_tiles.pieces(df, 0, "wkb", ["id", "name", "odd", "size"], most=16)
    rows = cut.collect()
    assert max(r["n"] for r in rows) <= 16 and len(rows) > 20 and all(r["n"] >= 1 for r in rows)
    merged = cut.groupBy("x", "y").agg(F.sum("n").alias("n"), F.call_function("st_mergelayers", F.col("layer")).alias("layer")).select("x", "y", "n", vector_tiles.message(F.col("layer")).alias("tile")).collect()
    assert {(r["x"], r["y"]): (r["n"], bytes(r["tile"])) for r in merged} == tiles_of(df)


def test_features_come_back(spark):
    row = spark.createDataFrame(
        [(1, "a", True, 2.5, -7, datetime.date(2020, 1, 2), decimal.Decimal("1.50"), None)], "id int, s string, b boolean, d double, l long, day date, c decimal(5,2), nothing string"
    ).withColumn("wkb", geo.call("st_fromtext", F.lit("LINESTRING(0 0,1000000 -2000000)")))
    tile = vector_tiles.encode(row, 0, "wkb", ["id", "s", "b", "d", "l", "day", "c", "nothing"])
    (feature,) = tile.select(vector_tiles.features(vector_tiles.layer_of(F.col("tile")))).first()[0]
    at = lambda v: round(v / (tiles.tile_bounds(0, 0, 0)[2] * 2) * 4096)
    assert feature["kind"] == 2 and feature["xs"] == [2048, 2048 + at(1e6)] and feature["ys"] == [2048, 2048 + at(2e6)]
    assert feature["properties"] == {"id": "1", "s": "a", "b": "true", "d": "2.5", "l": "-7", "day": "2020-01-02", "c": "1.50"}


def test_one_tile_with_all_rows(spark):
    """Sixty thousand points of one tile, a third of them equal, over many tasks."""
    df = spark.range(60_000, numPartitions=40).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("id"), F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise(F.col("id") * 7.0).alias("at"))
    df = df.select("id", geo.call("st_point", F.col("at"), F.col("at")).alias("wkb"))
    row = vector_tiles.encode(df, 0, "wkb", ["id"], most=10_000).select("n", "over", geo.call("st_tilecount", vector_tiles.layer_of(F.col("tile"))).alias("held"), F.length("tile").alias("bytes")).collect()
    assert [(r["n"], r["over"], r["held"]) for r in row] == [(60_000, True, 60_000)]
    read = vector_tiles.encode(df, 0, "wkb", ["id"]).select(F.explode(vector_tiles.features(vector_tiles.layer_of(F.col("tile"))))).select("col.*")
    counts = read.groupBy(F.col("properties.id").cast("long").alias("id")).count()
    assert counts.count() == 40_001 and counts.where("id = -1").first()["count"] == 20_000


def test_tiles_met_as_by_expressions(spark):
    """The JVM's tiles are those of the expressions, edges and what lies outside of the scheme included."""
    edge = tiles.tile_bounds(3, 5, 2)
    spots = [(0.0, 0.0), (edge[0], edge[1]), (edge[2], edge[3]), (2.1e7, 0.0), (-2.1e7, 5.0), (1e6, -3e6), (edge[0] + 1, edge[3] - 1)]
    rows = [(x, y, w) for x, y in spots for w in (0.0, 1.0, 9e6)]
    df = spark.createDataFrame(rows, "x double, y double, w double").withColumn("g", F.when(F.col("w") == 0, geo.call("st_point", F.col("x"), F.col("y"))).otherwise(geo.call("st_box", F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("w"))))
    for z in (0, 3, 5):
        both = df.select(F.array_sort(tiles.tiles_of(geo.call("st_bounds", F.col("g")), z)).alias("a"), F.array_sort(geo.call("st_tilesmet", F.col("g"), F.lit(z))).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in both) and (z == 0 or any(len(r["a"]) > 3 for r in both))


@pytest.mark.parametrize("n", [1, 127, 128, 16_383, 16_384, 3_000_000])
def test_lengths(spark, n):
    made = bytes(spark.range(1).select(vector_tiles.message(F.repeat(F.lit("x"), n).cast("binary"))).first()[0])
    back = spark.createDataFrame([(bytearray(made),)], "t binary").select(F.length(vector_tiles.layer_of(F.col("t")))).first()[0]
    length, shift, at = 0, 0, 1
    while True:
        length |= (made[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if made[at - 1] < 128:
            break
    assert made[0] == 26 and length == n == back and len(made) == at + n


def test_an_edit_encodes_what_dirty_tiles_hold(spark):
    """Tiles that no edit meets are left out before features are encoded, and which tiles are dirty is found once."""
    from terrazzo.sources import tile_cache

    before = spark.range(300).select("id", geo.call("st_point", F.col("id") * 60_000.0 - 9e6, F.lit(5e6)).alias("m"))
    after = before.where("id != 7")
    only = spark.createDataFrame([(2, 3)], "x int, y int")
    held = vector_tiles.meeting(before, 3, "m", ["id"], only=only)
    whole = vector_tiles.meeting(before, 3, "m", ["id"])
    assert 0 < held.count() == whole.where("x = 2 and y = 3").count() < whole.count()
    fresh = tile_cache.refreshed(tile_cache.build(before, [0, 3], "m", ["id"]), before, after, ["id"], [0, 3], "m", ["id"])
    assert "FullOuter" not in fresh._jdf.queryExecution().optimizedPlan().toString()
    tiles_in = lambda df: {(r["z"], r["x"], r["y"]): (r["n"], bytes(r["tile"])) for r in df.collect()}
    assert tiles_in(fresh) == tiles_in(tile_cache.build(after, [0, 3], "m", ["id"]))


def test_slices_hold_a_layer_in_order(spark):
    layers = vector_tiles.encode(shapes(spark), 0, "wkb", ["id", "name", "odd", "size"]).select(vector_tiles.layer_of(F.col("tile")).alias("layer"))
    row = layers.select(vector_tiles.features(F.col("layer")).alias("whole"), F.transform(vector_tiles.slices(F.col("layer"), 16), vector_tiles.features).alias("cut")).first()
    assert len(row["cut"]) > 10 and max(map(len, row["cut"])) == 16 and [f for part in row["cut"] for f in part] == row["whole"]


def test_large_tiles_of_a_cache_stand_in_pieces(spark, monkeypatch):
    """No row of a cache holds more than a bounded part of a tile, however many features meet there; the pieces merge to the tile."""
    from terrazzo.sources import tile_cache

    monkeypatch.setattr(vector_tiles, "PIECE", 40_000)
    before = spark.range(12_000, numPartitions=5).select("id", geo.call("st_point", F.col("id") * 3_000.0 - 1.8e7, F.lit(5e6)).alias("m"))
    after, zooms = before.where("id % 1000 != 7 or id > 6000"), [0, 4]
    built = tile_cache.build(after, zooms, "m", ["id"]).cache()
    held = built.select("z", "n", geo.call("st_tilecount", vector_tiles.layer_of(F.col("tile"))).alias("held"))
    assert held.where("z = 0").count() > 8 and held.where("z = 4 and n != held").count() == 0
    assert held.agg(F.max("held")).first()[0] < 2000 and held.where("z = 0").agg(F.sum("held"), F.max("n")).first()[:] == (after.count(), after.count())
    said = lambda df: {tuple(r[:-1]): bytes(r["tile"]) for r in df.collect()}
    assert said(tile_cache.build(after.repartition(3, "id"), zooms, "m", ["id"])) == said(built)
    assert said(tile_cache.refreshed(tile_cache.build(before, zooms, "m", ["id"]), before, after, ["id"], zooms, "m", ["id"])) == said(built)
    assert said(vector_tiles.whole(built)) == {k: v for z in zooms for k, v in said(vector_tiles.encode(after, z, "m", ["id"])).items()}


@pytest.mark.parametrize("properties", [["id"], ["name"], []])
def test_equal_features_stand_in_pieces_too(spark, monkeypatch, properties):
    """A spot with most of the features, all alike or not, swells no piece."""
    from terrazzo.sources import tile_cache

    monkeypatch.setattr(vector_tiles, "PIECE", 40_000)
    df = spark.range(9_000, numPartitions=5).select("id", F.lit("a").alias("name"), geo.call("st_point", F.when(F.col("id") % 5 == 0, F.col("id") * 9.0 + 2).otherwise(1.0), F.lit(1.0)).alias("m"))
    built = tile_cache.build(df, [2], "m", properties).cache()
    held = built.select("n", geo.call("st_tilecount", vector_tiles.layer_of(F.col("tile"))).alias("held")).agg(F.max("held"), F.sum("held"), F.min("n"), F.max("n")).first()
    assert held["max(held)"] < 2500 and tuple(held)[1:] == (9_000, 9_000, 9_000)
    (one,), (other,) = vector_tiles.whole(built).collect(), vector_tiles.encode(df, 2, "m", properties).collect()
    assert (one["n"], one["over"], bytes(one["tile"])) == (other["n"], other["over"], bytes(other["tile"]))
