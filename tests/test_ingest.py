"""Files in and out: nothing is lost, what is no feature is named."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from terrazzo.functions import geometry as geo
from terrazzo.model import PlanError
from terrazzo.sources import catalog, ingest
from terrazzo.streaming import ingest as streaming

SHAPES = {
    "Point": [1, 2],
    "LineString": [[0, 0], [1.5, 1]],
    "Polygon": [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 0.5], [2, 0.5], [2, 1], [1, 0.5]]],
    "MultiPoint": [[0, 0], [1, 1]],
    "MultiLineString": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]],
    "MultiPolygon": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]],
}


def feature(k, geometry=None, **properties):
    return {"type": "Feature", "id": str(k), "geometry": geometry or {"type": "Point", "coordinates": [k, k + 0.5]}, "properties": properties}


def lines(path, *records):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))
    return str(path)


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('# a note\n# crs=EPSG:4326\n\nname,lon,lat,n,f,flag,mix,none\n"a, b",1.5,2,1,1,true,1,\n"q""q",,,2,2.5,false,x,\n"two\nlines",3,4,,3,true,2.5,\n#1 store,5,6,7,8,true,0123,\n')
    df = ingest.read_csv(spark, str(path))
    assert {n: t for n, t in df.dtypes if n != "geometry"} == {"feature_id": "string", "name": "string", "n": "bigint", "f": "double", "flag": "boolean", "mix": "string", "none": "string"}
    rows = df.orderBy("feature_id").collect()
    assert [r["name"] for r in rows] == ["a, b", 'q"q', "two\nlines", "#1 store"] and [r["feature_id"] for r in rows] == ["1", "2", "3", "4"]
    assert rows[1]["geometry"] is None and rows[0]["geometry"]["env"]["minx"] == 1.5 and rows[3]["mix"] == "0123"
    with pytest.raises(PlanError):
        ingest.read_csv(spark, str(path), crs="EPSG:3857")
    with pytest.raises(PlanError):
        ingest.capped(df, 2)


def test_csv_without_preamble_splits_and_keeps_large_integers(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,x,y,big\n" + "\n".join(f"k{k},{k},1,{1234567890123456789 + k}" for k in range(50)))
    df = ingest.read_csv(spark, str(path), identity="id")
    assert dict(df.dtypes)["big"] == "bigint" and df.agg(F.max("big")).first()[0] == 1234567890123456838
    assert {r["feature_id"] for r in df.collect()} == {f"k{k}" for k in range(50)}


def test_csv_records_that_are_no_features(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,x,y\n1,2,3\n2,5\n3,east,1\n4,,\n5,6,7,8\n")
    decoded = ingest.decode_csv(spark, str(path), skip_malformed=True)
    assert sorted(r["a"] for r in decoded.features.collect()) == [1, 4] and decoded.features.count() == 2
    assert sorted((r["reason"], r["detail"]) for r in decoded.skipped.collect()) == [("GeometryInvalid", "east, 1"), ("RecordMalformed", "2,5"), ("RecordMalformed", "5,6,7,8")]
    with pytest.raises(PySparkException, match="RecordMalformed"):
        ingest.read_csv(spark, str(path)).collect()
    (tmp_path / "empty.csv").write_text("# only a note\n")
    with pytest.raises(PlanError):
        ingest.read_csv(spark, str(tmp_path / "empty.csv"))


@pytest.mark.parametrize("kind", [*SHAPES, "GeometryCollection"])
def test_every_shape_in_and_out(spark, tmp_path, kind):
    shape = {"type": kind, "coordinates": SHAPES.get(kind)} if kind in SHAPES else {"type": kind, "geometries": [{"type": k, "coordinates": c} for k, c in SHAPES.items()]}
    df = ingest.read_ndjson(spark, lines(tmp_path / "t.json", feature(1, shape, n=1)))
    assert json.loads(ingest.to_geojson(df, "feature_id", "geometry").first()[0]) == feature(1, shape, n=1)


def test_json_kinds(spark, tmp_path):
    values = {"z": "01234", "a": "true", "big": 1234567890123456789, "f": 1.0, "wide": 1, "o": {"k": [1]}, "flag": True, "null": None, "mix": 1}
    path = lines(tmp_path / "t.json", feature(1, **values), feature(2, wide=2.5, mix="x", flag=False))
    df = ingest.read_ndjson(spark, path)
    kinds = {"z": "string", "a": "string", "big": "bigint", "f": "double", "wide": "double", "o": "string", "flag": "boolean", "null": "string", "mix": "string"}
    assert [n for n, _ in df.dtypes] == ["feature_id", *kinds, "geometry"] and {n: t for n, t in df.dtypes if n in kinds} == kinds
    row = df.where("feature_id = '1'").first()
    assert (row["z"], row["a"], row["big"], row["f"], row["wide"], row["o"], row["flag"], row["null"], row["mix"]) == ("01234", "true", 1234567890123456789, 1.0, 1.0, '{"k":[1]}', True, None, "1")


def test_json_records_that_are_no_features(spark, tmp_path):
    bad_ring = {"type": "Polygon", "coordinates": [[[0, 0], [1, 1]]]}
    odd = {**feature(6, n=6), "crs": {"type": "name", "properties": {"name": "EPSG:3857"}}}
    records = (feature(1, n=1), "not json", {**feature(2), "properties": 5}, feature(3, bad_ring), {**feature(4), "geometry": None}, {"type": "Sheep"}, odd, {**feature(7), "id": None})
    decoded = ingest.decode_ndjson(spark, lines(tmp_path / "t.json", *records), skip_malformed=True)
    got = {r["feature_id"]: r["geometry"] for r in decoded.features.collect()}
    assert set(got) == {"1", "4", "3"} and got["4"] is None  # the one without an id is the third feature
    assert sorted(r["reason"] for r in decoded.skipped.collect()) == ["CrsConflict", "GeometryInvalid", "RecordMalformed", "RecordMalformed", "RecordMalformed"]
    with pytest.raises(PySparkException):
        ingest.read_ndjson(spark, str(tmp_path / "t.json")).collect()


def test_collection(spark, tmp_path):
    crs = {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}
    path = lines(tmp_path / "t.json", {"type": "FeatureCollection", "crs": crs, "features": [feature(1, n=1, s="x"), feature(2, n=2.5, s=None), 5]})
    decoded = ingest.decode_geojson(spark, path, skip_malformed=True)
    rows = decoded.features.orderBy("feature_id").collect()
    assert dict(decoded.features.dtypes)["n"] == "double" and rows[1]["s"] is None and rows[1]["geometry"]["env"]["miny"] == 2.5
    assert [r["reason"] for r in decoded.skipped.collect()] == ["RecordMalformed"]
    one = ingest.read_geojson(spark, lines(tmp_path / "one.json", {**feature(9), "properties": {"feature_id": "own", "geometry": "word"}}))
    assert one.columns == ["feature_id_", "feature_id", "geometry", "geometry_"] and one.first()["feature_id_"] == "9"


def test_writer_keeps_nulls_and_quotes(spark):
    geo.register(spark)
    df = spark.createDataFrame([("a\"b", None, 'x "y"', 1.5)], "id string, missing long, text string, value double").withColumn("shape", geo.point(F.lit(None), F.lit(1)))
    assert json.loads(ingest.to_geojson(df, "id", "shape").first()[0]) == {"type": "Feature", "id": 'a"b', "geometry": None, "properties": {"missing": None, "text": 'x "y"', "value": 1.5}}
    assert json.loads(ingest.to_geojson(df.select("id", "shape"), "id", "shape").first()[0])["properties"] == {}


def test_load(spark, tmp_path):
    name = "terrazzo_test_loaded"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    store = catalog.Store(spark)
    decoded = ingest.decode_ndjson(spark, lines(tmp_path / "t.json", feature(0, n=1), feature(9, n=2), "junk"), skip_malformed=True)
    with pytest.raises(PlanError):
        store.load(name, decoded, most=1)
    assert store.load(name, decoded, most=2, target=3857).count() == 1
    assert sorted(round(r[0]) for r in store.scan(name).select("geometry.env.minx").collect()) == [0, 1001875]
    spark.sql(f"DROP TABLE {name}")


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines(folder / "a.json", *(feature(k, n=k) for k in range(3)))
    kinds = streaming.infer(spark, str(folder))
    lines(folder / "b.json", feature(9, n=1, surprise=True), "junk", feature(10, {"type": "Polygon", "coordinates": SHAPES["Polygon"]}, n=4))
    query = streaming.stream(spark, str(folder), kinds).writeStream.format("memory").queryName("features").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert kinds == {"n": "long"}
    kept = streaming.accepted(spark.table("features"))
    assert kept.count() == 4 and kept.where("feature_id = '10'").select(geo.call("st_area", F.col("geometry.wkb"))).first()[0] == pytest.approx(7.75)
    assert sorted(tuple(r) for r in streaming.rejected(spark.table("features")).select("reason").collect()) == [("FieldNotInferred",), ("RecordMalformed",)]


def test_crs_names():
    for name in ("EPSG:4326", "urn:ogc:def:crs:EPSG::4326", "http://www.opengis.net/def/crs/EPSG/0/4326", "urn:ogc:def:crs:OGC:1.3:CRS84"):
        assert ingest.crs_name(name) == "EPSG:4326"
    with pytest.raises(PlanError):
        ingest.crs_name("nonsense")
