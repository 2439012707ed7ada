"""Z and M through readers, writers, transforms and topology; absent and unknown ordinates."""

import json
import math

import pytest
from pyspark.sql import functions as F

from terrazzo.functions import crs, featurejson
from terrazzo.functions import geometry as geo
from terrazzo.model import PlanError
from terrazzo.operators import served
from terrazzo.plans.dataset import Dataset
from terrazzo.sources import ingest

TEXTS = {
    "XY": "LINESTRING (1 2, 4 6)",
    "XYZ": "LINESTRING Z(1 2 3, 4 6 5)",
    "XYM": "LINESTRING M(1 2 3, 4 6 5)",
    "XYZM": "LINESTRING ZM(1 2 3 4, 4 6 5 6)",
}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def wkt(text):
    return geo.call("st_fromtext", F.lit(text))


def text(c):
    return geo.call("st_astext", c)


@pytest.mark.parametrize("layout", TEXTS)
def test_layouts_survive(spark, layout):
    g = wkt(TEXTS[layout])
    zs, ms = geo.call("st_zs", g), geo.call("st_ms", g)
    row = one(spark, text(g), geo.call("st_layout", g), zs, ms, geo.call("st_ordinates", g), text(geo.call("st_round", g, F.lit(1))), text(geo.call("st_snap", g, F.lit(0.0), F.lit(0.0), F.lit(1.0))), text(geo.call("st_parts", g)[0]), text(geo.call("st_generalize", g, F.lit(0.1))))
    assert row[0] == TEXTS[layout] and row[1] == layout and row[4] == [1.0, 2.0, 4.0, 6.0] and set(row[5:]) == {TEXTS[layout]}
    assert (row[2] is not None) == ("Z" in layout) and (row[3] is not None) == ("M" in layout)
    moved = crs.transform_geometry(g, 4326, 3857)
    back = one(spark, geo.call("st_layout", moved), geo.call("st_zs", moved), geo.call("st_ms", moved))
    assert back[0] == layout and back[1] == row[2] and back[2] == row[3]
    little = one(spark, g)[0]
    assert int.from_bytes(little[1:5], "big") == 2 + 1000 * list(TEXTS).index(layout)


@pytest.mark.parametrize("layout", TEXTS)
def test_densify_runs_evenly(spark, layout):
    dense = geo.call("st_densify", wkt(TEXTS[layout]), F.lit(1.0))
    ordinates, zs, ms = one(spark, geo.call("st_ordinates", dense), geo.call("st_zs", dense), geo.call("st_ms", dense))
    assert ordinates == pytest.approx([v for k in range(6) for v in (1 + 0.6 * k, 2 + 0.8 * k)])
    assert (zs or []) == pytest.approx([3 + 0.4 * k for k in range(6)] if "Z" in layout else [])
    assert (ms or []) == pytest.approx([({"XYM": 3, "XYZM": 4}[layout]) + 0.4 * k for k in range(6)] if "M" in layout else [])


def test_other_encodings_are_read(spark):
    """Flags in the type's upper bits, as other writers set them, and the other byte order."""
    import struct

    for order in "<>":
        raw = struct.pack(f"{order}BIdddd", order == "<", 0x80000001 | 0x40000000, 1.0, 2.0, 3.0, 4.0)
        g = F.lit(raw)
        assert tuple(one(spark, geo.call("st_layout", g), geo.call("st_zs", g)[0], geo.call("st_ms", g)[0], text(g))) == ("XYZM", 3.0, 4.0, "POINT ZM(1 2 3 4)")


def test_absent_is_not_unknown(spark):
    g = wkt(TEXTS["XY"])
    unknown = geo.call("st_withlayout", g, F.lit("XYZ"))
    row = one(spark, geo.call("st_zs", g), geo.call("st_zs", unknown), geo.call("st_layout", unknown), geo.call("st_asgeojson", unknown), geo.call("st_asfeaturejson", unknown), geo.call("st_asfeaturejson", g))
    assert row[0] is None and all(map(math.isnan, row[1])) and row[2] == "XYZ" and "null" not in row[3]
    assert json.loads(row[4]) == {"hasZ": True, "paths": [[[1, 2, None], [4, 6, None]]]} and json.loads(row[5]) == {"paths": [[[1, 2], [4, 6]]]}
    kept = [geo.call("st_layout", geo.call("st_keep", wkt(t), F.lit(z), F.lit(m))) for t in TEXTS.values() for z in (False, True) for m in (False, True)]
    assert list(one(spark, *kept)) == ["XY"] * 4 + ["XY", "XY", "XYZ", "XYZ"] + ["XY", "XYM"] * 2 + ["XY", "XYM", "XYZ", "XYZM"]
    with pytest.raises(Exception, match="unknown layout"):
        one(spark, geo.call("st_withlayout", g, F.lit("ZYX")))
    points = [geo.call("st_pointzm", *[F.lit(v).cast("double") for v in at]) for at in ((1, 2, 3, 4), (1, 2, None, 4), (1, 2, None, None), (None, 2, 3, 4))]
    assert list(one(spark, *map(text, points))) == ["POINT ZM(1 2 3 4)", "POINT M(1 2 4)", "POINT (1 2)", None]


def test_overlays_have_heights_between(spark):
    line, box = wkt("LINESTRING Z(0 0 0, 10 0 10)"), wkt("POLYGON((2 -1, 6 -1, 6 1, 2 1, 2 -1))")
    cut = geo.call("st_intersection", line, box)
    row = one(spark, geo.call("st_layout", cut), geo.call("st_zs", cut), geo.call("st_layout", geo.call("st_intersection", wkt("LINESTRING M(0 0 0, 10 0 10)"), box)))
    assert row[0] == "XYZ" and sorted(row[1]) == pytest.approx([2.0, 6.0]) and row[2] == "XY"
    joined = geo.call("st_union_all", F.array(wkt("POINT Z(1 1 5)"), wkt("POINT(2 2)")))
    assert one(spark, geo.call("st_layout", joined))[0] == "XYZ"


def test_through_files(spark, tmp_path):
    shapes = [{"type": "Point", "coordinates": [1, 2, 3]}, {"type": "LineString", "coordinates": [[0, 0, 1], [1, 1]]}, {"type": "Point", "coordinates": [1, 2]}, {"type": "Point", "coordinates": [1, 2, 3, 4]}]
    lines = [json.dumps({"type": "Feature", "id": str(k), "geometry": g, "properties": {}}) for k, g in enumerate(shapes)]
    (tmp_path / "z.ndjson").write_text("\n".join(lines))
    read = ingest.read_ndjson(spark, f"file://{tmp_path}/z.ndjson")
    rows = {r["feature_id"]: r for r in read.select("feature_id", geo.call("st_layout", F.col("geometry.wkb")).alias("layout"), geo.call("st_zs", F.col("geometry.wkb")).alias("zs")).collect()}
    assert [rows[str(k)]["layout"] for k in range(4)] == ["XYZ", "XYZ", "XY", "XYZ"]
    assert rows["1"]["zs"][0] == 1.0 and math.isnan(rows["1"]["zs"][1])
    out = {json.loads(r[0])["id"]: json.loads(r[0])["geometry"] for r in ingest.to_geojson(read, "feature_id", "geometry").collect()}
    assert out["0"] == shapes[0] and out["1"] == shapes[1] and out["2"] == shapes[2] and out["3"]["coordinates"] == [1, 2, 3]


def test_feature_json_both_ways(spark):
    for layout, said in TEXTS.items():
        body = one(spark, geo.call("st_asfeaturejson", wkt(said)))[0]
        wkb, env, dimension = featurejson.decode(json.loads(body))
        assert env == (1, 2, 4, 6) and dimension == 1 and one(spark, geo.call("st_layout", F.lit(wkb)))[0] == layout
        assert one(spark, text(geo.call("st_parts", F.lit(wkb))[0]))[0] == said
    wkb, _, _ = featurejson.decode({"hasZ": True, "rings": [[[0, 0, 1], [0, 4, 2], [4, 4, None], [4, 0, 4]]]})
    assert one(spark, geo.call("st_zs", F.lit(wkb)))[0][:2] == [1.0, 2.0]
    wkb, _, _ = featurejson.decode({"x": 1, "y": 2, "m": "NaN"})
    assert one(spark, geo.call("st_layout", F.lit(wkb)))[0] == "XYM"
    for bad in ({"hasZ": True, "paths": [[[1, 2, "high"]]]}, {"x": None, "y": 1}):
        with pytest.raises(PlanError):
            featurejson.decode(bad)


def test_served_ordinates(spark):
    df = spark.createDataFrame([(1, TEXTS["XYZM"])], "id int, t string").select("id", geo.encode(geo.call("st_fromtext", F.col("t"))).alias("g"))
    ds = Dataset(df, ("id",), ("id",), "lines")
    said = lambda **p: served.serve(ds, {"outSR": "3857", **p}).select(geo.call("st_layout", F.col("g.wkb"))).first()[0]
    assert [said(), said(returnZ="false"), said(returnM="false"), said(returnZ="false", returnM="false"), said(returnZ="true")] == ["XYZM", "XYM", "XYZ", "XY", "XYZM"]
