"""The remote source against a local server, and datasets by name."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from terrazzo.functions import featurejson
from terrazzo.functions import geometry as geo
from terrazzo.model import Box, FeatureQuery, PlanError
from terrazzo.operators import edits
from terrazzo.plans import execute
from terrazzo.plans.dataset import Dataset
from terrazzo.plans.parse import parse_filter
from terrazzo.sources import catalog, remote

ROWS = [{"id": k, "name": f"n{k % 3}", "size": k * 1.5} for k in range(25)]
ASKED: list[dict] = []


class Service(BaseHTTPRequestHandler):
    def do_GET(self):
        path, _, query = self.path.partition("?")
        q = {k: v[0] for k, v in urllib.parse.parse_qs(query).items()}
        if not path.endswith("/query"):
            body = {"fields": [{"name": "id", "type": "esriFieldTypeOID"}, {"name": "name", "type": "esriFieldTypeString"}, {"name": "size", "type": "esriFieldTypeDouble"}, {"name": "g", "type": "esriFieldTypeGeometry"}]}
        else:
            ASKED.append(q)
            rows = [r for r in ROWS if "'n1'" not in q["where"] or r["name"] == "n1"]
            at = int(q.get("resultOffset", 0))
            size = min(4, int(q.get("resultRecordCount", 4)))  # fewer than asked for
            body = {"count": len(rows)} if "returnCountOnly" in q else {"features": [{"attributes": r} for r in rows[at : at + size]]}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


def test_remote(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/layer/0"
    df = remote.read(spark, url, page=10)
    assert df.rdd.getNumPartitions() == 3 and sorted(r["id"] for r in df.collect()) == list(range(25))
    ASKED.clear()
    assert df.where("name = 'n1' and size + 1 > 20").count() == sum(r["name"] == "n1" and r["size"] + 1 > 20 for r in ROWS)
    assert any("name = 'n1'" in q["where"] for q in ASKED)
    server.shutdown()


class Shapes(BaseHTTPRequestHandler):
    """Polygons along a line, pages of seven at most; geometry and a box where they are asked for."""

    def do_GET(self):
        path, _, query = self.path.partition("?")
        q = {k: v[0] for k, v in urllib.parse.parse_qs(query).items()}
        if not path.endswith("/query"):
            body = {"geometryType": "esriGeometryPolygon", "objectIdField": "id", "fields": [{"name": "id", "type": "esriFieldTypeOID"}, {"name": "shape", "type": "esriFieldTypeGeometry"}]}
        else:
            ASKED.append(q)
            rows = list(range(40))
            if "geometry" in q:
                x0, _, x1, _ = map(float, q["geometry"].split(","))
                rows = [k for k in rows if k <= x1 and k + 1 >= x0]
            at, size = int(q.get("resultOffset", 0)), min(7, int(q.get("resultRecordCount", 7)))
            rings = lambda k: [[[k, 0], [k, 2], [k + 1, 2], [k + 1, 0], [k, 0]]] if k % 5 else []
            found = [{"attributes": {"id": k}, **({"geometry": {"rings": rings(k)}} if q.get("returnGeometry") == "true" else {})} for k in rows[at : at + size]]
            body = {"count": len(rows)} if "returnCountOnly" in q else {"features": found}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


def test_remote_geometry(spark):
    server = HTTPServer(("127.0.0.1", 0), Shapes)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/layer/0"
    ds = Dataset(remote.read(spark, url, page=20), ("id",), ("id",))
    rows = {r["id"]: r for r in ds.df.select("id", "geometry.env", geo.call("st_area", F.col("geometry.wkb")).alias("area")).collect()}
    assert len(rows) == 40 and rows[5]["area"] is None and rows[6]["area"] == 2 and tuple(rows[6]["env"]) == (6, 0, 7, 2)
    assert ASKED[-1]["orderByFields"] == "id"
    ASKED.clear()
    found = execute.select(ds, FeatureQuery(box=Box(10.5, 0, 13.5, 1))).df
    assert sorted(r["id"] for r in found.collect()) == [11, 12, 13]
    assert ASKED and all(q["geometry"] == "10.5,0.0,13.5,1.0" for q in ASKED)
    assert remote.read(spark, url, geometry=False).columns == ["id"]
    server.shutdown()


def test_transaction_over_a_store(spark):
    store = catalog.Store(spark)
    for name in ("terrazzo_test_a", "terrazzo_test_b"):
        store.drop(name)
        store.create(name, spark.range(3).toDF("id"))
    t = edits.Transaction(store)
    ds = store.dataset("terrazzo_test_a", ("id",))
    t.stage("terrazzo_test_a", edits.delete_where(ds, parse_filter("id = 1")))
    t.rollback()
    assert store.scan("terrazzo_test_a").count() == 3 and len(store.names("terrazzo_test_*")) == 2
    t.stage("terrazzo_test_a", ds.df)
    t.stage("terrazzo_test_a", edits.delete_where(ds, parse_filter("id = 1")))  # reads what it will replace
    t.stage("terrazzo_test_b", spark.range(9).toDF("id"))
    assert store.scan("terrazzo_test_b").count() == 3
    t.commit()
    assert sorted(r["id"] for r in store.scan("terrazzo_test_a").collect()) == [0, 2] and store.scan("terrazzo_test_b").count() == 9
    assert store.names("terrazzo_test_*") == ["terrazzo_test_a", "terrazzo_test_b"]
    for name in ("terrazzo_test_a", "terrazzo_test_b"):
        store.drop(name)


def test_feature_json(spark):
    df = spark.createDataFrame([(1, "a\"b", True), (2, None, None)], "id int, s string, flag boolean")
    df = df.withColumns({"seen": F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:01.5'"), "at": F.expr("TIMESTAMP '2024-01-01 00:00:00+00:00'"), "day": F.expr("DATE '1970-01-02'")})
    shapes = {
        "POINT(1 2)": {"x": 1, "y": 2},
        "MULTIPOINT((1 2),(3 4.5))": {"points": [[1, 2], [3, 4.5]]},
        "LINESTRING(0 0,1 1)": {"paths": [[[0, 0], [1, 1]]]},
        "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,1 2,2 2,1 1))": {"rings": [[[0, 0], [0, 4], [4, 4], [4, 0], [0, 0]], [[1, 1], [2, 2], [1, 2], [1, 1]]]},
    }
    for text, shape in shapes.items():
        at = df.withColumn("g", F.when(F.col("id") == 1, geo.encode(geo.call("st_fromtext", F.lit(text)))))
        first, second = (json.loads(r[0]) for r in featurejson.features(at, "g", 4326).orderBy("feature").collect())
        assert first == {"attributes": {"id": 1, "s": 'a"b', "flag": 1, "seen": 1704067201500, "at": 1704067200000, "day": 86400000}, "geometry": {**shape, "spatialReference": {"wkid": 4326}}}
        assert second["geometry"] is None and second["attributes"]["s"] is None
        wkb, env, dimension = featurejson.decode(shape)
        back = spark.range(1).select(geo.call("st_distance", F.lit(wkb), geo.call("st_fromtext", F.lit(text))), geo.call("st_area", F.lit(wkb))).first()
        assert back[0] == 0 and env[0] <= 1 and dimension == {"x": 0, "points": 0, "paths": 1, "rings": 2}[next(iter(shape))]
    assert {f["name"]: f["type"] for f in featurejson.fields(df, "id")}["id"] == "esriFieldTypeOID"


def test_store(spark):
    store = catalog.Store(spark)
    name = "terrazzo_test_places"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows = spark.range(3).select("id", F.lit("x").alias("s"))
    store.create(name, rows)
    assert name in store.names("terrazzo_test*") and store.describe(name).fields[1][0] == "s"
    store.append(name, rows.withColumn("more", F.lit(1)))
    assert store.dataset(name, ("id",)).df.count() == 6
    for bad in (lambda: store.create(name, rows), lambda: store.append(name, rows.select("s"))):
        with pytest.raises(PlanError):
            bad()
    spark.sql(f"DROP TABLE {name}")
