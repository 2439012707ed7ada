"""A remote feature service as a data source (``format("terrazzo_remote")``): a partition a page, filters as its ``where``.

Options: url (the layer), where (restricts further), page (rows a request).  The
layer's JSON description gives the schema, a geometry column included where the layer
has one; a count request plans the pages, which are ordered by the object id so that they
fit together.  Comparisons on attributes are pushed as filter text, bounds on the
geometry's envelope as a box; what has no text stays with Spark.  With ``geometry`` false
the geometry is neither asked for nor a column.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from terrazzo.functions import featurejson
from terrazzo.functions.geometry import SPARK_TYPE
from terrazzo.model import PlanError
from terrazzo.plans.parse import KEYWORDS

# Field type names of the service protocol.
TYPES = {"OID": LongType(), "Integer": LongType(), "SmallInteger": LongType(), "BigInteger": LongType(), "Single": DoubleType(), "Double": DoubleType(), "Date": LongType(), "Boolean": BooleanType()}
_OPS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
TIMEOUT = 60
#: The column of a layer's geometry.
GEOMETRY = "geometry"


def _get(url: str, **query) -> dict:
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode({**query, 'f': 'json'})}", timeout=TIMEOUT) as answer:
        body = json.load(answer)
    if "error" in body:
        raise PlanError(f"{url}: {body['error']}", "store.unavailable")
    return body


def _said(value) -> str | None:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else None


def _name(name: str) -> str:
    return name if name.isidentifier() and name.upper() not in KEYWORDS else '"' + name.replace('"', '""') + '"'


def text_of(f) -> str | None:
    """A pushed filter as text, or None."""
    if len(getattr(f, "attribute", ())) != 1:
        return None
    name = _name(f.attribute[0])
    if type(f) in _OPS and (v := _said(f.value)) is not None:
        return f"{name} {_OPS[type(f)]} {v}"
    if isinstance(f, In) and f.value and None not in (values := [_said(v) for v in f.value]):
        return f"{name} IN ({', '.join(values)})"
    if isinstance(f, (IsNull, IsNotNull)):
        return f"{name} IS {'NOT ' * isinstance(f, IsNotNull)}NULL"
    return None


class _Pages(InputPartition):
    def __init__(self, start: int, size: int):
        self.start, self.size = start, size


#: Which side of the box a bound on the envelope gives: features left of a box's right side have a smaller minx.
_SIDES = {(LessThanOrEqual, "minx"): "xmax", (GreaterThanOrEqual, "maxx"): "xmin", (LessThanOrEqual, "miny"): "ymax", (GreaterThanOrEqual, "maxy"): "ymin"}


class RemoteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.url, self.page, self.names = options["url"].rstrip("/"), int(options.get("page", 1000)), [f.name for f in schema.fields]
        self.geometry = GEOMETRY if any(f.name == GEOMETRY and isinstance(f.dataType, StructType) for f in schema.fields) else None
        self.object_id = options.get("objectid")
        self.ordinates = {f"return{n}": "true" for n in options.get("ordinates", "")}
        self.where = [options["where"]] if options.get("where") else []
        self.box: dict[str, float] = {}

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            path = getattr(f, "attribute", ())
            if len(path) == 3 and path[:2] == (self.geometry, "env"):
                side = _SIDES.get((type(f), path[2]))
                if side:
                    self.box[side] = float(f.value)
                yield f  # the service may answer with more; Spark looks again
                continue
            text = text_of(f) if path != (self.geometry,) else None
            if text is not None:
                self.where.append(text)
            yield f  # a service may fold case, or know another order of texts; Spark looks again

    @property
    def query(self) -> dict:
        out = {"where": " AND ".join(f"({w})" for w in self.where) or "1=1"}
        if len(self.box) == 4:
            out |= {"geometry": ",".join(repr(self.box[k]) for k in ("xmin", "ymin", "xmax", "ymax")), "geometryType": "esriGeometryEnvelope", "spatialRel": "esriSpatialRelEnvelopeIntersects"}
        return out

    def partitions(self) -> Sequence[InputPartition]:
        total = int(_get(f"{self.url}/query", **self.query, returnCountOnly="true")["count"])
        if not self.object_id:  # pages without an order may overlap, or leave rows out
            return [_Pages(0, total)]
        return [_Pages(at, min(self.page, total - at)) for at in range(0, total, self.page)] or [_Pages(0, 0)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        at, end = partition.start, partition.start + partition.size
        attributes = [n for n in self.names if n != self.geometry]
        order = {"orderByFields": self.object_id} if self.object_id else {}
        while at < end:  # a service may answer with fewer rows than asked for
            body = _get(f"{self.url}/query", **self.query, **order, outFields=",".join(attributes) or self.object_id or "*", resultOffset=at, resultRecordCount=end - at, returnGeometry=str(self.geometry is not None).lower(), **self.ordinates)
            rows = body.get("features", [])
            if not rows:
                return
            for row in rows:
                values = row["attributes"]
                yield tuple(_shape(row.get("geometry")) if n == self.geometry else values.get(n) for n in self.names)
            at += len(rows)
            if at < end and not self.object_id:
                raise ValueError(f"{self.url} has no object id, and more rows than one answer")


def _shape(g: dict | None) -> dict | None:
    """A geometry column's value; what is empty has no envelope and is null."""
    if not g or all(not g.get(k) for k in ("rings", "paths", "points")) and g.get("x") in (None, "NaN") and "xmin" not in g:
        return None
    wkb, env, _ = featurejson.decode(g)
    return {"wkb": wkb, "env": dict(zip(("minx", "miny", "maxx", "maxy"), env, strict=True))}


class RemoteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terrazzo_remote"

    def schema(self) -> StructType:
        return _schema(_get(self.options["url"].rstrip("/")), self.options.get("geometry", "true") == "true")

    def reader(self, schema: StructType) -> DataSourceReader:
        return RemoteReader(dict(self.options), schema)


def _schema(layer: dict, geometry: bool = True) -> StructType:
    fields = [StructField(f["name"], TYPES.get(f["type"].removeprefix("esriFieldType"), StringType())) for f in layer["fields"] if not f["type"].endswith("Geometry")]
    if geometry and layer.get("geometryType"):
        fields.append(StructField(GEOMETRY, SPARK_TYPE))
    return StructType(fields)


def read(spark: SparkSession, url: str, where: str | None = None, page: int = 1000, geometry: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RemoteSource)
    layer = _get(url.rstrip("/"))
    object_id = layer.get("objectIdField") or next((f["name"] for f in layer["fields"] if f["type"] == "esriFieldTypeOID"), None)
    reader = spark.read.format("terrazzo_remote").option("url", url).option("page", str(page)).option("geometry", str(geometry).lower())
    reader = reader.option("ordinates", "".join(n for n in "ZM" if layer.get(f"has{n}")))
    reader = reader.option("objectid", object_id) if object_id else reader
    return (reader.option("where", where) if where else reader).load()
