"""Feature JSON of map services: geometries as x/y, points, paths, rings or an envelope; attributes by kind.

Rings that turn clockwise are outer rings, the others holes of the outer ring before them.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrazzo.functions import geometry as geo
from terrazzo.model import PlanError
from terrazzo.plans.dataset import quoted

# Field type names of the service protocol.
FIELD_TYPES = {
    T.BooleanType: "esriFieldTypeSmallInteger", T.ByteType: "esriFieldTypeSmallInteger", T.ShortType: "esriFieldTypeSmallInteger", T.IntegerType: "esriFieldTypeInteger", T.LongType: "esriFieldTypeBigInteger",
    T.FloatType: "esriFieldTypeSingle", T.DoubleType: "esriFieldTypeDouble", T.DecimalType: "esriFieldTypeDouble", T.StringType: "esriFieldTypeString",
    T.DateType: "esriFieldTypeDate", T.TimestampType: "esriFieldTypeDate", T.TimestampNTZType: "esriFieldTypeDate", T.BinaryType: "esriFieldTypeBlob", T.StructType: "esriFieldTypeGeometry",
}


def _layout(g: dict) -> int:
    """As in ISO WKB: 1 with z, 2 with m, 3 with both; flags say so, and the members of a point."""
    return (1 if g.get("hasZ") or "z" in g else 0) | (2 if g.get("hasM") or "m" in g else 0)


def _ordinates(p: list, layout: int) -> bytes:
    """x, y and the layout's other ordinates; what a position lacks, or says is no number, is unknown."""
    n = 2 + layout.bit_count()
    known = [math.nan if v is None or v == "NaN" else float(v) for v in p[:n]]
    return struct.pack(f">{n}d", *known, *[math.nan] * (n - len(known)))


def _path(points: list, layout: int) -> bytes:
    return struct.pack(">I", len(points)) + b"".join(_ordinates(p, layout) for p in points)


def _point(p: list, layout: int) -> bytes:
    return struct.pack(">bI", 0, 1 + 1000 * layout) + _ordinates(p, layout)


def _turn(ring: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def decode(g: dict) -> tuple[bytes, tuple[float, float, float, float], int]:
    """(WKB, envelope, dimension) of a geometry; z and m are kept."""
    try:
        if "xmin" in g:
            b = tuple(float(g[k]) for k in ("xmin", "ymin", "xmax", "ymax"))
            return geo.wkb_box(*b), b, 2
        layout = _layout(g)
        head = lambda kind, n: struct.pack(">bII", 0, kind + 1000 * layout, n)
        if "x" in g:
            x, y = float(g["x"]), float(g["y"])
            return _point([x, y, *[g.get(k) for k, bit in (("z", 1), ("m", 2)) if layout & bit]], layout), (x, y, x, y), 0
        if "points" in g:
            flat, dimension = g["points"], 0
            wkb = head(4, len(flat)) + b"".join(_point(p, layout) for p in flat)
        elif "paths" in g:
            flat, dimension = [p for path in g["paths"] for p in path], 1
            wkb = head(5, len(g["paths"])) + b"".join(struct.pack(">bI", 0, 2 + 1000 * layout) + _path(path, layout) for path in g["paths"])
        else:
            flat, dimension, parts = [p for ring in g["rings"] for p in ring], 2, []
            for ring in g["rings"]:
                ring = ring if ring[0] == ring[-1] else [*ring, ring[0]]
                if _turn(ring) <= 0 or not parts:
                    parts.append([ring])
                else:
                    parts[-1].append(ring)
            wkb = head(6, len(parts)) + b"".join(head(3, len(rings)) + b"".join(_path(r, layout) for r in rings) for rings in parts)
        xs, ys = [float(p[0]) for p in flat], [float(p[1]) for p in flat]
        return wkb, (min(xs), min(ys), max(xs), max(ys)), dimension
    except (KeyError, IndexError, TypeError, ValueError) as e:
        raise PlanError(f"geometry: {e}") from e


def attribute(c: Column, kind: T.DataType) -> Column:
    """A value as the service writes it: instants are epoch milliseconds, truth is 1 or 0."""
    if isinstance(kind, T.TimestampType):
        return F.unix_millis(c)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long") * 86_400_000
    if isinstance(kind, T.TimestampNTZType):  # wall time is taken as UTC, whatever the session's zone
        days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        return days * 86_400_000 + F.hour(c).cast("long") * 3_600_000 + F.minute(c).cast("long") * 60_000 + F.floor(F.extract(F.lit("SECOND"), c) * 1000).cast("long")
    return c.cast("int") if isinstance(kind, T.BooleanType) else c


def features(df: DataFrame, geometry: str | None = None, wkid: int | None = None) -> DataFrame:
    """A feature a row, as text: attributes, nulls included, and the geometry in the system ``wkid``."""
    geo.register(df.sparkSession)
    names = [f for f in df.schema.fields if f.name != geometry]
    attributes = F.to_json(F.struct(*[attribute(F.col(quoted(f.name)), f.dataType).alias(f.name) for f in names]), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    parts = [F.lit('{"attributes":'), attributes]
    if geometry:
        reference = f',"spatialReference":{{"wkid":{wkid}}}}}' if wkid else "}"
        shape = geo.call("st_asfeaturejson", F.col(quoted(geometry))["wkb"])
        parts += [F.lit(',"geometry":'), F.coalesce(F.concat(F.substring(shape, F.lit(1), F.length(shape) - 1), F.lit(reference)), F.lit("null"))]
    return df.select(F.concat(*parts, F.lit("}")).alias("feature"))


def fields(df: DataFrame, object_id: str | None = None) -> list[dict]:
    """The field list of a layer: name, protocol type, nullability."""
    return [{"name": f.name, "type": "esriFieldTypeOID" if f.name == object_id else FIELD_TYPES.get(type(f.dataType), "esriFieldTypeString"), "nullable": f.nullable} for f in df.schema.fields]
