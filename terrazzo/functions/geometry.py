"""Geometry: the column encoding, native measures, and topology through JTS.

A geometry is ``struct<wkb:binary, env:struct<minx,miny,maxx,maxy:double>>``; env is
null when the geometry is empty.  Box tests read only env, so a scan prunes by
Parquet statistics and never decodes WKB.  Topology and WKB run in the JVM, in the
functions that ``register`` adds to a session.
"""

from __future__ import annotations

import struct
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrazzo.session import drop, written

JAR = Path(__file__).parent / "jts" / "terrazzo-geometry.jar"
TYPE = "struct<wkb:binary,env:struct<minx:double,miny:double,maxx:double,maxy:double>>"

#: The same type without a session, for data sources in workers.
SPARK_TYPE = T.StructType([T.StructField("wkb", T.BinaryType()), T.StructField("env", T.StructType([T.StructField(n, T.DoubleType()) for n in ("minx", "miny", "maxx", "maxy")]))])

#: SQL name, class (of Functions, unless it says otherwise), result type.
FUNCTIONS = (
    ("st_area", "Area", "double"),
    ("st_length", "Length", "double"),
    ("st_distance", "Distance", "double"),
    ("st_relate", "Relate", "string"),
    ("st_matches", "Matches", "boolean"),
    ("st_related", "Related", "boolean"),
    ("st_isvalid", "Valid", "boolean"),
    ("st_buffer", "Buffer", "binary"),
    ("st_geodesicbuffer", "GeodesicBuffer", "binary"),
    ("st_reproject", "Reproject", "binary"),
    ("st_moved", "Moved", "array<double>"),
    ("st_round", "Round", "binary"),
    ("st_snap", "Snap", "binary"),
    ("st_intersection", "Intersection", "binary"),
    ("st_difference", "Difference", "binary"),
    ("st_union_all", "UnionAll", "binary"),
    ("st_hull_all", "HullAll", "binary"),
    ("st_makevalid", "Repair", "binary"),
    ("st_densify", "Densify", "binary"),
    ("st_simplify", "Simplify", "binary"),
    ("st_generalize", "Generalize", "binary"),
    ("st_labelpoint", "LabelPoint", "binary"),
    ("st_centroid", "Centroid", "binary"),
    ("st_point", "MakePoint", "binary"),
    ("st_box", "MakeBox", "binary"),
    ("st_fromtext", "FromText", "binary"),
    ("st_astext", "AsText", "string"),
    ("st_fromgeojson", "FromGeoJson", "binary"),
    ("st_asgeojson", "AsGeoJson", "string"),
    ("st_asfeaturejson", "AsFeatureJson", "string"),
    ("st_bounds", "Bounds", "array<double>"),
    ("st_parts", "Parts", "array<binary>"),
    ("st_ordinates", "Ordinates", "array<double>"),
    ("st_layout", "Layout$Name", "string"),
    ("st_withlayout", "Layout$With", "binary"),
    ("st_keep", "Layout$Keep", "binary"),
    ("st_zs", "Layout$Zs", "array<double>"),
    ("st_ms", "Layout$Ms", "array<double>"),
    ("st_pointzm", "Layout$MakePoint", "binary"),
    ("st_gridshift", "Shifts$Shift", "array<double>"),
    ("st_gridorigins", "Shifts$Origins", "array<struct<x:double,y:double>>"),
    ("st_movedby", "Shifts$Moved", "array<double>"),
    ("st_reprojectby", "Shifts$Reproject", "binary"),
    ("st_layerslices", "Tiles$Slices", "array<binary>"),
    ("st_tilefeature", "Tiles$One", "binary"),
    ("st_tilecount", "Tiles$Count", "bigint"),
    ("st_tilesmet", "Tiles$Met", "array<struct<x:int,y:int>>"),
    ("st_tilefeatures", "Tiles$Read", "array<struct<kind:int,xs:array<bigint>,ys:array<bigint>,properties:map<string,string>>>"),
)


def register(spark: SparkSession) -> SparkSession:
    """Makes the topology functions known to SQL in this session."""
    if spark.catalog.functionExists("st_relate"):
        return spark
    spark.sql(f"ADD JAR '{JAR}'")
    for name, cls, kind in FUNCTIONS:
        spark.udf.registerJavaFunction(name, f"terrazzo.geometry.{cls if '$' in cls else f'Functions${cls}'}", kind)
    # the aggregate has no registration by name; its class is called where the session's jars are known
    tiles = spark._jvm.org.apache.spark.util.Utils.classForName("terrazzo.geometry.Tiles", True, False)
    tiles.getMethod("register", _classes(spark, "org.apache.spark.sql.SparkSession")).invoke(None, _objects(spark, spark._jsparkSession))
    return spark


def _classes(spark: SparkSession, *names: str):
    return _array(spark, "Class", [spark._jvm.java.lang.Class.forName(n) for n in names])


def _objects(spark: SparkSession, *items):
    return _array(spark, "Object", items)


def _array(spark: SparkSession, kind: str, items):
    made = spark.sparkContext._gateway.new_array(getattr(spark._jvm.java.lang, kind), len(items))
    for k, item in enumerate(items):
        made[k] = item
    return made


def call(name: str, *args: Column) -> Column:
    return F.call_function(name, *args)


def point(x: Column, y: Column) -> Column:
    """A point from two columns; null where either is."""
    x, y = x.cast("double"), y.cast("double")
    env = F.struct(x.alias("minx"), y.alias("miny"), x.alias("maxx"), y.alias("maxy"))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(call("st_point", x, y).alias("wkb"), env.alias("env")))


def box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """An axis-parallel rectangle as a polygon; null where a side is."""
    x0, y0, x1, y1 = (c.cast("double") for c in (minx, miny, maxx, maxy))
    env = F.struct(x0.alias("minx"), y0.alias("miny"), x1.alias("maxx"), y1.alias("maxy"))
    full = x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()
    return F.when(full, F.struct(call("st_box", x0, y0, x1, y1).alias("wkb"), env.alias("env")))


def encode(wkb: Column) -> Column:
    """A geometry struct from WKB, its envelope computed once."""
    b = call("st_bounds", wkb)
    env = F.when(b.isNotNull(), F.struct(b[0].alias("minx"), b[1].alias("miny"), b[2].alias("maxx"), b[3].alias("maxy")))
    return F.when(wkb.isNotNull(), F.struct(wkb.alias("wkb"), env.alias("env")))


def wkb_box(minx: float, miny: float, maxx: float, maxy: float) -> bytes:
    """WKB of a literal rectangle."""
    ring = [(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny)]
    return struct.pack(">bIII", 0, 3, 1, 5) + b"".join(struct.pack(">dd", *p) for p in ring)


def wkb_point(x: float, y: float) -> bytes:
    return struct.pack(">bIdd", 0, 1, x, y)


# --- coordinate arrays: measures that need no topology -----------------------------------------


def ring_area(points: Column) -> Column:
    """Area of a closed ring, array<struct<x,y>>, by the shoelace sum."""
    n = F.size(points)
    cross = F.transform(F.sequence(F.lit(0), n - 2), lambda i: points[i]["x"] * points[i + 1]["y"] - points[i + 1]["x"] * points[i]["y"])
    return F.when(n >= 4, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2).otherwise(F.lit(0.0))


def path_length(points: Column) -> Column:
    """Length of a path, array<struct<x,y>>."""
    n = F.size(points)
    step = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.hypot(points[i + 1]["x"] - points[i]["x"], points[i + 1]["y"] - points[i]["y"]))
    return F.when(n >= 2, F.aggregate(step, F.lit(0.0), lambda s, v: s + v)).otherwise(F.lit(0.0))


def densify_path(points: Column, most: float) -> Column:
    """Points inserted so that no segment exceeds ``most``."""

    def segment(i: Column) -> Column:
        a, b = points[i], points[i + 1]
        parts = F.greatest(F.ceil(F.hypot(b["x"] - a["x"], b["y"] - a["y"]) / most), F.lit(1)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), parts - 1),
            lambda k: F.struct((a["x"] + (b["x"] - a["x"]) * k / parts).alias("x"), (a["y"] + (b["y"] - a["y"]) * k / parts).alias("y")),
        )

    n = F.size(points)
    inner = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), segment))
    return F.when(n >= 2, F.concat(inner, F.slice(points, n, F.lit(1)))).otherwise(points)


def round_ordinates(c: Column, digits: int) -> Column:
    """Half to even."""
    return F.bround(c, digits)


def quantize(c: Column, origin: float, tolerance: float) -> Column:
    """Snap to the grid ``origin + round((v - origin) / tol) * tol``, half away from zero."""
    return F.lit(origin) + F.round((c - F.lit(origin)) / F.lit(tolerance)) * F.lit(tolerance)


# --- aggregates --------------------------------------------------------------------------------


def _spread(v: Column) -> Column:
    """The sixteen bits of a number with a free bit after each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def along_curve(x: Column, y: Column, bounds: tuple[float, float, float, float]) -> Column:
    """The place of a position on a space-filling curve through ``bounds``: what is near on it is near on the ground."""
    step = lambda v, low, high: F.least(F.greatest(F.floor((v - low) / ((high - low) or 1.0) * 65535), F.lit(0)), F.lit(65535)).cast("long")
    return _spread(step(x, bounds[0], bounds[2])).bitwiseOR(F.shiftleft(_spread(step(y, bounds[1], bounds[3])), 1))


def dissolve(df: DataFrame, keys: list[str], wkb: Column, how: str = "union", fan: int = 64) -> DataFrame:
    """Union (or ``hull``) of each group's geometries, in rounds: a round merges runs of ``fan`` neighbours.

    Equal shapes of a group are one from the start.  Pieces are ordered by a space-filling curve and dealt by ranges of it, so what is merged
    lies together and its inner edges go early, and no task holds more of a group than a range.  The largest group's size says
    whether another round is needed; a round's result is written.
    """
    name = {"union": "st_union_all", "hull": "st_hull_all"}[how]
    spark = register(df.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    b = call("st_bounds", F.col("wkb"))
    merged = df.select(*keys, wkb.alias("wkb"))
    placed = merged.withColumns({"_x": (b[0] + b[2]) / 2, "_y": (b[1] + b[3]) / 2})
    whole = lambda rows: rows.groupBy(*keys).agg(call(name, F.collect_list("wkb")).alias("wkb"))

    def largest(rows: DataFrame, *more: Column) -> tuple:
        """The largest group, all rows, and what else is asked of them."""
        groups = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *[c.alias(f"_m{k}") for k, c in enumerate(more)])
        ends = [f(F.col(f"_m{k}")) for k, f in enumerate((F.min, F.min, F.max, F.max)[: len(more)])]
        return tuple(groups.agg(F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0)), *ends).first())

    most, total, *box = largest(placed, F.min("_x"), F.min("_y"), F.max("_x"), F.max("_y"))
    if most <= fan:
        return whole(merged)
    ends = tuple(float(v) if v is not None else 0.0 for v in box)
    pieces = placed.dropDuplicates([*keys, "wkb"]).select(*keys, "wkb", F.coalesce(along_curve(F.col("_x"), F.col("_y"), ends), F.lit(0)).alias("_at"))
    before = None
    while most > fan:
        order = [*keys, "_at", F.xxhash64("wkb")]
        dealt = pieces.repartitionByRange(max(1, min(parts, total // (4 * fan))), *order).sortWithinPartitions(*order)
        runs = dealt.withColumn("_run", F.expr(f"monotonically_increasing_id() div {int(fan)}"))
        pieces = written(runs.groupBy(*keys, "_run").agg(call(name, F.collect_list("wkb")).alias("wkb"), F.min("_at").alias("_at")).drop("_run"), "dissolve")
        if before is not None:
            drop(before)
        before = pieces
        most, total = largest(pieces)
    return whole(pieces)
