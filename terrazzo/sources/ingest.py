"""File ingest: CSV, GeoJSON and NDJSON into typed feature DataFrames.

Types come from evidence over all records, summed up per column in one pass:
integers widen to doubles, any other mix is text, a missing or null value makes a
column nullable, an all-null column is nullable text, geometry comes last.  CSV cells
are judged by their text, JSON values by their JSON kind, so ``"0123"`` stays text.

A record that cannot become a feature fails the read when it is reached, or, where
``skip_malformed`` is set, is left out and listed in ``Decoded.skipped`` with its reason.
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrazzo.functions.geometry import TYPE, call, encode, point, register
from terrazzo.model import PlanError
from terrazzo.plans.dataset import quoted
from terrazzo.session import ship, written
from terrazzo.sources import documents

#: Coordinate column pairs, in the order they are tried.
PAIRS = (("x", "y"), ("lon", "lat"), ("longitude", "latitude"), ("easting", "northing"))
_INT = r"^\s*[+-]?[0-9]+\s*$"
_FLOAT = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
#: Lines that a CSV file may have before its header.
PREAMBLE = 1000
#: Why a record did not become a feature.
MALFORMED, GEOMETRY_INVALID, FIELD_NOT_INFERRED, CRS_CONFLICT = "RecordMalformed", "GeometryInvalid", "FieldNotInferred", "CrsConflict"


@dataclass(frozen=True)
class Decoded:
    """``features``: feature_id, attributes by inferred kind, geometry.  ``skipped``: reason and detail of the records left out."""

    features: DataFrame
    skipped: DataFrame
_CRS = re.compile(r"(?:urn:(?:x-)?ogc:def:crs:(?P<a>\w+):[^:]*:(?P<ac>\w+)|https?://www\.opengis\.net/def/crs/(?P<b>\w+)/[^/]*/(?P<bc>\w+)|(?P<c>\w+):(?P<cc>\w+))$", re.I)


def crs_name(name: str) -> str:
    """URN, URL or authority:code as ``AUTHORITY:code``; CRS84 is EPSG:4326."""
    m = _CRS.match(name.strip())
    if not m:
        raise PlanError(f"unknown coordinate system name {name!r}")
    authority, code = (m["a"] or m["b"] or m["c"]).upper(), (m["ac"] or m["bc"] or m["cc"]).upper()
    return "EPSG:4326" if code == "CRS84" else f"{authority}:{code}"


def agree(declared: str | None, asserted: str | None) -> str:
    """The file's declared system and the caller's must not differ."""
    names = {crs_name(n) for n in (declared, asserted) if n}
    if len(names) > 1:
        raise PlanError(f"the file declares {declared}, the caller asserts {asserted}")
    return names.pop() if names else "EPSG:4326"


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """1-based position in read order, from 1 without gaps.

    The rows are written once, in the shared folder, each with its partition and its place there; the counts of the partitions
    before are taken from what was written.  So both agree, however the rows came about and whichever executor is lost.
    """
    plain = [f"c{k}" for k in range(len(df.columns))]  # names may differ in case alone
    placed = df.toDF(*plain).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    rows = written(placed, "ordinals")
    counts = rows.groupBy("part").agg(F.count("*").alias("rows"))
    before = counts.select("part", F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # the low 33 bits of the id count rows inside a partition
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = rows.join(F.broadcast(before), "part")  # one row a partition
    return joined.select(*[F.col(c).alias(f.name, metadata=f.metadata) for c, f in zip(plain, df.schema, strict=True)], (F.col("before") + place + 1).alias(name))


def scalar_kinds(df: DataFrame, columns: list[str]) -> dict[str, tuple[str, bool]]:
    """(type, nullable) of text columns: boolean, long, double or string."""
    tests = []
    for k, c in enumerate(columns):
        v = F.col(quoted(c))
        full = v.isNotNull() & (v != "")
        tests += [
            F.max(full).alias(f"any{k}"),
            F.max(~full).alias(f"null{k}"),
            F.min(F.when(full, v.isin("true", "false"))).alias(f"bool{k}"),
            F.min(F.when(full, v.rlike(_INT) & v.try_cast("long").isNotNull())).alias(f"int{k}"),
            F.min(F.when(full, v.rlike(_FLOAT))).alias(f"num{k}"),
        ]
    row = df.agg(*tests).first() if tests else None
    out = {}
    for k, c in enumerate(columns):
        if not row[f"any{k}"]:
            out[c] = ("string", True)
        else:
            out[c] = ("boolean" if row[f"bool{k}"] else "long" if row[f"int{k}"] else "double" if row[f"num{k}"] else "string", bool(row[f"null{k}"]))
    return out


def typed(c: Column, kind: str) -> Column:
    """Empty text is null; casts are tried, never raised."""
    v = F.when(c != "", c)
    return v if kind == "string" else v.try_cast(kind)


def _free(name: str, taken) -> str:
    """``name``, lengthened until no attribute is called so."""
    while name in taken:
        name += "_"
    return name


def _judged(records: DataFrame, skip_malformed: bool) -> tuple[DataFrame, DataFrame]:
    """(records without a reason, skipped ones); unless they may be skipped, the first with a reason fails the read."""
    skipped = records.where("reason is not null").select("reason", F.col("detail").cast("string").alias("detail"))
    if skip_malformed:
        return records.where("reason is null"), skipped
    failure = F.raise_error(F.concat_ws(": ", "reason", F.substring(F.col("detail").cast("string"), 1, 200)))
    return records.where(F.when(F.col("reason").isNotNull(), failure.cast("boolean")).otherwise(F.lit(True))), skipped


# --- CSV ---------------------------------------------------------------------------------------


def _csv_head(spark: SparkSession, path: str) -> tuple[str | None, list[str], int]:
    """(declared system, header names, lines before the data that are not blank), from the first lines of the file."""
    declared, before = None, 0
    for (line,) in spark.read.text(path).limit(PREAMBLE).collect():
        if not line.strip():
            continue
        before += 1
        if not line.startswith("#"):
            names = next(csv.reader([line]))
            if not any(n.strip() for n in names):
                break
            return declared, names, before
        name, sign, value = line.lstrip("#").partition("=")
        if sign and name.strip().lower() == "crs":
            declared = value.strip()
    raise PlanError("the CSV document has no header row")


def _csv_rows(spark: SparkSession, path: str, width: int, before: int) -> DataFrame:
    """Rows as text columns c0, c1 …, ``bad``, the text of a row with another number of cells, and ``head``, true for what stands before the data.

    Files split wherever lines do; only where a quoted cell holds a line break is a file one task.
    A file that has lines before its header takes one more pass, for the place of its first row.
    """
    register(spark)
    broken = spark.read.text(path).where((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).limit(1).count() > 0
    schema = ", ".join([*(f"c{k} string" for k in range(width)), "bad string"])
    rows = spark.read.csv(path, schema=schema, header=before == 1, enforceSchema=True, multiLine=broken, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="bad")
    if before > 1:
        placed = rows.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
        first = placed.where("_block = 0").groupBy(F.col("_file").alias("_of")).agg(F.min("_at").alias("_first"))  # one row a file
        joined = placed.join(first, F.col("_file") == F.col("_of"), "left")
        rows = joined.withColumn("head", F.expr(f"_block = 0 and _at < _first + {before}")).drop("_file", "_block", "_at", "_of", "_first")
    else:
        rows = rows.withColumn("head", F.lit(False))
    # every column is looked at, so that Spark cannot leave cells out and miss what is malformed
    return rows.where(F.length(F.concat_ws("", *[f"c{k}" for k in range(width)])) >= 0)


def decode_csv(spark: SparkSession, path: str, crs: str | None = None, identity: str | None = None, skip_malformed: bool = False, x: str | None = None, y: str | None = None) -> Decoded:
    """A CSV file; ``#`` lines count only before the header, where ``# crs=`` declares the system; an empty coordinate is a null geometry.

    Coordinates are the columns ``x`` and ``y`` name, else the first known pair; a file without one has null geometries.
    A column of mixed kinds keeps the file's own text.
    """
    declared, names, before = _csv_head(spark, path)
    system = agree(declared, crs)
    rows = _csv_rows(spark, path, len(names), before)
    lower = {n.strip().lower(): k for k, n in reversed(list(enumerate(names)))}
    pairs = ((x.strip().lower(), y.strip().lower()),) if x and y else PAIRS
    pair = next(((lower[a], lower[b]) for a, b in pairs if a in lower and b in lower), None)
    if (x or y) and not pair:
        raise PlanError("x and y must name columns of the file")
    if identity is not None and identity not in names:
        raise PlanError(f"the file has no column {identity!r}")
    # rows of the head have no reason, wherever Spark asks for it
    reason, detail, geometry = F.when(F.col("head"), None).when(F.col("bad").isNotNull(), MALFORMED), F.col("bad"), F.lit(None).cast(TYPE)
    if pair:
        at = [F.col(f"c{k}") for k in pair]
        full = F.coalesce((at[0] != "") & (at[1] != ""), F.lit(False))
        numeric = at[0].rlike(_FLOAT) & at[1].rlike(_FLOAT)
        reason = reason.when(full & ~numeric, GEOMETRY_INVALID)
        detail = F.coalesce(detail, F.concat_ws(", ", *at))
        geometry = F.when(full, point(at[0].try_cast("double"), at[1].try_cast("double")))
    kept, skipped = _judged(rows.withColumns({"reason": reason, "detail": detail}).where("not head"), skip_malformed)
    columns = [k for k in range(len(names)) if not pair or k not in pair]
    kinds = scalar_kinds(kept, [f"c{k}" for k in columns])
    attributes = {}
    for k in columns:
        attributes[_free(names[k], attributes)] = typed(F.col(f"c{k}"), kinds[f"c{k}"][0])
    own = F.col(f"c{names.index(identity)}") if identity is not None else F.lit(None)
    name = _free("__own", attributes)
    features = kept.select(*[c.alias(n) for n, c in attributes.items()], own.alias(name), geometry.alias(_free("geometry", attributes), metadata={"crs": system}))
    return Decoded(_renamed(features, F.col(quoted(name)), list(attributes)), skipped)


def _renamed(features: DataFrame, own: Column, attributes: list[str]) -> DataFrame:
    """feature_id first: the source's own, else the 1-based position; then the attributes and the geometry."""
    geometry = _free("geometry", attributes)
    at, name = _free("ordinal", features.columns), _free("feature_id", attributes)
    text = F.when(own.cast("string") != "", own.cast("string"))
    if features.where(text.isNull()).limit(1).count():
        features, text = with_ordinal(features, at), F.coalesce(text, F.col(quoted(at)).cast("string"))
    return features.select(text.alias(name), *[F.col(quoted(c)) for c in attributes], F.col(quoted(geometry)))


def read_csv(spark: SparkSession, path: str, crs: str | None = None, identity: str | None = None, skip_malformed: bool = False, x: str | None = None, y: str | None = None) -> DataFrame:
    return decode_csv(spark, path, crs, identity, skip_malformed, x, y).features


# --- JSON --------------------------------------------------------------------------------------

_RECORD = "type string, id string, crs string, properties string, geometry string, bad string"
_VALUES = "map<string,variant>"


def judged_json(raw: DataFrame, system: str) -> DataFrame:
    """Records (type, id, crs, properties, geometry, bad) with their decoded geometry ``shape``, ``reason`` and ``detail``."""
    register(raw.sparkSession)
    shaped = raw.withColumn("shape", encode(call("st_fromgeojson", F.col("geometry"))))
    code = lambda c: F.replace(F.upper(F.regexp_extract(c, r"([A-Za-z0-9]+)\s*$", 1)), F.lit("CRS84"), F.lit("4326"))
    own = F.coalesce(F.get_json_object("crs", "$.properties.name"), F.when(~F.startswith("crs", F.lit("{")), F.col("crs")))
    is_object = F.startswith(F.ltrim("properties"), F.lit("{"))
    reason = (
        F.when(F.col("bad").isNotNull() | (F.col("type").isNotNull() & (F.col("type") != "Feature")) | (F.col("properties").isNotNull() & ~is_object), MALFORMED)
        .when(F.col("geometry").isNotNull() & F.col("shape").isNull(), GEOMETRY_INVALID)
        .when(own.isNotNull() & (code(own) != code(F.lit(system))), CRS_CONFLICT)
    )
    return shaped.withColumns({"reason": reason, "detail": F.coalesce("bad", F.when(reason == GEOMETRY_INVALID, F.col("geometry")).when(reason == CRS_CONFLICT, F.col("crs")).otherwise(F.col("properties")))})


def property_kinds(records: DataFrame) -> dict[str, str]:
    """Names, in the order they are first seen, and types of the properties, by the kinds of their JSON values."""
    held = records.select(F.monotonically_increasing_id().alias("row"), F.from_json("properties", _VALUES).alias("values"))
    pairs = held.select("row", F.posexplode("values").alias("at", "k", "v")).withColumn("kind", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0))
    value = F.when(F.col("kind") != "VOID", F.col("kind"))
    seen = pairs.groupBy("k").agg(
        F.min(F.struct("row", "at")).alias("first"), F.min(value == "BOOLEAN").alias("b"), F.min(value == "BIGINT").alias("i"), F.min(value.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")).alias("n")
    )
    return {r["k"]: "boolean" if r["b"] else "long" if r["i"] else "double" if r["n"] else "string" for r in seen.orderBy("first").collect()}


def property_columns(kinds: dict[str, str]) -> list[Column]:
    """The properties as typed columns; text is taken as it is, objects and arrays as JSON text."""
    values = F.from_json("properties", _VALUES)
    sql = {"boolean": "boolean", "long": "bigint", "double": "double", "string": "string"}
    return [F.try_variant_get(F.try_element_at(values, F.lit(k)), "$", sql[t]).alias(k) for k, t in kinds.items()]


def _json_features(raw: DataFrame, system: str, skip_malformed: bool, order: tuple[str, ...] = ()) -> Decoded:
    """``order`` names the columns that say where a record stands, unless its place in the scan does."""
    kept, skipped = _judged(judged_json(raw, system), skip_malformed)
    if order and kept.where("id is null or id = ''").limit(1).count():
        kept = kept.orderBy(*order)
    kinds = property_kinds(kept)
    own = _free("__own", kinds)
    features = kept.select(*property_columns(kinds), F.col("id").alias(own), F.col("shape").alias(_free("geometry", kinds), metadata={"crs": system}))
    return Decoded(_renamed(features, F.col(quoted(own)), list(kinds)), skipped)


_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "id", "crs", "properties", "geometry", "bad")])


def decode_geojson(spark: SparkSession, path: str, crs: str | None = None, skip_malformed: bool = False) -> Decoded:
    """A FeatureCollection (or one Feature); its ``crs`` member declares the system.

    A document is cut into ranges of bytes, so a large one is read by many tasks.  One that does not end is malformed as a whole; what is
    wrong inside of a feature is wrong with that feature alone.
    """
    items, rest = documents.elements(ship(spark), path)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}
    said = rest.select("file", "text", F.from_json("text", T.StructType([*_ITEM.fields, T.StructField("features", T.ArrayType(T.StringType()))]), options).alias("w"))
    declared = said.select(F.get_json_object("w.crs", "$.properties.name")).first()
    system = agree(declared[0] if declared else None, crs)
    many = items.select("file", "position", "text", F.from_json("text", _ITEM, options).alias("f"))
    # what is no object at all has no fields to be corrupt in
    many = many.select("file", "position", "f.type", "f.id", "f.crs", "f.properties", "f.geometry", F.coalesce("f.bad", F.when(~F.startswith(F.ltrim("text"), F.lit("{")), F.col("text"))).alias("bad"))
    one = said.where("w.features is null").select("file", F.lit(0).cast("long").alias("position"), "w.type", "w.id", F.lit(None).cast("string").alias("crs"), "w.properties", "w.geometry", "w.bad")
    return _json_features(many.unionByName(one), system, skip_malformed, ("file", "position"))


def read_geojson(spark: SparkSession, path: str, crs: str | None = None, skip_malformed: bool = False) -> DataFrame:
    return decode_geojson(spark, path, crs, skip_malformed).features


def decode_ndjson(spark: SparkSession, path: str, crs: str | None = None, skip_malformed: bool = False) -> Decoded:
    """One feature a line; splits anywhere, so it is the form for large files."""
    raw = spark.read.schema(_RECORD).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="bad")
    return _json_features(raw, agree(None, crs), skip_malformed)


def read_ndjson(spark: SparkSession, path: str, crs: str | None = None, skip_malformed: bool = False) -> DataFrame:
    return decode_ndjson(spark, path, crs, skip_malformed).features


# --- limits and output -------------------------------------------------------------------------


def capped(df: DataFrame, most: int) -> DataFrame:
    """Fails when there are more than ``most`` features; reads no more than that plus one."""
    if df.limit(most + 1).count() > most:
        raise PlanError(f"more than {most} features")
    return df


def stopping(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a stop: a task that meets more than ``most`` features fails as it reads the next one.

    Together the tasks may still hold more; ``overfull`` says so once they are written.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in the task
    stop = F.raise_error(F.lit(f"more than {most} features")).cast("boolean")
    return df.where(F.when(place >= most, stop).otherwise(F.lit(True)))


def overfull(written_rows: DataFrame, most: int) -> None:
    """Fails where written rows, whose number their files state, are more than ``most``."""
    if written_rows.count() > most:
        raise PlanError(f"more than {most} features")


def to_geojson(df: DataFrame, id_column: str, geometry: str | Column, exclude: tuple[str, ...] = ()) -> DataFrame:
    """A GeoJSON Feature a row, of any shape of RFC 7946; a null geometry or property is written as null.

    ``geometry`` is a column of the data, or an expression; ``exclude`` names columns that are no properties.
    """
    register(df.sparkSession)
    left_out = {id_column, *exclude} | ({geometry} if isinstance(geometry, str) else set())
    shape = F.col(quoted(geometry)) if isinstance(geometry, str) else geometry
    text = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{.v.:(.*)\}$", 1)
    names = [c for c in df.columns if c not in left_out]
    properties = F.to_json(F.struct(*[F.col(quoted(c)) for c in names]), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    parts = ['{"type":"Feature","id":', text(F.col(quoted(id_column)).cast("string")), ',"geometry":', F.coalesce(call("st_asgeojson", shape["wkb"]), F.lit("null")), ',"properties":', properties, "}"]
    return df.select(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("feature"))
