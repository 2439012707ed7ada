"""The served query surface: one call that reads request parameters as text and answers with a DataFrame.

Parameters (all optional): where, objectIds, geometry, inSR, spatialRel, relationMask,
distance, units, time, timeRelation, outFields, orderByFields, resultOffset,
resultRecordCount, returnIdsOnly, returnUniqueIdsOnly, returnCountOnly,
returnExtentOnly, returnDistinctValues, outStatistics, groupByFieldsForStatistics,
having, outSR, geometryPrecision, maxAllowableOffset, quantizationParameters,
returnCentroid, returnGeometry, returnZ, returnM (both true unless said otherwise; absent ordinates stay absent).
Anything else is refused by name.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.functions import crs, featurejson
from terrazzo.functions import geometry as geo
from terrazzo.model import AggregateQuery, AggregateSpec, FeatureQuery, OrderTerm, Page, PlanError
from terrazzo.operators import shapes, spatial, temporal
from terrazzo.plans import execute
from terrazzo.plans.dataset import Dataset, quoted
from terrazzo.plans.parse import parse_where

#: Rows of a page unless fewer are asked for.
PAGE = 1000
# Metres in a unit, relation and statistic names of the protocol.
ANGLES = {"decimaldegree": 1.0, "degree": 1.0, "minute": 1 / 60, "second": 1 / 3600, "radian": 57.29577951308232, "gradian": 0.9}
UNITS = {"meter": 1.0, "kilometer": 1000.0, "foot": 0.3048, "ussurveyfoot": 1200 / 3937, "statutemile": 1609.344, "nauticalmile": 1852.0}
RELATIONS = {"intersects": "intersects", "envelopeintersects": "envelope", "contains": "contains", "within": "within", "touches": "touches", "overlaps": "overlaps", "crosses": "crosses", "relation": "relation"}
STATISTICS = {"count": "count", "sum": "sum", "min": "min", "max": "max", "avg": "avg", "stddev": "stddev", "var": "var", "percentile_continuous": "percentile_cont", "percentile_discrete": "percentile_disc", "envelopeaggregate": "envelope"}
KNOWN = frozenset(
    "where objectIds geometry geometryType inSR spatialRel relationMask distance units time timeRelation outFields orderByFields resultOffset resultRecordCount returnIdsOnly returnUniqueIdsOnly "
    "returnCountOnly returnExtentOnly returnDistinctValues outStatistics groupByFieldsForStatistics having outSR geometryPrecision maxAllowableOffset quantizationParameters returnCentroid returnGeometry returnZ returnM f".split()
)


def _names(text: str | None) -> tuple[str, ...]:
    return tuple(n.strip() for n in (text or "").split(",") if n.strip())


def _flag(p: dict, name: str) -> bool:
    return str(p.get(name, "")).lower() == "true"


def _number(p: dict, name: str, kind=float):
    try:
        return kind(p[name]) if p.get(name) not in (None, "") else None
    except ValueError:
        raise PlanError(f"{name}: not a number") from None


def order_terms(text: str | None) -> tuple[OrderTerm, ...]:
    """``a, b DESC`` as terms."""
    out = []
    for part in _names(text):
        name, _, way = part.partition(" ")
        if way.strip().upper() not in ("", "ASC", "DESC"):
            raise PlanError(f"orderByFields: {part!r}")
        out.append(OrderTerm(name, way.strip().upper() == "DESC"))
    return tuple(out)


def query_geometry(text: str) -> spatial.QueryGeometry:
    """A point, box, multipoint, polyline or polygon: ``x,y``, ``xmin,ymin,xmax,ymax`` or feature JSON."""
    try:
        g = json.loads(text) if text.lstrip().startswith("{") else [float(v) for v in text.split(",")]
        if isinstance(g, list):
            g = {"x": g[0], "y": g[1]} if len(g) == 2 else dict(zip(("xmin", "ymin", "xmax", "ymax"), g, strict=True))
    except (IndexError, ValueError) as e:
        raise PlanError(f"geometry: {e}") from e
    return spatial.QueryGeometry(*featurejson.decode(g))


def statistics(text: str, group_by: tuple[str, ...], having: str | None, order: tuple[OrderTerm, ...], limit: int | None, offset: int | None) -> AggregateQuery:
    """``outStatistics`` as a reduction."""
    specs = []
    try:
        for s in json.loads(text):
            kind, more = STATISTICS[s["statisticType"].lower()], s.get("statisticParameters") or {}
            fraction = float(more["value"]) if kind.startswith("percentile") else None
            specs.append(AggregateSpec(kind, s["onStatisticField"], s.get("outStatisticFieldName") or f"{kind}_{s['onStatisticField']}", fraction, str(more.get("orderBy", "asc")).lower() == "desc"))
    except (KeyError, TypeError, ValueError) as e:
        raise PlanError(f"outStatistics: {e}") from e
    return AggregateQuery(tuple(specs), group_by, parse_where(having), order if group_by else (), limit if group_by else None, offset if group_by else None)


def moved(spark: SparkSession, q: spatial.QueryGeometry, source: int, target: int) -> spatial.QueryGeometry:
    """The query geometry in another system."""
    one = geo.register(spark).range(1).select(crs.transform_geometry(F.lit(q.wkb), source, target).alias("wkb"))
    wkb, env = one.select("wkb", geo.call("st_bounds", F.col("wkb"))).first()
    return spatial.QueryGeometry(bytes(wkb), tuple(env), q.dimension)


def _unit(p: dict, native: int) -> float:
    """A distance unit in units of the layer: linear units need a projected layer, angular ones a geographic one."""
    if not p.get("units"):
        return 1.0
    unit = str(p["units"]).lower().removeprefix("esrisrunit_")
    kind = crs.describe(native).kind
    if unit in UNITS and kind == "projected":
        return UNITS[unit]
    if unit in ANGLES and kind == "geographic":
        return ANGLES[unit]
    if unit in UNITS or unit in ANGLES:
        raise PlanError(f"units: {unit} does not measure a {kind} layer")
    raise PlanError(f"units: {unit}")


def _matched(ds: Dataset, p: dict, native: int) -> Dataset:
    """Rows by ids, where, time and geometry."""
    ids = _names(p.get("objectIds")) if "objectIds" in p else None
    ds = execute.select(ds, FeatureQuery(ids=ids, where=parse_where(p.get("where"))))
    if p.get("time"):
        ends = [None if v.strip().lower() == "null" else int(v) for v in str(p["time"]).split(",")]
        start, end = ends[0], ends[-1]
        df = temporal.extent(ds, start, end, str(p.get("timeRelation") or "overlaps").lower().removeprefix("esritimerelation")) if ds.start_field else temporal.any_date(ds, start, end)
        ds = ds.with_df(df)
    if p.get("geometry"):
        if not ds.geometries:
            raise PlanError("geometry: the dataset has none")
        q, distance = query_geometry(p["geometry"]), _number(p, "distance")
        if (stated := int(p.get("inSR") or native)) != native:
            q = moved(ds.df.sparkSession, q, stated, native)
        if distance:
            return ds.with_df(spatial.within_distance(ds.df, ds.geometries[0], q, distance * _unit(p, native)))
        name = str(p.get("spatialRel") or "intersects").lower().removeprefix("esrispatialrel")
        if name not in RELATIONS:
            raise PlanError(f"spatialRel: {name}")
        mask = p.get("relationMask") if RELATIONS[name] == "relation" else None
        if RELATIONS[name] == "relation" and not mask:
            raise PlanError("relationMask is needed")
        ds = ds.with_df(spatial.filter_by(ds.df, ds.geometries[0], q, RELATIONS[name], mask))
    return ds


def _shown(ds: Dataset, df: DataFrame, p: dict, native: int) -> DataFrame:
    """The output geometry: generalised, reprojected, with a centroid; ordinates rounded or snapped."""
    name = ds.geometries[0]
    wkb: Column = F.col(quoted(name))["wkb"]
    keep = [str(p.get(n, "true")).lower() != "false" for n in ("returnZ", "returnM")]
    if not all(keep):
        wkb = geo.call("st_keep", wkb, *map(F.lit, keep))
    if (offset := _number(p, "maxAllowableOffset")) is not None:
        wkb = geo.call("st_generalize", wkb, F.lit(offset))
    wkb = crs.transform_geometry(wkb, native, int(p.get("outSR") or native))
    out = df.withColumn(name, geo.encode(wkb))
    if _flag(p, "returnCentroid"):
        middle = geo.call("st_bounds", geo.call("st_centroid", F.col(quoted(name))["wkb"]))
        out = out.withColumn("centroid", F.struct(middle[0].alias("x"), middle[1].alias("y")))
    shape = F.col(quoted(name))["wkb"]
    if (digits := _number(p, "geometryPrecision", int)) is not None:
        shape = geo.call("st_round", shape, F.lit(digits))
    if p.get("quantizationParameters"):
        q = json.loads(p["quantizationParameters"])
        box, tolerance = q.get("extent", {}), float(q["tolerance"])
        upper = str(q.get("originPosition", "upperLeft")).lower() == "upperleft"
        shape = geo.call("st_snap", shape, F.lit(float(box.get("xmin", 0))), F.lit(float(box.get("ymax" if upper else "ymin", 0))), F.lit(tolerance))
    if digits is not None or p.get("quantizationParameters"):
        out = out.withColumn(name, geo.encode(shape))
    return out


def serve(ds: Dataset, params: dict[str, str], native: int = 4326) -> DataFrame:
    """The answer to a request over a dataset whose geometry is in the system ``native``."""
    unknown = sorted(k for k, v in params.items() if k not in KNOWN and v not in (None, ""))
    if unknown:
        raise PlanError(f"{unknown[0]} is not supported")
    p = {k: v for k, v in params.items() if v not in (None, "")}
    geo.register(ds.df.sparkSession)
    asked = {s for s, flag in (("ids_only", "returnIdsOnly"), ("unique_ids_only", "returnUniqueIdsOnly"), ("count_only", "returnCountOnly"), ("extent_only", "returnExtentOnly"), ("distinct_values", "returnDistinctValues")) if _flag(p, flag)}
    shapes.check_shapes(asked)
    if p.get("having") and not p.get("outStatistics"):
        raise PlanError("having needs outStatistics")
    order, offset, limit = order_terms(p.get("orderByFields")), _number(p, "resultOffset", int), _number(p, "resultRecordCount", int)
    fields = tuple(n for n in _names(p.get("outFields")) if n != "*") or None
    found = _matched(ds, p, native)
    if p.get("outStatistics"):
        return shapes.served_statistics(found, FeatureQuery(), statistics(p["outStatistics"], _names(p.get("groupByFieldsForStatistics")), p.get("having"), order, limit, offset))
    if "distinct_values" in asked:
        names = fields or tuple(c for c in ds.fields if c not in ds.geometries)
        if "count_only" in asked:
            return shapes.count_distinct(found, FeatureQuery(), names)
        return execute.distinct(found, FeatureQuery(order=order, limit=limit, offset=offset), names)
    for name, shape in (("count_only", shapes.count_only), ("extent_only", shapes.extent_only), ("ids_only", shapes.ids_only), ("unique_ids_only", shapes.unique_ids_only)):
        if name in asked:
            return shape(found, FeatureQuery())
    q = FeatureQuery(order=order, limit=min(PAGE, limit) if limit is not None else PAGE, offset=offset, projection=fields)
    if not ds.geometries or str(p.get("returnGeometry", "true")).lower() == "false":
        plain = fields or tuple(c for c in ds.fields if c not in ds.geometries)
        return execute.features(found, FeatureQuery(order=q.order, limit=q.limit, offset=offset, projection=plain), tie_by_id=False)
    wide = FeatureQuery(order=q.order, limit=q.limit, offset=offset, projection=(*fields, *[g for g in ds.geometries if g not in fields]) if fields else None)
    return _shown(ds, execute.features(found, wide, tie_by_id=False), p, native)


def page(ds: Dataset, params: dict[str, str], native: int = 4326) -> Page:
    """``serve`` with the transfer-limit flag: ``has_more`` says that rows follow the page, whose end is the next request's offset."""
    rows = serve(ds, params, native)
    shaped = any(_flag(params, f) for f in ("returnIdsOnly", "returnUniqueIdsOnly", "returnCountOnly", "returnExtentOnly", "returnDistinctValues"))
    if shaped or params.get("outStatistics"):
        return Page(rows)
    p = {k: v for k, v in params.items() if v not in (None, "")}
    limit, offset = _number(p, "resultRecordCount", int), _number(p, "resultOffset", int) or 0
    end = offset + (min(PAGE, limit) if limit is not None else PAGE)
    more = _matched(ds, p, native).df.offset(end).limit(1).count() > 0
    return Page(rows, str(end) if more else None, None, more)
