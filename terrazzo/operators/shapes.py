"""Served result shapes over a selection: ids, counts, extents, classes, text search, served statistics."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.model import AggregateQuery, FeatureQuery, Kind, OrderTerm, Page, PlanError, Predicate
from terrazzo.plans import execute
from terrazzo.plans.compile import fold
from terrazzo.plans.dataset import ID, Dataset, quoted
from terrazzo.sources.ingest import with_ordinal

SHAPES = ("ids_only", "count_only", "extent_only", "distinct_values", "unique_ids_only")
MAX_BREAKS, MAX_UNIQUE = 32, 64


def check_shapes(asked: set[str]) -> None:
    """At most one shape, except a count of distinct values."""
    unknown = asked - set(SHAPES)
    if unknown:
        raise PlanError(f"unknown shape {sorted(unknown)[0]}")
    if len(asked) > 1 and asked != {"count_only", "distinct_values"}:
        raise PlanError(f"shapes exclude each other: {', '.join(sorted(asked))}")


def ids_only(ds: Dataset, q: FeatureQuery) -> DataFrame:
    """Object ids: the single integer identity; else the feature id."""
    chosen = execute.select(ds, q)
    if len(ds.ids) == 1 and ds.kind(ds.ids[0]) is Kind.INT64:
        return chosen.df.select(F.col(quoted(ds.ids[0])).cast("long").alias("object_id"))
    return chosen.df.select(chosen.feature_id().alias("object_id"))


def with_object_ids(ds: Dataset, name: str = "object_id") -> DataFrame:
    """Each row with its object id: the single integer identity, else the place in scan order, from 1."""
    if len(ds.ids) == 1 and ds.kind(ds.ids[0]) is Kind.INT64:
        return ds.df.withColumn(name, F.col(quoted(ds.ids[0])).cast("long"))
    return with_ordinal(ds.df, name)


def unique_ids_only(ds: Dataset, q: FeatureQuery) -> DataFrame:
    """A single text identity; guids in lower case."""
    if len(ds.ids) != 1 or ds.kind(ds.ids[0]) not in (Kind.STRING, Kind.GUID):
        raise PlanError("the dataset has no single text identity")
    c = F.col(quoted(ds.ids[0]))
    return execute.select(ds, q).df.select((F.lower(c) if ds.kind(ds.ids[0]) is Kind.GUID else c).alias("unique_id"))


def count_only(ds: Dataset, q: FeatureQuery) -> DataFrame:
    return execute.select(ds, q).df.agg(F.count(F.lit(1)).alias("count"))


def count_distinct(ds: Dataset, q: FeatureQuery, fields: tuple[str, ...]) -> DataFrame:
    """Distinct combinations, null being a value."""
    return execute.select(ds, q).df.select(*[F.col(quoted(f)) for f in fields]).distinct().agg(F.count(F.lit(1)).alias("count"))


def extent_only(ds: Dataset, q: FeatureQuery, geometry: str | None = None) -> DataFrame:
    env = F.col(quoted(geometry or ds.geometries[0]))["env"]
    box = (F.min(env["minx"]).alias("minx"), F.min(env["miny"]).alias("miny"), F.max(env["maxx"]).alias("maxx"), F.max(env["maxy"]).alias("maxy"))
    return execute.select(ds, q).df.agg(*box, F.count(F.lit(1)).alias("count"))


def served_statistics(ds: Dataset, q: FeatureQuery, a: AggregateQuery) -> DataFrame:
    """As the reduction, but ungrouped statistics over nothing are all null, counts included."""
    if a.having is not None and any(s.statistic.startswith("percentile") for s in a.specs):
        raise PlanError("percentiles and having exclude each other")
    rows = execute.aggregate(ds, q, a)
    if a.group_by:
        return rows
    n = execute.select(ds, q).df.agg(F.count(F.lit(1)).alias("__n"))
    both = rows.crossJoin(F.broadcast(n))  # one row each
    return both.select(*[F.when(F.col("__n") > 0, F.col(quoted(s.name))).alias(s.name) for s in a.specs])


def class_breaks(ds: Dataset, q: FeatureQuery, field: str, n: int) -> DataFrame:
    """Equal-interval breaks: class, low, high; one class if all values are equal."""
    if not 1 <= n <= MAX_BREAKS:
        raise PlanError(f"breaks: 1 to {MAX_BREAKS}")
    if ds.kind(field) not in (Kind.INT64, Kind.DOUBLE):
        raise PlanError(f"{field} is not numeric")
    c = F.col(quoted(field)).cast("double")
    ends = execute.select(ds, q).df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).where("lo is not null")
    classes = F.when(F.col("lo") == F.col("hi"), F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.lit(n)))
    at = lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / n
    rows = ends.select("lo", "hi", F.explode(classes).alias("class"))
    return rows.select("class", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(at(F.col("class") - 1)).alias("low"), F.when((F.col("lo") == F.col("hi")) | (F.col("class") == n), F.col("hi")).otherwise(at(F.col("class"))).alias("high"))


def unique_values(ds: Dataset, q: FeatureQuery, field: str, most: int = MAX_UNIQUE) -> DataFrame:
    """Distinct values that are not null; more than ``most`` is refused."""
    rows = execute.select(ds, q).df.select(F.col(quoted(field)).alias(field)).where(F.col(quoted(field)).isNotNull()).distinct()
    if rows.limit(most + 1).count() > most:
        raise PlanError(f"{field} has more than {most} values")
    return rows


def find_text(ds: Dataset, text: str, fields: tuple[str, ...] | None = None, contains: bool = True) -> DataFrame:
    """Rows with the text in a string field, case folded; ``found_field`` and ``value`` of the first such field."""
    names = [f for f in (fields or ds.fields) if ds.kinds.get(f) is Kind.STRING]
    if not names:
        raise PlanError("no string fields to search")
    wanted = F.lit(text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    hit = {n: F.coalesce(fold(F.col(quoted(n))).contains(wanted) if contains else fold(F.col(quoted(n))).startswith(wanted), F.lit(False)) for n in names}
    first = reduce(lambda out, n: F.when(hit[n], F.lit(n)).otherwise(out), reversed(names), F.lit(None).cast("string"))
    value = reduce(lambda out, n: F.when(hit[n], F.col(quoted(n))).otherwise(out), reversed(names), F.lit(None).cast("string"))
    return ds.df.where(reduce(operator.or_, hit.values())).withColumns({"found_field": first, "value": value})


def layers(parts: dict[str, DataFrame]) -> DataFrame:
    """One query over several layers: rows side by side under the layer's name, columns by name."""
    named = [df.withColumn("layer", F.lit(n)) for n, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def layers_page(parts: dict[str, Dataset], where: dict[str, Predicate] | None = None, order: tuple[OrderTerm, ...] = (), limit: int | None = None, offset: int = 0) -> Page:
    """One page over several layers: the sort keys (null where a layer lacks one), then the layer's place, then the id as text; with the number matched."""
    chosen = {n: execute.select(ds, FeatureQuery(where=(where or {}).get(n))) for n, ds in parts.items()}
    rows = layers({n: c.df.select(c.feature_id().alias(ID), *[F.col(quoted(f)) for f in c.fields]) for n, c in chosen.items()})
    place = F.element_at(F.create_map(*[F.lit(v) for k, n in enumerate(parts) for v in (n, k)]), F.col("layer"))
    known = {f for ds in parts.values() for f in ds.fields}
    if unknown := [t.field for t in order if t.field not in known]:
        raise PlanError(f"no layer has a field {unknown[0]!r}")
    keys = [F.col(quoted(t.field)).desc_nulls_first() if t.descending else F.col(quoted(t.field)).asc_nulls_last() for t in order]
    matched = rows.count()
    page = rows.orderBy(*keys, place, ID).offset(offset)
    end = offset + (limit if limit is not None else matched)
    return Page(page.limit(limit) if limit is not None else page, str(end) if end < matched else None, matched, end < matched)
