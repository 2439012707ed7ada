"""Declared relationships: related rows of each origin row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrazzo.model import FeatureQuery, OrderTerm, PlanError, Predicate
from terrazzo.plans import compile as compiling
from terrazzo.plans.dataset import Dataset, quoted


@dataclass(frozen=True)
class Relationship:
    """Key columns; many-to-many names the join set's two columns."""

    origin_key: str
    related_key: str
    join_origin: str | None = None
    join_related: str | None = None


# Request parameters that a traversal refuses; it returns every related record of each origin record, whole.
REFUSED = ("returnIdsOnly", "returnCountOnly", "returnExtentOnly", "returnDistinctValues", "outStatistics", "uniqueIds", "resultPaginationToken", "resultOffset", "resultRecordCount")


def check_parameters(params: dict[str, str]) -> None:
    """Counts, aggregates and pages are asked of the related layer itself."""
    for name in REFUSED:
        if params.get(name) not in (None, "", "false", False):
            raise PlanError(f"{name} is not supported for related records")


def related(
    origin: Dataset,
    target: Dataset,
    r: Relationship,
    where: Predicate | None = None,
    through: DataFrame | None = None,
    projection: tuple[str, ...] | None = None,
    order: tuple[OrderTerm, ...] = (),
    limit: int | None = None,
) -> DataFrame:
    """``__origin`` (the origin's feature id) beside related rows: equal keys and the related predicate.

    Null keys relate to nothing, origins without a match are left out, and through a join set no
    related row repeats for an origin.  ``limit`` counts per origin.
    """
    rows = target.df.where(compiling.predicate(target, where)) if where is not None else target.df
    picked = rows.select(F.col(quoted(r.related_key)).alias("__key"), F.struct(*[F.col(quoted(c)) for c in rows.columns]).alias("__row"))
    left = origin.df.select(origin.feature_id().alias("__origin"), F.col(quoted(r.origin_key)).alias("__okey")).where(F.col("__okey").isNotNull())
    if through is not None:
        links = through.select(F.col(quoted(r.join_origin)).alias("__okey"), F.col(quoted(r.join_related)).alias("__key")).where("__key is not null").distinct()
        left = left.join(links, "__okey").select("__origin", "__key")
    else:
        left = left.withColumnRenamed("__okey", "__key")
    joined = left.join(picked, "__key").select("__origin", "__row.*")
    if limit is not None:
        place = Dataset(joined, target.ids, target.ordinal)
        keys = compiling.order_keys(place, order) + [target.feature_id().asc()]
        joined = joined.withColumn("__at", F.row_number().over(W.partitionBy("__origin").orderBy(*keys))).where(F.col("__at") <= limit).drop("__at")
    names = list(projection) if projection else target.fields
    return joined.select("__origin", *[F.col(quoted(n)) for n in names])


def grouped(rows: DataFrame) -> DataFrame:
    """One row an origin: its related rows as an array, and how many."""
    columns = [c for c in rows.columns if c != "__origin"]
    return rows.groupBy("__origin").agg(F.collect_list(F.struct(*columns)).alias("related"), F.count("*").alias("n_related"))


__all__ = ["FeatureQuery", "Relationship", "grouped", "related"]
