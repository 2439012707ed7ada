"""Temporal-extent relations between features and a window of epoch milliseconds (either end may be open)."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazzo.model import Compare, Kind, Literal, PlanError
from terrazzo.plans.compile import predicate
from terrazzo.plans.dataset import Dataset, quoted

RELATIONS = ("overlaps", "contains", "within")


def _bound(ds: Dataset, name: str, op: str, ms: int | None) -> Column:
    return F.lit(True) if ms is None else predicate(ds, Compare(name, op, Literal("datetime", ms)))


def any_date(ds: Dataset, start: int | None, end: int | None) -> DataFrame:
    """Without designated fields: any date value inside the inclusive window, or no date value at all."""
    dates = [n for n, k in ds.kinds.items() if k is Kind.DATETIME]
    if not dates:
        return ds.df
    inside = [F.col(quoted(d)).isNotNull() & _bound(ds, d, ">=", start) & _bound(ds, d, "<=", end) for d in dates]
    none = reduce(operator.and_, [F.col(quoted(d)).isNull() for d in dates])
    return ds.df.where(reduce(operator.or_, inside) | none)


def extent(ds: Dataset, start: int | None, end: int | None, relation: str = "overlaps") -> DataFrame:
    """Designated start and end fields: null is infinite, a start after its end matches nothing.

    ``overlaps`` shares an instant with the window, ``contains`` covers it, ``within`` is covered by it.
    """
    if relation not in RELATIONS:
        raise PlanError(f"unknown time relation {relation!r}")
    if not ds.start_field:
        raise PlanError("the dataset has no time fields")
    a, b = ds.start_field, ds.end_field or ds.start_field
    ca, cb = F.col(quoted(a)), F.col(quoted(b))
    proper = ca.isNull() | cb.isNull() | (ca <= cb)
    if relation == "overlaps":
        test = (cb.isNull() | _bound(ds, b, ">=", start)) & (ca.isNull() | _bound(ds, a, "<=", end))
    elif relation == "contains":
        test = (ca.isNull() | (_bound(ds, a, "<=", start) if start is not None else F.lit(False))) & (cb.isNull() | (_bound(ds, b, ">=", end) if end is not None else F.lit(False)))
    else:
        low = F.lit(True) if start is None else ca.isNotNull() & _bound(ds, a, ">=", start)
        high = F.lit(True) if end is None else cb.isNotNull() & _bound(ds, b, "<=", end)
        test = low & high
    return ds.df.where(proper & test)
