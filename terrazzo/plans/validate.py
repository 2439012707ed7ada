"""Schema-level checks, before any DataFrame is built."""

from __future__ import annotations

from terrazzo.model import NUMERIC_STATISTICS, STATISTICS, AggregateQuery, FeatureQuery, Kind, PlanError, fields_of
from terrazzo.plans.dataset import Dataset


def _distinct_fields(ds: Dataset, names, what: str, empty: bool = True) -> None:
    if not names and not empty:
        raise PlanError(f"{what}: at least one field is needed")
    for n in names:
        ds.kind(n)
    if len(set(names)) != len(names):
        raise PlanError(f"{what}: a field is named twice")


def feature_query(ds: Dataset, q: FeatureQuery) -> None:
    if q.ids is not None:
        if any(not str(i).strip() for i in q.ids):
            raise PlanError("ids: a blank id")
        if not ds.ids:
            raise PlanError("ids: the dataset has no identity")
    for f in sorted(fields_of(q.where)):
        ds.kind(f)
    if q.projection is not None:
        _distinct_fields(ds, [f for f in q.projection if f != "*"], "projection")
    for t in q.order:
        if ds.kind(t.field) is Kind.GEOMETRY:
            raise PlanError(f"order: {t.field} is a geometry")
    for name, value in (("limit", q.limit), ("offset", q.offset)):
        if value is not None and value < 0:
            raise PlanError(f"{name}: negative")
    if q.cursor is not None and q.offset is not None:
        raise PlanError("cursor and offset exclude each other")
    if q.box and not ds.geometries:
        raise PlanError("box: the dataset has no geometry")


def aggregate_query(ds: Dataset, a: AggregateQuery) -> None:
    if not a.specs:
        raise PlanError("specs: at least one statistic is needed")
    _distinct_fields(ds, a.group_by, "group_by")
    if any(ds.kind(g) is Kind.GEOMETRY for g in a.group_by):
        raise PlanError("group_by: a geometry")
    names = [s.name for s in a.specs]
    if len({*names, *a.group_by}) != len(names) + len(a.group_by):
        raise PlanError("specs: a result name is taken twice")
    for s in a.specs:
        if s.statistic not in STATISTICS:
            raise PlanError(f"{s.name}: unknown statistic {s.statistic}")
        if s.field == "*":
            if s.statistic != "count":
                raise PlanError(f"{s.name}: * is for count only")
            continue
        kind = ds.kind(s.field)
        if s.statistic in NUMERIC_STATISTICS and kind not in (Kind.INT64, Kind.DOUBLE):
            raise PlanError(f"{s.name}: {s.statistic} needs a numeric field")
        if (s.statistic == "envelope") != (kind is Kind.GEOMETRY) and s.statistic != "count":
            raise PlanError(f"{s.name}: {s.statistic} of {kind.value}")
        if s.statistic.startswith("percentile") and not (s.fraction is not None and 0 <= s.fraction <= 1):
            raise PlanError(f"{s.name}: a fraction within [0, 1] is needed")
    known = {*names, *a.group_by}
    for f in sorted(fields_of(a.having) | {t.field for t in a.order}):
        if f not in known:
            raise PlanError(f"{f} is neither a group key nor a result")
    if a.limit is not None and a.limit <= 0:
        raise PlanError("limit: must be positive")
    if a.offset is not None and a.offset < 0:
        raise PlanError("offset: negative")
