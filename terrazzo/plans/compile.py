"""Predicates and orderings as Spark columns.

Every comparison is decided by the column's kind when the plan is built: kinds
that cannot meet compile to false, so nothing is coerced and ANSI mode has
nothing to raise.  Comparisons stay bare ``column op literal`` wherever that is
exact, so Parquet statistics prune row groups.
"""

from __future__ import annotations

import math
import operator
import uuid
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrazzo.model import Compare, Constant, Every, IsIn, IsNull, Kind, Literal, OrderTerm, PlanError, Predicate, Some
from terrazzo.plans.dataset import Dataset, quoted

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OPS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_NUMBERS = ("integer", "decimal", "datetime")
_LONG = range(-(1 << 63), 1 << 63)


def can_match(kind: Kind, op: str, value: Literal) -> bool:
    """Whether a column of this kind can ever satisfy the comparison."""
    if kind is Kind.GUID:
        try:
            return op in ("=", "!=") and value.kind == "string" and bool(uuid.UUID(value.value))
        except ValueError:
            return False
    if kind is Kind.BOOLEAN:
        return op in ("=", "!=") and value.kind == "boolean"
    if op in ("LIKE", "ILIKE"):
        return kind is Kind.STRING and value.kind == "string"
    if kind is Kind.STRING:
        return value.kind == "string"
    return kind in (Kind.INT64, Kind.DOUBLE, Kind.DATETIME) and value.kind in _NUMBERS


def fold(c: Column) -> Column:
    """ASCII-only case folding."""
    return F.translate(c, _UPPER, _LOWER)


def _instant(ms: int, dtype: T.DataType) -> Column:
    """A literal of the column's own timestamp type, so the comparison needs no cast and no session zone."""
    when = datetime(1970, 1, 1) + timedelta(milliseconds=ms)
    text = when.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.expr(f"TIMESTAMP_NTZ '{text}'") if isinstance(dtype, (T.TimestampNTZType, T.DateType)) else F.expr(f"TIMESTAMP '{text}+00:00'")


def _compare_time(c: Column, dtype: T.DataType, op: str, value: float) -> Column:
    """A date-time column counts in whole milliseconds; the bound moves to the column's side of the literal."""
    if isinstance(dtype, T.DateType):
        c = c.cast("timestamp_ntz")
    lowest, highest = -62135596800000, 253402300799999  # the years 1 to 9999
    if value != math.floor(value):
        if op in ("=", "!="):
            return c.isNotNull() & F.lit(op == "!=")
        op, value = {"<": ("<=", math.floor(value)), "<=": ("<=", math.floor(value)), ">": (">", math.floor(value)), ">=": (">", math.floor(value))}[op]
    if not lowest <= value < highest:
        above = value >= highest
        return c.isNotNull() & F.lit(op == "!=" or op[0] == ("<" if above else ">"))
    at, after = _instant(int(value), dtype), _instant(int(value) + 1, dtype)
    if op == "=":
        return (c >= at) & (c < after)
    if op == "!=":
        return (c < at) | (c >= after)
    return {"<": c < at, "<=": c < after, ">": c >= after, ">=": c >= at}[op]


def _compare(ds: Dataset, p: Compare) -> Column:
    kind, c = ds.kind(p.field), F.col(quoted(p.field))
    if not can_match(kind, p.op, p.value):
        return F.lit(False)
    value = p.value.value
    if p.op in ("LIKE", "ILIKE"):
        pattern = value.replace("\\", "\\\\")  # the grammar has no escape character
        return c.like(pattern) if p.op == "LIKE" else fold(c).like(pattern.translate(str.maketrans(_UPPER, _LOWER)))
    if kind is Kind.DATETIME:
        return _compare_time(c, ds.df.schema[p.field].dataType, p.op, value)
    if kind is Kind.GUID:
        return _OPS[p.op](F.lower(c), F.lit(str(uuid.UUID(value))))
    if kind in (Kind.INT64, Kind.DOUBLE):
        if kind is Kind.INT64 and p.value.kind != "decimal":
            if value not in _LONG:
                return c.isNotNull() & F.lit(p.op == "!=" or p.op[0] == ("<" if value > 0 else ">"))
            return _OPS[p.op](c, F.lit(value).cast("long") if value not in range(-(1 << 31), 1 << 31) else F.lit(value))
        number = F.lit(float(value))
        c = c.cast("double") if not isinstance(ds.df.schema[p.field].dataType, T.DoubleType) else c
        out = _OPS[p.op](c, number)
        # NaN sorts above every number in Spark; here it satisfies no ordering
        return out & ~F.isnan(c) if p.op in (">", ">=") else out
    return _OPS[p.op](c, F.lit(value))


def predicate(ds: Dataset, p: Predicate) -> Column:
    """A two-valued column: an unknown comparison is false."""
    if isinstance(p, Constant):
        return F.lit(p.truth)
    if isinstance(p, (Every, Some)):
        if not p.terms:
            return F.lit(isinstance(p, Every))
        return reduce(operator.and_ if isinstance(p, Every) else operator.or_, [predicate(ds, t) for t in p.terms])
    if isinstance(p, IsNull):
        ds.kind(p.field)
        c = F.col(quoted(p.field))
        return c.isNotNull() if p.negated else c.isNull()
    if isinstance(p, IsIn):
        ds.kind(p.field)
        c = F.col(quoted(p.field))
        hits = [_compare(ds, Compare(p.field, "=", v)) for v in p.values if can_match(ds.kind(p.field), "=", v)]
        plain = [v.value for v in p.values if can_match(ds.kind(p.field), "=", v)]
        if plain and ds.kind(p.field) in (Kind.STRING, Kind.INT64) and all(isinstance(v, str) or isinstance(v, int) and v in _LONG for v in plain):
            found = c.isin(plain)
        else:
            found = reduce(operator.or_, hits) if hits else F.lit(False)
        return c.isNotNull() & (~found if p.negated else found)
    if isinstance(p, Compare):
        return _compare(ds, p)
    raise PlanError(f"not a predicate: {p!r}")


def order_keys(ds: Dataset, terms: tuple[OrderTerm, ...]) -> list[Column]:
    """Nulls last ascending and first descending; NaN is the smallest number."""
    keys = []
    for t in terms:
        kind, c = ds.kind(t.field), F.col(quoted(t.field))
        if kind is Kind.GEOMETRY:
            raise PlanError(f"{t.field} is a geometry and has no order")
        c = F.lower(c) if kind is Kind.GUID else c
        steps = [F.when(c.isNotNull(), (~F.isnan(c)).cast("int")), c] if isinstance(ds.df.schema[t.field].dataType, (T.DoubleType, T.FloatType)) else [c]
        keys += [s.desc_nulls_first() if t.descending else s.asc_nulls_last() for s in steps]
    return keys
