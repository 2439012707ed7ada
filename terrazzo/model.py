"""The plan: predicates, orderings, reductions and the query that holds them."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class PlanError(ValueError):
    """A plan that cannot be answered; ``code`` is stable, the message names the member."""

    def __init__(self, message: str, code: str = "invalid.arguments"):
        super().__init__(message)
        self.code = code


class Kind(str, Enum):
    """Attribute kinds; everything a column holds is one of these."""

    BOOLEAN = "boolean"
    INT64 = "int64"
    DOUBLE = "double"
    STRING = "string"
    DATETIME = "datetime"
    GUID = "guid"
    GEOMETRY = "geometry"


@dataclass(frozen=True)
class Literal:
    """kind is string, integer, decimal, boolean, null or datetime (epoch milliseconds)."""

    kind: str
    value: object = None


class Predicate:
    """One node of the closed predicate tree."""


@dataclass(frozen=True)
class Every(Predicate):
    terms: tuple[Predicate, ...]


@dataclass(frozen=True)
class Some(Predicate):
    terms: tuple[Predicate, ...]


@dataclass(frozen=True)
class Compare(Predicate):
    """op is one of = != < <= > >= LIKE ILIKE."""

    field: str
    op: str
    value: Literal


@dataclass(frozen=True)
class IsNull(Predicate):
    field: str
    negated: bool = False


@dataclass(frozen=True)
class IsIn(Predicate):
    field: str
    values: tuple[Literal, ...]
    negated: bool = False


@dataclass(frozen=True)
class Constant(Predicate):
    truth: bool


def fields_of(p: Predicate | None) -> set[str]:
    """Every field a predicate reads."""
    if isinstance(p, (Every, Some)):
        return set().union(*map(fields_of, p.terms)) if p.terms else set()
    return {p.field} if isinstance(p, (Compare, IsNull, IsIn)) else set()


@dataclass(frozen=True)
class OrderTerm:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class Box:
    """Closed bounds."""

    minx: float
    miny: float
    maxx: float
    maxy: float


@dataclass(frozen=True)
class FeatureQuery:
    ids: tuple[str, ...] | None = None
    where: Predicate | None = None
    box: Box | None = None
    projection: tuple[str, ...] | None = None
    order: tuple[OrderTerm, ...] = ()
    limit: int | None = None
    offset: int | None = None
    cursor: str | None = None


#: Statistic names.
STATISTICS = ("count", "sum", "min", "max", "avg", "var", "stddev", "percentile_cont", "percentile_disc", "envelope")
NUMERIC_STATISTICS = frozenset({"sum", "avg", "var", "stddev", "percentile_cont", "percentile_disc"})


@dataclass(frozen=True)
class AggregateSpec:
    """A statistic of a field (``*`` only with count) under a result name."""

    statistic: str
    field: str
    name: str
    fraction: float | None = None
    descending: bool = False


@dataclass(frozen=True)
class AggregateQuery:
    specs: tuple[AggregateSpec, ...]
    group_by: tuple[str, ...] = ()
    having: Predicate | None = None
    order: tuple[OrderTerm, ...] = ()
    limit: int | None = None
    offset: int | None = None


@dataclass
class Page:
    """A page of features: a lazy DataFrame and what was computed about the whole."""

    rows: object
    next_cursor: str | None = None
    total: int | None = None
    has_more: bool = False
    notes: dict = field(default_factory=dict)
