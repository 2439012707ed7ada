"""Topological filters and the spatial join.

An exact relation runs only on pairs whose envelopes meet, unless the relation holds for
shapes apart from each other; joins first meet by grid cell, so they are equi-joins and
never products.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazzo.functions.geometry import call, register
from terrazzo.model import PlanError
from terrazzo.plans.dataset import quoted
from terrazzo.session import written

#: Rows of a shape that are paired at once.
PART = 256
#: Pairs of rows that a task of a join makes, and tasks at most.
TASK, MOST_TASKS = 2_000_000, 20_000

# DE-9IM masks by relation, in the protocol's frame (the feature is the first operand).
MASKS = {
    "intersects": ("T********", "*T*******", "***T*****", "****T****"),
    "contains": ("T*F**F***",),
    "within": ("T*****FF*",),
    "touches": ("FT*******", "F**T*****", "F***T****"),
    "disjoint": ("FF*FF****",),
    "equals": ("T*F**FFF*",),
}
#: Masks that depend on the operands' dimensions.
DIMENSIONED = {
    "overlaps": {(2, 2): "T*T***T**", (1, 1): "1*T***T**"},
    "crosses": {(2, 1): "T**T*****", (1, 2): "T*T******", (1, 1): "0********"},
}


@dataclass(frozen=True)
class QueryGeometry:
    """The one geometry a filter tests features against."""

    wkb: bytes
    env: tuple[float, float, float, float]
    dimension: int


def check_mask(mask: str) -> str:
    if len(mask) != 9 or set(mask) - set("TF012*"):
        raise PlanError(f"not a relation mask: {mask!r}")
    return mask


def envelopes_meet(a: Column, b: Column) -> Column:
    """Closed overlap of two envelope structs."""
    return (a["minx"] <= b["maxx"]) & (a["maxx"] >= b["minx"]) & (a["miny"] <= b["maxy"]) & (a["maxy"] >= b["miny"])


def _box_meets(env: Column, q: tuple[float, float, float, float]) -> Column:
    return (env["minx"] <= q[2]) & (env["maxx"] >= q[0]) & (env["miny"] <= q[3]) & (env["maxy"] >= q[1])


def holds_apart(name: str, mask: str | None) -> bool:
    """Whether shapes without a common point can stand in the relation: no mask cell about their interiors and boundaries demands one."""
    masks = (check_mask(mask),) if mask is not None else MASKS.get(name, ())
    return any(all(m[k] in "F*" for k in (0, 1, 3, 4)) for m in masks)


def _rules(name: str, mask: str | None) -> str:
    if mask is not None:
        return check_mask(mask)
    if name == "intersects":
        return name
    if name in MASKS:
        return "|".join(MASKS[name])
    if name in DIMENSIONED:
        return "|".join(f"{a},{b}:{m}" for (a, b), m in DIMENSIONED[name].items())
    raise PlanError(f"unknown relation {name!r}")


def relation(feature_wkb: Column, query_wkb: Column, name: str, mask: str | None = None) -> Column:
    """Whether the relation holds: one matrix a pair, the query geometry prepared while it stays the same."""
    return call("st_related", feature_wkb, query_wkb, F.lit(_rules(name, mask)))


def filter_by(df: DataFrame, geometry: str, query: QueryGeometry, name: str = "envelope", mask: str | None = None) -> DataFrame:
    """Features that stand in a relation to the query geometry; never those with a null geometry, and empty ones only where ``holds_apart``.

    The envelope test comes first and alone reaches the scan.
    """
    g = F.col(quoted(geometry))
    near = _box_meets(g["env"], query.env)
    if name == "envelope" and mask is None:
        return df.where(near)
    register(df.sparkSession)
    exact = relation(g["wkb"], F.lit(query.wkb), name, mask)
    if name == "disjoint" and mask is None:
        return df.where(g.isNotNull() & F.when(F.coalesce(near, F.lit(False)), exact).otherwise(F.lit(True)))
    return df.where(exact) if holds_apart(name, mask) else df.where(near).where(exact)


def filter_by_any(df: DataFrame, geometry: str, queries: list[QueryGeometry], name: str = "intersects", mask: str | None = None) -> DataFrame:
    """Features that stand in a relation to some of the query geometries, each feature once, in one scan.

    The box about all query geometries reaches the scan; a geometry's own envelope test decides whether its relation is looked at.
    """
    if not queries:
        return df.where(F.lit(False))
    register(df.sparkSession)
    g = F.col(quoted(geometry))
    apart = name == "disjoint" or holds_apart(name, mask)
    tests = []
    for q in queries:
        near = F.coalesce(_box_meets(g["env"], q.env), F.lit(False))
        exact = near if name == "envelope" and mask is None else relation(g["wkb"], F.lit(q.wkb), name, mask)
        tests.append(exact if apart else near & exact)
    found = reduce(operator.or_, tests)
    if apart:
        return df.where(g.isNotNull() & found)
    envs = [q.env for q in queries]
    whole = (min(e[0] for e in envs), min(e[1] for e in envs), max(e[2] for e in envs), max(e[3] for e in envs))
    return df.where(_box_meets(g["env"], whole)).where(found)


def within_distance(df: DataFrame, geometry: str, query: QueryGeometry, distance: float) -> DataFrame:
    """Features at most ``distance`` from the query geometry: exact, without a buffer."""
    register(df.sparkSession)
    q = query.env
    grown = (q[0] - distance, q[1] - distance, q[2] + distance, q[3] + distance)
    g = F.col(quoted(geometry))
    return df.where(_box_meets(g["env"], grown)).where(call("st_distance", g["wkb"], F.lit(query.wkb)) <= distance)


def cells(env: Column, size: Column) -> Column:
    """The grid cells (x, y) that an envelope covers."""
    edge = lambda v: F.floor(v / size).cast("long")
    xs, ys = F.sequence(edge(env["minx"]), edge(env["maxx"])), F.sequence(edge(env["miny"]), edge(env["maxy"]))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def _level(env: Column, cell: float) -> Column:
    """The doublings of ``cell`` after which the envelope is no larger than a cell."""
    extent = F.greatest(env["maxx"] - env["minx"], env["maxy"] - env["miny"])
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(cell)) / cell))).cast("int")


def _kept(df: DataFrame, geometry: str, cell: float, suffix: str) -> DataFrame:
    """The rows, written, each with a number of its own and the level of its shape; rows without a shape are in no pair."""
    env = F.col(quoted(geometry))["env"]
    numbered = df.where(env.isNotNull()).withColumns({f"_id{suffix}": F.monotonically_increasing_id(), f"_level{suffix}": _level(env, cell)})
    return written(numbered, "spatial-side")


def _shapes(kept: DataFrame, geometry: str, suffix: str) -> DataFrame:
    """One row a distinct shape, written: named by its smallest row, with its level and how many rows have it."""
    name, level = f"_id{suffix}", f"_level{suffix}"
    grouped = kept.groupBy(F.col(quoted(geometry))).agg(F.min(name).alias(name), F.first(level).alias(level), F.count(F.lit(1)).alias(f"_rows{suffix}"))
    return written(grouped, "spatial-shapes")


def _dealt(rows: DataFrame, geometry: str, cell: float, levels: list[int], suffix: str) -> DataFrame:
    """(id, envelope, level, at, cell): a row for each cell that a shape covers, at most four a level.

    Pairs meet on the coarser of their levels, so a shape is dealt to the levels of the other side that are coarser than its own, and to its own
    where the other side has anything as fine.
    """
    level = F.col(f"_level{suffix}")
    env = F.col(quoted(geometry))["env"]
    others = F.array(*map(F.lit, levels))
    at = F.explode(F.array_distinct(F.transform(others, lambda k: F.greatest(k, level)))).alias(f"_at{suffix}")
    placed = rows.select(f"_id{suffix}", env.alias(f"_env{suffix}"), level, at)
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col(f"_at{suffix}"))
    return placed.withColumn(f"_cell{suffix}", F.explode(cells(F.col(f"_env{suffix}"), size)))


def join(left: DataFrame, right: DataFrame, left_geometry: str, right_geometry: str, cell: float, name: str = "intersects", mask: str | None = None) -> DataFrame:
    """Pairs of features in a relation, each once.

    ``cell`` is the size that most shapes fit; larger shapes are dealt by cells doubled until they fit, so no
    shape covers more than four cells a level.  A pair meets on the coarser of its two levels, and there only in the
    cell that holds the lower left corner of the overlap of its envelopes, so no pass over the result is
    needed to make pairs distinct.  Equal shapes are one until the end: cells carry numbers and envelopes of distinct
    shapes, and the relation is looked at once a pair of them.  Pairs of shapes then become pairs of rows: each side's
    rows of a shape stand in parts of at most PART rows, and a pair of parts is one piece of work, dealt over as many
    tasks as the result asks for, so neither a crowded cell nor a frequent shape lands in one task.
    """
    if name == "disjoint" or holds_apart(name, mask):
        raise PlanError("pairs of shapes apart from each other are a product and not joined")
    register(left.sparkSession)
    rows = _kept(left, left_geometry, cell, "_l"), _kept(right, right_geometry, cell, "_r")
    a, b = _shapes(rows[0], left_geometry, "_l"), _shapes(rows[1], right_geometry, "_r")
    used = [sorted(r[0] for r in side.select(f"_level{s}").distinct().collect()) for side, s in ((a, "_l"), (b, "_r"))]  # some tens of numbers at most
    dealt = _dealt(a, left_geometry, cell, used[1], "_l"), _dealt(b, right_geometry, cell, used[0], "_r")
    x, y = F.col("_env_l"), F.col("_env_r")
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_at_l"))
    corner = [F.floor(F.greatest(x[c], y[c]) / size).cast("long") for c in ("minx", "miny")]
    same = (F.col("_at_l") == F.col("_at_r")) & (F.col("_cell_l.x") == F.col("_cell_r.x")) & (F.col("_cell_l.y") == F.col("_cell_r.y"))
    owns = (F.col("_at_l") == F.greatest("_level_l", "_level_r")) & (F.col("_cell_l.x") == corner[0]) & (F.col("_cell_l.y") == corner[1])
    pairs = dealt[0].join(dealt[1], same & envelopes_meet(x, y) & owns).select("_id_l", "_id_r")
    met = pairs.join(a, "_id_l").join(b, "_id_r")
    if not (name == "envelope" and mask is None):
        met = met.where(relation(F.col(quoted(left_geometry))["wkb"], F.col(quoted(right_geometry))["wkb"], name, mask))
    found = written(met.select("_id_l", "_id_r", "_rows_l", "_rows_r", F.col(quoted(left_geometry)).alias("_shape_l"), F.col(quoted(right_geometry)).alias("_shape_r")), "spatial-pairs")
    lists = _parts(rows[0], a, left_geometry, "_l"), _parts(rows[1], b, right_geometry, "_r")
    spread = _spread(found, *lists).select("_l", "_shape_l", "_shape_r", F.explode("_list_r").alias("_r"))
    of = lambda df, g, s: [(F.col(f"_shape{s}") if c == g else F.col(f"_{s[1]}.{quoted(c)}")).alias(c) for c in df.columns]
    return spread.select(*of(left, left_geometry, "_l"), *of(right, right_geometry, "_r"))


def _parts(kept: DataFrame, shapes: DataFrame, geometry: str, suffix: str) -> DataFrame:
    """(shape's id, part, list): the rows of a shape, without it, in lists of about PART at most."""
    shape, name = F.col(quoted(geometry)), f"_id{suffix}"
    held = [F.col(quoted(c)) for c in kept.columns if c not in (geometry, name, f"_level{suffix}")] or [F.col(name)]
    placed = kept.select(shape, F.struct(*held).alias("_held"), F.xxhash64(name).alias("_hash")).join(shapes.select(shape, name, f"_rows{suffix}"), geometry)
    part = F.expr(f"pmod(_hash, (_rows{suffix} - 1) div {PART} + 1)").alias(f"_part{suffix}")
    return placed.groupBy(name, part).agg(F.collect_list("_held").alias(f"_list{suffix}"))


def _spread(found: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of the left side, each with a list of rows that it pairs with, in tasks of some TASK pairs each."""
    total = found.agg(F.coalesce(F.sum(F.col("_rows_l") * F.col("_rows_r")), F.lit(0))).first()[0]
    tasks = int(max(1, min(MOST_TASKS, total // TASK + 1)))
    parts = lambda s: F.explode(F.expr(f"sequence(0L, (_rows{s} - 1) div {PART})")).alias(f"_part{s}")
    work = found.select("_id_l", "_id_r", "_shape_l", "_shape_r", "_rows_r", parts("_l")).select("_id_l", "_id_r", "_shape_l", "_shape_r", "_part_l", parts("_r"))
    filled = work.join(left, ["_id_l", "_part_l"]).join(right, ["_id_r", "_part_r"])
    even = filled.repartition(tasks, F.xxhash64("_id_l", "_part_l", "_id_r", "_part_r"))
    return even.select(F.explode("_list_l").alias("_l"), "_list_r", "_shape_l", "_shape_r")
