"""Select, order, page, project; count, distinct, grouped reductions.  All lazy but page facts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrazzo.model import AggregateQuery, AggregateSpec, FeatureQuery, Kind, Page, PlanError
from terrazzo.plans import compile as compiling
from terrazzo.plans import validate
from terrazzo.plans.dataset import ID, Dataset, quoted
from terrazzo.plans.parse import render
from terrazzo.session import drop, written

#: The accuracy of the percentile sketch: rank errors are at most one part in this many.
SKETCH = 10000
#: Parts that a round cuts a percentile's bracket into, and distinct values that a bracket may hold in the end.
CUTS, INSIDE = 256, 1 << 16
#: Inputs of at most this many bytes, by Catalyst's own estimate, have their percentiles in one aggregate with the other statistics.
IN_MEMORY = 1 << 29
#: Up to this many ids are a literal list; more become a semi-join.
LITERAL_IDS = 1000


def box_filter(ds: Dataset, box) -> Column:
    """Closed overlap of any geometry's envelope; plain double comparisons, which Parquet statistics prune."""
    tests = []
    for g in ds.geometries:
        env = F.col(quoted(g))["env"]
        tests.append((env["minx"] <= box.maxx) & (env["maxx"] >= box.minx) & (env["miny"] <= box.maxy) & (env["maxy"] >= box.miny))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False)) if len(tests) > 1 else out


def select(ds: Dataset, q: FeatureQuery) -> Dataset:
    """The rows that ids, predicate and box admit."""
    validate.feature_query(ds, q)
    df = ds.df
    if q.where is not None:
        df = df.where(compiling.predicate(ds, q.where))
    if q.box is not None:
        df = df.where(box_filter(ds, q.box))
    if q.ids is not None:
        wanted = sorted({str(i) for i in q.ids})
        if len(wanted) <= LITERAL_IDS:
            df = df.where(ds.lookup(wanted) if wanted else F.lit(False))
        else:
            keys = df.sparkSession.createDataFrame([(i,) for i in wanted], f"{ID} string")
            df = df.withColumn(ID, ds.feature_id()).join(keys, ID, "left_semi").drop(ID)
    return ds.with_df(df)


def ordered(ds: Dataset, q: FeatureQuery, tie_by_id: bool = True) -> list[Column]:
    """Sort keys: the plan's, then the id as text, then the store order; without an order the store order alone."""
    keys = compiling.order_keys(ds, q.order)
    if keys and tie_by_id and ds.ids:
        keys.append(ds.feature_id().asc())
    return keys + [o.asc_nulls_last() for o in ds.ordinals()]


def project(ds: Dataset, df: DataFrame, projection) -> DataFrame:
    names = [f for f in projection if f != "*"] if projection else None
    columns = names if names else ds.fields
    return df.select(ds.feature_id().alias(ID), *[F.col(quoted(c)) for c in columns])


def digest(q: FeatureQuery) -> str:
    """What a cursor belongs to: everything but where its page starts, the predicate included."""
    plan = [sorted(map(str, q.ids)) if q.ids is not None else None, render(q.where) if q.where else None, vars(q.box) if q.box else None, q.projection, [(t.field, t.descending) for t in q.order], q.limit]
    return hashlib.sha256(json.dumps(plan, default=list).encode()).hexdigest()[:16]


def cursor_for(q: FeatureQuery, start: int) -> str:
    return f"v1.{start}.{digest(q)}"


def start_of(q: FeatureQuery) -> int:
    if q.cursor is None:
        return q.offset or 0
    parts = q.cursor.split(".")
    if len(parts) != 3 or parts[0] != "v1" or not parts[1].isdecimal():
        raise PlanError("cursor: malformed")
    if parts[2] != digest(q):
        raise PlanError("cursor: issued for another plan")
    return int(parts[1])


def features(ds: Dataset, q: FeatureQuery, tie_by_id: bool = True) -> DataFrame:
    """The page's rows, lazily."""
    return finish(select(ds, q), q, tie_by_id)


def finish(chosen: Dataset, q: FeatureQuery, tie_by_id: bool = True) -> DataFrame:
    """The shaping half, over rows that are selected already: order, offset and limit plan as a top-k, then the projection."""
    start, df = start_of(q), chosen.df
    if q.order or q.limit is not None or start:
        keys = ordered(chosen, q, tie_by_id)
        df = df.orderBy(*keys) if keys else df
    if start:
        df = df.offset(start)
    if q.limit is not None:
        df = df.limit(q.limit)
    return project(chosen, df, q.projection)


def page(ds: Dataset, q: FeatureQuery) -> Page:
    """A page with total, whether more follow, and the next cursor; counts once."""
    total, start = count(ds, q), start_of(q)
    taken = max(0, min(q.limit if q.limit is not None else total, total - start))
    more = start + taken < total
    return Page(features(ds, q), cursor_for(q, start + taken) if more else None, total, more)


def batches(rows: DataFrame, size: int = 512) -> Iterator[list[Row]]:
    """Rows in lists of ``size``, partition by partition: the driver holds one partition at most."""
    held: list[Row] = []
    for row in rows.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def count(ds: Dataset, q: FeatureQuery) -> int:
    return select(ds, q).df.count()


def _sorted_page(df: DataFrame, keys: list[Column], limit: int | None, offset: int | None) -> DataFrame:
    df = df.orderBy(*keys)
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit is not None else df


def distinct(ds: Dataset, q: FeatureQuery, fields: tuple[str, ...]) -> DataFrame:
    """Distinct combinations (null is a value): in plan order if it covers the fields, else first seen."""
    if not fields:
        raise PlanError("fields: at least one field is needed")
    for f in fields:
        ds.kind(f)
    chosen = select(ds, q)
    first = F.min(F.struct(*chosen.ordinals())).alias("__first") if chosen.ordinals() else F.lit(0).alias("__first")
    groups = chosen.df.groupBy(*[F.col(quoted(f)) for f in fields]).agg(first)
    covered = {t.field for t in q.order} == set(fields)
    keys = compiling.order_keys(ds, q.order) if covered else [F.col("__first")]
    return _sorted_page(groups, keys, q.limit, start_of(q)).select(*[F.col(quoted(f)) for f in fields])


def statistic(ds: Dataset, s: AggregateSpec) -> Column:
    """One statistic as an aggregate column of the contract's result kind."""
    if s.field == "*":
        return F.count(F.lit(1)).alias(s.name)
    c, kind = F.col(quoted(s.field)), ds.kind(s.field)
    if s.statistic == "count":
        return F.nullif(F.count(c), F.lit(0).cast("long")).alias(s.name)
    if s.statistic == "sum":
        return F.sum(c if kind is Kind.INT64 else c.cast("double")).alias(s.name)
    if s.statistic in ("min", "max"):
        return (F.min(c) if s.statistic == "min" else F.max(c)).alias(s.name)
    if s.statistic == "envelope":
        env = c["env"]
        box = F.struct(F.min(env["minx"]).alias("minx"), F.min(env["miny"]).alias("miny"), F.max(env["maxx"]).alias("maxx"), F.max(env["maxy"]).alias("maxy"))
        return F.when(F.count(env["minx"]) > 0, box).alias(s.name)
    v = c.cast("double")
    if s.statistic == "avg":
        return F.avg(v).alias(s.name)
    if s.statistic == "var":
        return F.var_samp(v).alias(s.name)
    if s.statistic == "stddev":
        return F.stddev_samp(v).alias(s.name)
    direction = " DESC" if s.descending else ""
    return F.expr(f"{s.statistic}({float(s.fraction)!r}D) WITHIN GROUP (ORDER BY cast({quoted(s.field)} AS double){direction})").cast("double").alias(s.name)


def _bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the rows' size, from file sizes; filters do not lower it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _target(s: AggregateSpec, n: Column) -> tuple[Column, Column, Column]:
    """(rank below, rank above, how far between them) of a percentile of ``n`` values, ranks from 0."""
    if s.statistic == "percentile_cont":
        at = F.lit(float(s.fraction)) * (n - 1)
        return F.floor(at), F.ceil(at), at - F.floor(at)
    rank = F.greatest(F.ceil(F.lit(float(s.fraction)) * n) - 1, F.lit(0).cast("long"))
    return rank, rank, F.lit(0.0)


def brackets(values: DataFrame, names: list[str], specs: list[AggregateSpec], field: list[int], inside: int) -> DataFrame:
    """For each group and spec (``s``) the ranks wanted and a bracket (low, high; null is open) that holds them among at most ``inside`` distinct values, or so many values in all.

    A round reads the values once: it counts what lies below each bracket, and a bounded sketch cuts what lies inside into CUTS parts, of which a few
    about the ranks are the next bracket.  All groups, fields and ranks share the rounds.  Their number is that of the digits of the
    largest group in base CUTS / 4; the driver sees one number a round.
    """
    totals = values.groupBy(*names, "f").agg(F.count("*").alias("n"))
    wanted = []
    for k, s in enumerate(specs):
        under, over, part = _target(s, F.col("n"))
        wanted.append(F.struct(F.lit(k).alias("s"), F.lit(field[k]).alias("of"), under.cast("long").alias("under"), over.cast("long").alias("over"), part.alias("part")))
    bounds = [F.lit(None).cast("double").alias(c) for c in ("low", "high")]
    state = held_at = written(totals.select(*names, "f", "n", F.inline(F.array(*wanted))).where("f = of").drop("of").select("*", *bounds), "ranks-state")
    inner = (F.col("low").isNull() | (F.col("v") >= F.col("low"))) & (F.col("high").isNull() | (F.col("v") <= F.col("high")))
    held = F.when(inner, F.col("v"))
    fractions = [k / CUTS for k in range(CUTS + 1)]
    rest = ["n", "under", "over", "part", "low", "high"]
    while True:
        measured = written(
            _same_groups(values, state, [*names, "f"])
            .groupBy(*names, "f", "s")
            .agg(
                *[F.first(c).alias(c) for c in rest],
                F.count_if(F.col("v") < F.col("low")).alias("below"),
                F.count(held).alias("m"),
                F.approx_count_distinct(held).alias("d"),
                F.percentile_approx(held, fractions, SKETCH).alias("cuts"),
            ),
            "ranks-state",
        )
        drop(held_at)
        held_at = measured
        if (measured.agg(F.max(F.least("m", "d"))).first()[0] or 0) <= inside:
            return measured.drop("cuts")
        first = F.floor((F.col("under") - F.col("below")) / F.col("m") * CUTS).cast("int") - 1
        last = F.ceil((F.col("over") - F.col("below") + 1) / F.col("m") * CUTS).cast("int") + 1
        low = F.when(first > 0, F.get("cuts", first)).otherwise(F.col("low"))
        high = F.when(last < CUTS, F.get("cuts", last)).otherwise(F.col("high"))
        state = measured.select(*names, "f", "n", "s", "under", "over", "part", low.alias("low"), high.alias("high"))


def percentiles(df: DataFrame, group_by: tuple[str, ...], specs: list[AggregateSpec], inside: int = INSIDE) -> DataFrame:
    """The groups' exact percentiles, all fields and ranks together: brackets about the ranks are narrowed until they hold few values, and only those are sorted.

    What is smaller than a bracket is counted, what lies inside is summed up by value and ranked, some ``inside`` distinct values at
    most, whatever the size of the group.  The values are written once.
    """
    keys = [F.col(quoted(g)).alias(f"g{k}") for k, g in enumerate(group_by)]
    names = [f"g{k}" for k in range(len(group_by))]
    fields = list(dict.fromkeys((s.field, bool(s.descending)) for s in specs))
    field = [fields.index((s.field, bool(s.descending))) for s in specs]
    value = lambda name, down: -F.col(quoted(name)).cast("double") if down else F.col(quoted(name)).cast("double")
    every = F.array(*[F.struct(F.lit(k).alias("f"), value(*f).alias("v")) for k, f in enumerate(fields)])
    values = written(df.select(*keys, F.inline(every)).where("v is not null"), "ranks")
    found = brackets(values, names, specs, field, inside)
    near = _same_groups(values, found, [*names, "f"]).where((F.col("low").isNull() | (F.col("v") >= F.col("low"))) & (F.col("high").isNull() | (F.col("v") <= F.col("high"))))
    counted = near.groupBy(*names, "s", "v").agg(F.count("*").alias("c"), *[F.first(c).alias(c) for c in ("under", "over", "part", "below")])
    order = W.partitionBy(*names, "s").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.withColumn("last", F.col("below") + F.sum("c").over(order))
    holds = lambda rank: F.max(F.when((F.col("last") > F.col(rank)) & (F.col("last") - F.col("c") <= F.col(rank)), F.col("v")))
    ends = ranked.groupBy(*names, "s").agg(holds("under").alias("a"), holds("over").alias("b"), F.first("part").alias("part"))
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part"))
    said = lambda k, s: F.max(F.when(F.col("s") == k, -between if s.descending else between)).alias(f"p{k}")
    return ends.groupBy(*names).agg(*[said(k, s) for k, s in enumerate(specs)])


def _same_groups(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """``a`` beside ``b`` where all group columns are equal, null being a value; without group columns ``b`` is one row."""
    if not names:
        return a.crossJoin(F.broadcast(b))  # b is one row
    renamed = b.select([F.col(c).alias(f"{c}_") if c in names else F.col(c) for c in b.columns])
    test = F.lit(True)
    for c in names:
        test = test & F.col(c).eqNullSafe(F.col(f"{c}_"))
    met = a.join(renamed, test, how)
    rest = [c for c in (*a.columns, *b.columns) if c not in names]
    return met.select(*[F.coalesce(c, f"{c}_").alias(c) if how == "full" else F.col(c) for c in names], *rest)


def aggregate(ds: Dataset, q: FeatureQuery, a: AggregateQuery, in_memory: int = IN_MEMORY) -> DataFrame:
    """Groups in first-seen order unless an order is given; HAVING, then the group page.

    Percentiles of inputs beyond ``in_memory`` bytes are ranked by narrowing brackets, with the same results.
    """
    validate.aggregate_query(ds, a)
    chosen = select(ds, q)
    ranks = [s for s in a.specs if s.statistic.startswith("percentile")]
    if ranks and _bytes(chosen.df) <= in_memory:
        ranks = []  # the aggregate keeps a group's distinct values, which is no more than all there is
    specs = [statistic(chosen, s) for s in a.specs if s not in ranks]
    if not a.group_by:
        out = chosen.df.agg(*specs, F.lit(0).alias("__first"))
    else:
        first = F.min(F.struct(*chosen.ordinals())) if chosen.ordinals() else F.lit(0)
        out = chosen.df.groupBy(*[F.col(quoted(g)) for g in a.group_by]).agg(*specs, first.alias("__first"))
    if ranks:
        found = percentiles(chosen.df, a.group_by, ranks)
        for k, g in enumerate(a.group_by):
            found = found.withColumnRenamed(f"g{k}", f"__g{k}")
        test = F.lit(True)
        for k, g in enumerate(a.group_by):
            test = test & F.col(quoted(g)).eqNullSafe(F.col(f"__g{k}"))
        found = out.join(found if a.group_by else F.broadcast(found), test, "left")
        out = found.select(*[F.col(quoted(g)) for g in a.group_by], *[F.col(f"p{ranks.index(s)}").alias(s.name) if s in ranks else F.col(quoted(s.name)) for s in a.specs], "__first")
    groups = Dataset(out, name="groups")
    if a.having is not None:
        out = out.where(compiling.predicate(groups, a.having))
    if a.group_by and (a.order or a.limit is not None or a.offset):
        out = _sorted_page(out, compiling.order_keys(groups, a.order) + [F.col("__first")], a.limit, a.offset)
    return out.drop("__first")


def group_page(ds: Dataset, q: FeatureQuery, a: AggregateQuery) -> Page:
    """A page of groups with their total (grouped requests only)."""
    rows = aggregate(ds, q, a)
    if not a.group_by:
        return Page(rows)
    whole = AggregateQuery(a.specs, a.group_by, a.having)
    total = aggregate(ds, q, whole).count()
    end = (a.offset or 0) + (a.limit if a.limit is not None else total)
    return Page(rows, None, total, end < total)
