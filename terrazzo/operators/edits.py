"""Edits as snapshot changes: outcomes per input, and the next snapshot, which a writer swaps in."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrazzo.model import PlanError, Predicate
from terrazzo.plans.compile import predicate
from terrazzo.plans.dataset import Dataset, quoted


def _known(ds: Dataset, rows: DataFrame) -> DataFrame:
    keys = ds.df.select(*[F.col(quoted(k)) for k in ds.ids]).distinct().withColumn("__there", F.lit(True))
    place = F.row_number().over(W.partitionBy(*ds.ids).orderBy("__at"))
    return rows.withColumn("__at", F.monotonically_increasing_id()).join(keys, list(ds.ids), "left").withColumn("__nth", place)


def add(ds: Dataset, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, snapshot): a key that is there already, or came earlier in the input, fails alone."""
    judged = _known(ds, rows).withColumn("ok", F.col("__there").isNull() & (F.col("__nth") == 1))
    outcomes = judged.select(*ds.ids, "ok", F.when(~F.col("ok"), "duplicate").alias("error"))
    return outcomes, ds.df.unionByName(judged.where("ok").select(*[quoted(c) for c in ds.fields]))


def update(ds: Dataset, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, snapshot): whole rows by key; an unknown key fails; the last of equal keys counts."""
    judged = _known(ds, rows)
    last = F.row_number().over(W.partitionBy(*ds.ids).orderBy(F.col("__at").desc()))
    outcomes = judged.select(*ds.ids, F.col("__there").isNotNull().alias("ok"), F.when(F.col("__there").isNull(), "missing").alias("error"))
    fresh = judged.where("__there").withColumn("__last", last).where("__last = 1").select(*[quoted(c) for c in ds.fields])
    return outcomes, ds.df.join(fresh.select(*ds.ids), list(ds.ids), "left_anti").select(*[quoted(c) for c in ds.fields]).unionByName(fresh)


def delete(ds: Dataset, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, snapshot) of a delete by key."""
    judged = _known(ds, keys)
    outcomes = judged.select(*ds.ids, (F.col("__there").isNotNull() & (F.col("__nth") == 1)).alias("ok"))
    return outcomes, ds.df.join(keys.select(*ds.ids).distinct(), list(ds.ids), "left_anti").select(*[quoted(c) for c in ds.fields])


def delete_where(ds: Dataset, where: Predicate) -> DataFrame:
    """The snapshot without the rows that match."""
    return ds.df.where(~F.coalesce(predicate(ds, where), F.lit(False)))


def apply_edits(ds: Dataset, adds: DataFrame | None = None, updates: DataFrame | None = None, deletes: DataFrame | None = None, rollback: bool = True) -> tuple[DataFrame, DataFrame]:
    """(outcomes, snapshot) of adds, then updates, then deletes by key; ``edit`` says which an outcome belongs to.

    With ``rollback`` one failure leaves the dataset as it was; else each edit counts for itself.
    """
    outcomes, now = None, ds
    for name, rows, step in (("add", adds, add), ("update", updates, update), ("delete", deletes, delete)):
        if rows is None:
            continue
        said, snapshot = step(now, rows)
        if name == "delete":
            said = said.withColumn("error", F.when(~F.col("ok"), "missing"))
        said = said.select(F.lit(name).alias("edit"), *ds.ids, "ok", "error")
        outcomes = said if outcomes is None else outcomes.unionByName(said)
        now = ds.with_df(snapshot)
    if outcomes is None:
        raise PlanError("no edits")
    failed = rollback and outcomes.where(~F.col("ok")).limit(1).count() > 0
    return outcomes, ds.df if failed else now.df


def content_version(df: DataFrame) -> str:
    """A token that changes with the rows, whatever their order: sums of row hashes, folded."""
    h = F.xxhash64(*[F.col(quoted(c)) for c in df.columns])
    n, low, high = df.agg(F.count(F.lit(1)), F.sum(F.pmod(h, F.lit(1 << 31))), F.sum(F.shiftrightunsigned(h, 31))).first()
    return hashlib.sha256(f"{df.schema.json()}|{n}|{low}|{high}".encode()).hexdigest()


class Transaction:
    """Snapshots by name, staged and then swapped together; rollback forgets them.

    Over a dict the tables are DataFrames of this session.  Over versioned datasets (``snapshots.Snapshots``) a commit is one step for all of
    them, and fails where somebody else has changed one meanwhile.  Over a store of catalog tables a staged snapshot is written beside the
    dataset, and a commit is two renames a dataset, one dataset after the other.
    """

    def __init__(self, tables):
        self.tables, self.staged = tables, {}
        self.versions = tables.begin() if hasattr(tables, "begin") else None
        self.stored = hasattr(tables, "written_beside")

    def stage(self, name: str, snapshot: DataFrame) -> None:
        if self.versions:
            self.versions.stage(name, snapshot)
            return
        if self.stored:
            if name in self.staged:
                self.tables.drop(self.staged.pop(name))
            snapshot = self.tables.written_beside(snapshot, name)
        self.staged[name] = snapshot

    def commit(self) -> None:
        if self.versions:
            self.versions.commit()
            self.versions = self.tables.begin()
        elif self.stored:
            for name in list(self.staged):
                self.tables.swap(name, self.staged.pop(name))
        else:
            self.tables.update(self.staged)
        self.staged = {}

    def rollback(self) -> None:
        if self.versions:
            self.versions.rollback()
            self.versions = self.tables.begin()
        elif self.stored:
            for beside in self.staged.values():
                self.tables.drop(beside)
        self.staged = {}


def relate(table: DataFrame, key: str, pairs: DataFrame, column: str) -> DataFrame:
    """The next snapshot with ``column`` set for the keys in ``pairs`` (key, value); a null value unrelates."""
    given = pairs.select(F.col(quoted(key)).alias(key), F.col("value").alias("__value"), F.lit(True).alias("__set"))
    joined = table.join(given, key, "left")
    changed = F.when(F.col("__set"), F.col("__value").cast(table.schema[column].dataType)).otherwise(F.col(quoted(column)))
    return joined.withColumn(column, changed).select(*[quoted(c) for c in table.columns])


def link(joins: DataFrame, pairs: DataFrame) -> DataFrame:
    """A join set with pairs added, each once."""
    return joins.unionByName(pairs.select(joins.columns)).distinct()


def unlink(joins: DataFrame, pairs: DataFrame) -> DataFrame:
    return joins.join(pairs.select(joins.columns).distinct(), joins.columns, "left_anti")
