"""Datasets by name over Spark's catalog: list, describe, create, append, scan."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.functions.crs import transform_geometry
from terrazzo.functions.geometry import encode
from terrazzo.model import Kind, PlanError
from terrazzo.plans.dataset import Dataset, kind_of, quoted, schema_extends
from terrazzo.sources.ingest import Decoded, agree, overfull, stopping


@dataclass(frozen=True)
class Description:
    name: str
    fields: tuple[tuple[str, Kind | None, bool], ...]
    geometry: str | None
    rows: int | None = None


class Store:
    """Tables of one database as datasets."""

    def __init__(self, spark: SparkSession, database: str = "default"):
        self.spark, self.database = spark, database

    def names(self, pattern: str | None = None) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database, pattern) if not t.isTemporary)

    def _table(self, name: str) -> str:
        return f"`{self.database}`.`{name.replace('`', '``')}`"

    def describe(self, name: str) -> Description:
        schema = self.scan(name).schema
        fields = tuple((f.name, kind_of(f), f.nullable) for f in schema.fields)
        return Description(name, fields, next((n for n, k, _ in fields if k is Kind.GEOMETRY), None))

    def create(self, name: str, sample: DataFrame) -> None:
        """A dataset with the sample's schema and rows."""
        if self.spark.catalog.tableExists(self._table(name)):
            raise PlanError(f"{name} exists already")
        sample.write.format("parquet").saveAsTable(self._table(name))

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows whose schema the dataset's is a prefix of."""
        if not schema_extends(rows.schema, self.scan(name).schema.fields):
            raise PlanError(f"the rows do not extend the schema of {name}")
        rows.select(self.scan(name).columns).write.insertInto(self._table(name))

    def written_beside(self, rows: DataFrame, name: str) -> str:
        """The next content of a dataset, written whole under a name of its own."""
        beside = f"{name}__{uuid.uuid4().hex}"
        rows.write.format("parquet").saveAsTable(self._table(beside))
        return beside

    def swap(self, name: str, beside: str) -> None:
        """Puts what was written beside a dataset in its place; until the two renames nothing of the dataset is touched."""
        before = f"{name}__{uuid.uuid4().hex}"
        self.spark.sql(f"ALTER TABLE {self._table(name)} RENAME TO {self._table(before)}")
        self.spark.sql(f"ALTER TABLE {self._table(beside)} RENAME TO {self._table(name)}")
        self.drop(before)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")

    def load(self, name: str, decoded: Decoded, most: int | None = None, target: int | None = None) -> DataFrame:
        """Creates a dataset from decoded features, in the system ``target`` where one is asked for; returns what was skipped.

        Features are decoded once: a task that meets more than ``most`` stops there, and where all tasks together wrote more, what they wrote goes again.
        """
        features = stopping(decoded.features, most) if most is not None else decoded.features
        if target is not None:
            at = features.columns[-1]
            source = int(agree(features.schema[at].metadata.get("crs"), None).rpartition(":")[2])
            moved = encode(transform_geometry(F.col(quoted(at))["wkb"], source, target))
            features = features.withColumn(at, moved.alias(at, metadata={"crs": f"EPSG:{target}"}))
        if most is None:
            self.create(name, features)
            return decoded.skipped
        if self.spark.catalog.tableExists(self._table(name)):
            raise PlanError(f"{name} exists already")
        try:
            beside = self.written_beside(features, name)
        except Exception as e:
            if f"more than {most} features" in str(e):
                raise PlanError(f"more than {most} features") from e
            raise
        try:
            overfull(self.scan(beside), most)
        except PlanError:
            self.drop(beside)
            raise
        self.spark.sql(f"ALTER TABLE {self._table(beside)} RENAME TO {self._table(name)}")
        return decoded.skipped

    def scan(self, name: str) -> DataFrame:
        return self.spark.table(self._table(name))

    def dataset(self, name: str, ids: tuple[str, ...] = (), ordinal: tuple[str, ...] = ()) -> Dataset:
        return Dataset(self.scan(name), ids, ordinal, name)
