"""The shared folder: tables that cut lineage and survive lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.session import shared_path

#: Spark deletes an execution's shuffle files when it ends; they could only serve the same DataFrame again.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted as soon as it ends."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: computed once, lineage cut."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def written_by(df: DataFrame, key: str, label: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``key``: joins and groups by it need no shuffle of this side."""
    spark, path, name = df.sparkSession, shared_path(df.sparkSession, label), f"terrazzo_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with freed_shuffles(spark):
        df.write.bucketBy(parts, key).option("compression", compression).option("path", path).saveAsTable(name)
    table = spark.table(name)
    table._written_at, table._named = path, name
    return table


def unbucketed(table: DataFrame) -> DataFrame:
    """A bucketed table as plain files, which Spark deals anew: for joins whose other side is skewed."""
    return table.sparkSession.read.schema(table.schema).parquet(table._written_at)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` or ``written_by`` made, after their last reader has ended."""
    for table in tables:
        if hasattr(table, "_named"):
            table.sparkSession.sql(f"DROP TABLE {table._named}")
        delete(table.sparkSession, table._written_at)


class Bitmap:
    """Which remainders some 64-bit numbers leave modulo a power of two: a superset test of fixed size, 64 MB at most."""

    def __init__(self, numbers: DataFrame, column: str):
        count = numbers.count()
        self.bits = min(29, max(20, (8 * count).bit_length()))
        at = F.expr(f"`{column}` & {(1 << self.bits) - 1}L")
        parts = numbers.where(F.col(column).isNotNull()).groupBy(F.shiftright(at, 15).cast("int").alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(32767)).alias("set"))
        self.set = np.zeros(1 << (self.bits - 3), dtype=np.uint8)
        for r in parts.toLocalIterator():
            self.set[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(r["set"], dtype=np.uint8)

    def may_hold(self, numbers: np.ndarray) -> np.ndarray:
        at = numbers.astype(np.int64) & np.int64((1 << self.bits) - 1)
        return (self.set[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


class Segments:
    """The bitmap of some keys as a table of rows of 4 KB, for tests in Spark expressions.

    It has some sixteen bits a key, and at most 2048 rows, so it may be broadcast whatever the number of keys: beyond some
    millions it only lets more rows through.
    """

    def __init__(self, keys: DataFrame, column: str):
        self.bits = min(26, max(15, (16 * keys.count()).bit_length()))
        segment, bit = self._place(F.col(column))
        self.table = written(keys.where(F.col(column).isNotNull()).groupBy(segment.alias("segment")).agg(F.bitmap_construct_agg(bit).alias("bits")), "segments")

    def _place(self, key: Column) -> tuple[Column, Column]:
        at = F.xxhash64(key).bitwiseAND(F.lit((1 << self.bits) - 1))
        return F.shiftright(at, 15).cast("int"), at.bitwiseAND(F.lit(32767))

    def marked(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """``df`` with the column ``name``: false only where the key is none of those held."""
        segment, bit = self._place(key)
        at, bits = unused(df, "segment"), unused(df, "bits")
        held = F.broadcast(self.table.select(F.col("segment").alias(at), F.col("bits").alias(bits)))
        joined = df.withColumn(name, bit).join(held, segment == F.col(at), "left")
        byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(name, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        test = F.coalesce(F.getbit(byte, F.col(name).bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
        return joined.withColumn(name, test).drop(at, bits)
