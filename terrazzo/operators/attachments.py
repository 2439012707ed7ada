"""Attachments: a table (dataset, feature_id, attachment_id, name, content_type, content), ids from 1 for each feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "dataset string, feature_id string, attachment_id long, name string, content_type string, content binary"
KEYS = ["dataset", "feature_id"]


def listed(table: DataFrame, dataset: str, feature_id: str) -> DataFrame:
    """What a feature has, without the bytes: the content column stays unread."""
    rows = table.where((F.col("dataset") == dataset) & (F.col("feature_id") == feature_id))
    return rows.select("attachment_id", "name", "content_type", F.octet_length("content").alias("size"))


def add(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The next snapshot: new rows (all columns but the id) get ids after their feature's largest."""
    last = table.groupBy(*KEYS).agg(F.max("attachment_id").alias("_last"))
    place = F.row_number().over(W.partitionBy(*KEYS).orderBy("name", "content_type"))
    fresh = rows.join(last, KEYS, "left").withColumn("attachment_id", F.coalesce("_last", F.lit(0).cast("long")) + place).select(table.columns)
    return table.unionByName(fresh)


def get(table: DataFrame, dataset: str, feature_id: str, attachment_id: int) -> DataFrame:
    return table.where((F.col("dataset") == dataset) & (F.col("feature_id") == feature_id) & (F.col("attachment_id") == attachment_id))


def update(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The next snapshot with rows replaced by key; rows without a counterpart change nothing."""
    keys = [*KEYS, "attachment_id"]
    known = rows.join(table.select(*keys), keys, "left_semi").select(table.columns)
    return table.join(known.select(*keys), keys, "left_anti").select(table.columns).unionByName(known)


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.select(*KEYS, "attachment_id").distinct(), [*KEYS, "attachment_id"], "left_anti").select(table.columns)
