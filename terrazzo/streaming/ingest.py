"""Incremental ingest: a file stream decoded by the schema of a first look.

``load`` keeps what it decodes: features in one table, records that are none in another, both a folder a micro-batch.
A feature without an id gets its place among all features of the stream, from 1.  A batch counts once its entry stands in the
ledger, with the number of features up to it; a batch that runs again after a stop starts from the entry before it and
writes its folders anew, or finds its own entry and does nothing.  So ids are given once, whatever stops in between.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from terrazzo.plans.dataset import quoted
from terrazzo.session import listed, put_text
from terrazzo.sources import ingest


def infer(spark: SparkSession, path: str, records: int = 1000) -> dict[str, str]:
    """Property types from the first records of NDJSON files; this look is bounded, the stream is not."""
    return ingest.property_kinds(spark.read.schema("properties string").json(path).limit(records))


def stream(spark: SparkSession, path: str, kinds: dict[str, str], crs: str = "EPSG:4326", files: int | None = None) -> DataFrame:
    """Features of new NDJSON files: typed properties, geometry, and ``reason``, set where a record cannot be a feature of this schema."""
    reader = spark.readStream.option("maxFilesPerTrigger", files) if files else spark.readStream
    raw = reader.schema("type string, id string, crs string, properties string, geometry string, bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="bad")
    judged = ingest.judged_json(raw, ingest.crs_name(crs))
    known = F.array(*[F.lit(n) for n in kinds]) if kinds else F.array().cast("array<string>")
    extra = F.size(F.array_except(F.coalesce(F.json_object_keys("properties"), F.array().cast("array<string>")), known)) > 0
    reason = F.coalesce("reason", F.when(extra, ingest.FIELD_NOT_INFERRED))
    return judged.select(F.col("id").alias("feature_id"), *ingest.property_columns(dict(sorted(kinds.items()))), F.col("shape").alias("geometry"), reason.alias("reason"))


def accepted(features: DataFrame) -> DataFrame:
    """The features that fit the schema; the others are for the report."""
    return features.where("reason is null").drop("reason")


def rejected(features: DataFrame) -> DataFrame:
    return features.where("reason is not null").select("feature_id", "reason")


def _ledger(spark: SparkSession, target: str) -> dict[int, int]:
    """The last batch that counts, with the number of features up to it."""
    done = [int(n[:-5]) for n in listed(spark, f"{target}/ledger") if n.endswith(".json") and n[:-5].isdigit()]
    if not done:
        return {}
    last = max(done)
    return {last: json.loads(spark.read.text(f"{target}/ledger/{last:012d}.json").first()[0])["features"]}


def keep(batch: DataFrame, number: int, target: str) -> None:
    """One micro-batch into its folders, and into the ledger."""
    spark = batch.sparkSession
    ((last, before),) = (_ledger(spark, target) or {-1: 0}).items()
    if last >= number:
        return
    judged = batch.persist()
    try:
        numbered = ingest.with_ordinal(accepted(judged), "__place")
        own = F.when(F.col("feature_id") != "", F.col("feature_id"))
        rows = numbered.withColumn("feature_id", F.coalesce(own, (F.col("__place") + before).cast("string"))).drop("__place")
        rows.write.mode("overwrite").parquet(f"{target}/features/batch={number}")
        rejected(judged).write.mode("overwrite").parquet(f"{target}/skipped/batch={number}")
    finally:
        judged.unpersist()
    count = spark.read.parquet(f"{target}/features/batch={number}").count()
    put_text(spark, f"{target}/ledger/{number:012d}.json", json.dumps({"features": before + count}))


def load(spark: SparkSession, source: str, target: str, kinds: dict[str, str], crs: str = "EPSG:4326", files: int | None = None, **trigger) -> StreamingQuery:
    """Starts to keep the features of new files in ``source``; the stream goes on where it stopped.  ``files``: of a batch at most."""
    target = target.rstrip("/")
    writer = stream(spark, source, kinds, crs, files).writeStream.foreachBatch(lambda batch, number: keep(batch, number, target))
    return writer.option("checkpointLocation", f"{target}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def loaded(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """(features, skipped records) of the batches that count."""
    target = target.rstrip("/")
    done = _ledger(spark, target)
    last = max(done, default=-1)
    tables = [spark.read.option("basePath", f"{target}/{n}").parquet(f"{target}/{n}").where(F.col("batch") <= last) for n in ("features", "skipped")]
    return tables[0].select(*[F.col(quoted(c)) for c in tables[0].columns if c != "batch"]), tables[1].drop("batch")
