"""The corpus pipeline: quality rules, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``:

1. quality: documents that a rule rejects go;
2. near_duplicates: of each class of near copies the smallest doc_id stays;
3. decontamination: documents that contain a benchmark item go;
4. secrets: secrets are replaced by a mark, the document stays;
5. tokens: byte-level BPE ids, checked by decoding.

Defined results: a null text is empty, and the quality rules reject it; an empty table
passes through all stages; of repeated rows one stays, by the second stage; rows with a
null doc_id are judged by their texts and stay apart from each other unless they are near
copies; texts of any length are read whole in every stage; extra columns pass through the
first four stages, whatever they are called, and the last returns the columns of its own.

SQL cannot express the fourth and fifth stage, so ORACLE_SQL is None; the tests
hold the pipeline against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrazzo.llm import bpe, decontam, ngramjoin, quality, secretscan
from terrazzo.llm.storage import written
from terrazzo.session import ship

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngramjoin.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secretscan.redact(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("byte_bpe", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {}
