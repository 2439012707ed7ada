"""Contiguous byte-balanced shards from global prefix sums.

Rows are ranged by (doc_id, checksum, size), the order that the prefix sums run
in; only ids, sizes and checksums move, never texts.  The ranged rows are
written once, so partition totals and rows agree on the partition of every row
even if an executor is lost.  Totals of the partitions (one row each) give every
partition its offset; a running sum inside the partition does the rest.

Defined results: null text has no bytes and size 1; empty tables give no rows;
repeated rows are placed one by one; a row stands in the shard that its middle
byte falls in, so shards differ from the target by at most one row's size; a text of
any length counts whole and is not split; rows with a null doc_id come first; equal rows
have some order among themselves; only doc_id and text are read, whatever other columns
are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrazzo.llm.storage import written


def ranged(docs: DataFrame) -> DataFrame:
    """(part, doc_id, size, text_crc32, tie), written: the order and partition of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),  # keeps equal rows apart, so that a hot id can be cut
    )
    order = ["doc_id", "text_crc32", "size", "tie"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.withColumn("part", F.spark_partition_id()), "shard-rows")


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (place inside the shard) of every row."""
    rows = ranged(docs)
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(W.partitionBy()).alias("total"),
    )
    inside = W.partitionBy("part").orderBy("doc_id", "text_crc32", "size", "tie").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        rows.withColumns({"_bytes": F.sum("size").over(inside), "_row": F.row_number().over(W.partitionBy("part").orderBy("doc_id", "text_crc32", "size", "tie"))})
        .join(F.broadcast(offsets), "part")  # as many rows as the ranging has partitions
        .withColumn("_end", F.col("bytes_before") + F.col("_bytes"))
        .withColumn("_at", F.col("rows_before") + F.col("_row") - 1)
        # (2 * end - size) / 2 is the row's middle; integers stay exact up to 2^58 bytes over the shard count
        .withColumn("shard", F.expr(f"cast(((2 * _end - size) * {int(shards)}L) div (2 * total) as int)"))
    )
    first = placed.groupBy("shard").agg(F.min("_at").alias("_first"))  # at most `shards` rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_at") - F.col("_first")).alias("slot"))
