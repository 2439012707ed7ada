"""Connected components of an edge table, by label passing with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.llm.storage import drop, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the component's smallest node.

    Each round takes the smallest label among neighbours, then jumps to that label's own label, so
    paths shorten geometrically; it ends with the first round that changes nothing.  A round's table is
    written and the one before deleted; the driver sees one count a round.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    rounds = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "cc-labels")
    while True:
        labels = rounds.select("node", "label")
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = written(stepped.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "cc-labels")
        drop(rounds)
        rounds = moved
        if not moved.where("label <> old").limit(1).count():
            drop(both)
            return moved.select("node", "label")
