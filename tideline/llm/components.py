"""Connected components of a graph of any size, as joins and aggregates over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for each end of the edges (a, b), label being the least node that it can reach.

    Each round takes the least label among neighbours, then the label of that label, so rounds grow with the logarithm
    of a path's length in most graphs. Each round is a table; nothing is collected but the number of changes.
    """
    both = scratch.table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = scratch.table(labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "step")
        hop = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = scratch.table(step.join(hop, "label", "left").select("node", "old", F.least("label", "further").alias("label")), "labels")
        changed = new.where("label <> old").limit(1).count()
        scratch.drop(labels)
        scratch.drop(step)
        labels = new
        if not changed:
            return labels.select("node", "label")
