"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of the edges (a long, b long) can reach.

    Each round a node takes the least label among its own and its neighbours', and then its label's label,
    so paths halve; it ends when a round changes nothing. Hubs are summed before their shuffle. Every round
    is a table in the shared folder. Self-loops make nodes of their own; no edges, no rows."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("step"))
        jump = labels.select(F.col("node").alias("step"), F.col("label").alias("jump"))
        found = stored(stepped.join(jump, "step").select("node", F.least("step", "jump").alias("new"), "label"), "labels")
        labels = found.select("node", F.col("new").alias("label"))
        if found.where(F.col("new") != F.col("label")).limit(1).count() == 0:
            return labels
