"""Connected components of an edge table, by label passing with pointer jumping; tables only, nothing on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): for each node of ``edges`` (columns a, b) the smallest node it is linked with.

    Edges with equal ends, repeated edges and either direction are allowed; an empty table gives no nodes.  Each round takes
    a node's least neighbouring label and then that label's own label, so paths shorten by half or more.  Every round's table is written
    to the shared folder.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = keep(both, "edges")
    labels = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = step.join(jump, "label", "left").select("node", "old", F.least(F.col("label"), F.coalesce("further", "label")).alias("label"))
        moved = keep(moved, "labels")
        changed = moved.filter(F.col("old") != F.col("label")).limit(1).count()
        forget(labels)
        labels = moved.select("node", "label")
        labels.kept_at = moved.kept_at
        if not changed:
            break
    else:
        raise RuntimeError(f"labels still move after {rounds} rounds")
    forget(both)
    return labels
