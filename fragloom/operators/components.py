"""Connected components of an edge table of any size, as tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, discard


def components(edges: DataFrame, most_rounds: int = 80) -> DataFrame:
    """(node, label): the least node that each node of ``edges`` (a, b: longs) is linked with.

    Each round, a node takes the least label among its own and its neighbours', then that label's own label, which doubles the distance that a label
    travels; every round ends in a written table.  Loops, repeats and either direction are allowed; no edges, no nodes.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    for _ in range(most_rounds):
        offered = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer"))
        taken = labels.join(offered, "node").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("now"))
        further = labels.select(F.col("node").alias("now"), F.col("label").alias("jump"))
        after = cut(taken.join(further, "now", "left").select("node", "old", F.least(F.col("now"), F.coalesce("jump", "now")).alias("label")), "labels")
        discard(labels)
        still = after.filter("old <> label").limit(1).count()
        labels = after.select("node", "label")
        labels.cut_at = after.cut_at
        if not still:
            discard(both)
            return labels
    raise RuntimeError(f"labels still move after {most_rounds} rounds")
