"""Running sums, counts and extremes over tables that are dealt out in ranges, so that one group's rows are spread over many tasks.

Rows are put in ranges of (group, order) and written.  Each range adds up for itself; a table with a row for each range and group gives what all ranges before it hold; both together are
the running value.  No task sees more than a range, and the small table grows with the number of ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import cut

HOW = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest), "min": (F.min, F.least)}


@dataclass
class Ranged:
    """``rows`` with range_, the number of a row's range; ranges ascend in (``by``, ``order``)."""

    rows: DataFrame
    by: list[str]
    order: list[Column]

    def running(self, name: str, how: str, value: Column, inclusive: bool = False) -> "Ranged":
        """With the column ``name``: the ``sum``, ``max`` or ``min`` of ``value`` over the rows of its group before each row, itself too if ``inclusive``.

        Without a row before it a sum is 0 and an extreme null.  ``order`` must tell the rows of a group apart.
        """
        add, both = HOW[how]
        within = Window.partitionBy(*self.by, "range_").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        each = self.rows.groupBy(*self.by, "range_").agg(add(value).alias("total_"))
        earlier = Window.partitionBy(*self.by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
        carried = each.withColumn("carried_", add("total_").over(earlier)).drop("total_")
        named = carried.select(*[F.col(c).alias(f"{c}__") for c in [*self.by, "range_"]], "carried_")
        on = [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in [*self.by, "range_"]]
        rows = self.rows.withColumn("own_", add(value).over(within)).join(named, on).withColumn(name, both(F.col("own_"), F.col("carried_")))
        return Ranged(rows.drop("own_", "carried_", *[f"{c}__" for c in [*self.by, "range_"]]), self.by, self.order)

    def written(self, label: str) -> "Ranged":
        """The same, written, for a further running value of what this one gave."""
        return Ranged(cut(self.rows, label), self.by, self.order)

    def plain(self) -> DataFrame:
        return self.rows.drop("range_")


def ranged(rows: DataFrame, by: list[str], order: list[Column], label: str = "ranges") -> Ranged:
    """``rows`` written in ranges of (``by``, ``order``): columns of names, then sort orders."""
    dealt = rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("range_", F.spark_partition_id())
    return Ranged(cut(dealt, label), by, order)


def islands(rows: DataFrame, by: list[str], start: Column, end: Column, ties: list[Column]) -> DataFrame:
    """``rows`` with island: the number, within ``by``, of the run of intervals that no gap divides; intervals of different islands don't overlap.

    ``ties`` tell apart rows of a group with one start.
    """
    marked = ranged(rows.withColumns({"from_": start, "to_": end}), by, [F.col("from_"), F.col("to_"), *ties], "islands")
    reached = marked.running("reach_", "max", F.col("to_"))
    opens = (F.col("reach_").isNull() | (F.col("from_") >= F.col("reach_"))).cast("int")
    flagged = Ranged(reached.rows.withColumn("opens_", opens), by, reached.order).written("islands")
    return flagged.running("island", "sum", F.col("opens_"), inclusive=True).plain().drop("from_", "to_", "reach_", "opens_")


def share_reaching(rows: DataFrame, null: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """``rows`` (``key``, score and others) with share: how much of the ``null`` (``key``, null_score) values of its key is not below its score (``strict``: is above it).

    Null values count as below everything, a null score as above everything; a key without null values gives a null share.  Scores and values are counted by value and
    ranked in one table of ranges, so neither side passes through the driver or one task, whatever there is of a key; both inputs are worked out once.
    """
    rows = cut(rows.withColumn("s_", F.coalesce(F.col("score").cast("double"), F.lit(float("inf"))) + 0.0), "scored")
    values = null.groupBy(F.col(key).alias("k_"), (F.coalesce(F.col("null_score").cast("double"), F.lit(float("-inf"))) + 0.0).alias("v_")).agg(F.count("*").alias("n_"))
    asked = rows.select(F.col(key).alias("k_"), F.col("s_").alias("v_")).distinct().withColumn("n_", F.lit(0).cast("bigint"))
    # Of what is equal to a score, a strict share counts nothing: it stands before the score then, else behind it.
    both = values.withColumn("side_", F.lit(1)).unionByName(asked.withColumn("side_", F.lit(2 if strict else 0)))
    ranks = ranged(both, ["k_"], [F.col("v_"), F.col("side_")], "ranks")
    total = ranks.rows.groupBy("k_").agg(F.sum("n_").alias("total_"))
    below = ranks.running("below_", "sum", F.col("n_")).rows.filter(F.col("side_") != 1)
    shares = below.join(total, "k_").select("k_", F.col("v_").alias("s__"), F.when(F.col("total_") > 0, 1 - F.col("below_") / F.col("total_")).alias("share"))
    return rows.join(shares, (rows[key] == F.col("k_")) & (rows["s_"] == F.col("s__")), "left").drop("k_", "s_", "s__")
