"""Seeded maps and queries with a known place, for tests and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.significance import pick


def random_maps(spark: SparkSession, n: int, frags: int = 500, low: int = 500, high: int = 70_000, seed: int = 1) -> DataFrame:
    """``n`` maps (map_id, frags, num_frags, length) of fragments uniform in [low, high); the same for a seed on any cluster."""
    size = lambda m, i: (low + pick(F.lit(high - low), F.lit(seed), m, i)).cast("int")
    rows = spark.range(n).select(F.col("id").alias("m"))
    rows = rows.withColumn("frags", F.transform(F.sequence(F.lit(0), F.lit(frags - 1)), lambda i: size(F.col("m"), i)))
    return rows.select(F.concat(F.lit("random"), F.col("m")).alias("map_id"), "frags", F.lit(frags).alias("num_frags"), F.aggregate("frags", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("length"))


def sampled_contigs(maps: DataFrame, each: int, low: int = 10, high: int = 19, false_cuts: float = 0.1, missed: float = 0.0, seed: int = 2) -> DataFrame:
    """``each`` slices of every map, turned round by chance, with false cuts (a fragment is cut in two) and missed sites (two become one): map_id, frags, true_map, true_start, true_end, true_forward.

    ``true_end`` is exclusive and counts the map's fragments.
    """
    chance = lambda *k: pick(F.lit(1_000_000), F.lit(seed), F.col("map_id"), F.col("c"), *k) / 1e6
    rows = maps.select("map_id", "frags").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    rows = rows.withColumn("n", F.least(F.size("frags"), (low + F.floor(chance(F.lit("n")) * (high - low + 1))).cast("int")))
    rows = rows.withColumn("s", F.floor(chance(F.lit("s")) * (F.size("frags") - F.col("n") + 1)).cast("int"))
    cut = F.transform(F.slice("frags", F.col("s") + 1, F.col("n")), lambda x, i: F.when((chance(F.lit("cut"), i) < false_cuts) & (x > 1), F.array(F.greatest(F.lit(1), F.floor(x * chance(F.lit("at"), i)).cast("int")), x)).otherwise(F.array(x)))
    # A cut fragment is kept as (first part, whole); the second part is what is left.
    parts = F.flatten(F.transform(cut, lambda p: F.when(F.size(p) == 2, F.array(F.least(p[0], F.get(p, F.lit(1)) - 1), F.get(p, F.lit(1)) - F.least(p[0], F.get(p, F.lit(1)) - 1))).otherwise(p)))
    rows = rows.withColumn("parts", parts)
    start = F.slice("parts", 1, 1)

    def step(acc, x):
        merge = chance(F.lit("miss"), x["i"]) < missed
        return F.when(merge, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.element_at(acc, -1) + x["v"]))).otherwise(F.concat(acc, F.array(x["v"])))

    rest = F.transform(F.slice("parts", 2, F.size("parts")), lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    rows = rows.withColumn("f", F.aggregate(rest, start, step))
    forward = chance(F.lit("way")) < 0.5
    return rows.select(F.concat_ws("-", F.lit("contig"), "map_id", "c").alias("map_id"), F.when(forward, F.col("f")).otherwise(F.reverse("f")).alias("frags"), F.col("map_id").alias("true_map"), F.col("s").alias("true_start"), (F.col("s") + F.col("n")).alias("true_end"), forward.alias("true_forward"))
