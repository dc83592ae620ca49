"""Null distributions and p-values.  Sampling is by md5 of stated keys, so that results repeat on any cluster and in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import Params
from ..scratch import cut
from .align import null_scores
from .ranges import share_reaching


def pick(n: Column, *keys: Column) -> Column:
    """A number from 0 to ``n`` - 1, by the first eight hex digits of the keys' md5."""
    digits = F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]).cast("binary")), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), n.cast("bigint"))


def _starts(counts: DataFrame) -> DataFrame:
    """``counts`` (map_id, n) with before, the sum of all n of smaller ids.

    Ids are dealt out in ranges and written; the sums of the ranges, one row for each task, are all that one task sees.
    """
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranged = cut(counts.select("map_id", "n").repartitionByRange("map_id").withColumn("part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("part").agg(F.sum("n").alias("n_part")).select("part", earlier("n_part", Window.orderBy("part")).alias("before_part"))
    own = ranged.withColumn("before_map", earlier("n", Window.partitionBy("part").orderBy("map_id"))).join(parts, "part")
    return own.select("map_id", "n", (F.col("before_part") + F.col("before_map")).alias("before"))


def fragment_pool(contigs: DataFrame, interior: bool = False) -> DataFrame:
    """Numbered fragments (place, size) of all queries, or of their interiors only (queries of more than two)."""
    frags = F.slice("frags", 2, F.greatest(F.size("frags") - 2, F.lit(0))) if interior else F.col("frags")
    rows = contigs.select("map_id", F.posexplode(frags).alias("i", "size"))
    starts = _starts(rows.groupBy("map_id").agg(F.count("*").alias("n"))).select("map_id", "before")
    return rows.join(starts, "map_id").select((F.col("before") + F.col("i")).cast("bigint").alias("place"), "size")


def random_contigs(pool: DataFrame, sizes: DataFrame, trials: int) -> DataFrame:
    """``trials`` random queries (map_id, num_frags, frags) for each of ``sizes``' num_frags, with replacement from the pool."""
    n = pool.agg(F.count("*").alias("n")).first()["n"]
    draws = sizes.select("num_frags").distinct().select("num_frags", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    draws = draws.select("num_frags", "trial", F.explode(F.sequence(F.lit(0), F.col("num_frags") - 1)).alias("k"))
    draws = draws.withColumn("place", pick(F.lit(max(n, 1)), F.col("num_frags"), F.col("trial"), F.col("k")))
    drawn = draws.join(pool, "place").groupBy("num_frags", "trial").agg(F.sort_array(F.collect_list(F.struct("k", "size"))).alias("s"))
    return drawn.select(F.concat_ws("_", F.lit("random"), "num_frags", "trial").alias("map_id"), "num_frags", "trial", F.col("s.size").alias("frags"))


def null_table(contigs: DataFrame, maps: DataFrame, p: Params, sizes: DataFrame | None = None) -> DataFrame:
    """(num_frags, trial, score): a random query's best score, null where it aligns nowhere; one distribution for each number of fragments."""
    sizes = contigs.select(F.size("frags").alias("num_frags")) if sizes is None else sizes
    # Both are read several times.
    drawn, maps = cut(random_contigs(fragment_pool(contigs), sizes, p.trials), "drawn"), cut(maps.select("map_id", "frags"), "maps")
    return drawn.select("map_id", "num_frags", "trial").join(null_scores(drawn, maps, p), "map_id").select("num_frags", "trial", "score")


def empirical_pvalues(matches: DataFrame, null: DataFrame) -> DataFrame:
    """``matches`` with pval: the share of the null scores of its number of fragments that are not below its score; 0 where there are none.

    Scores of null count as below everything.
    """
    joined = share_reaching(matches.drop("pval"), null.withColumnRenamed("score", "null_score"), "num_frags")
    return joined.withColumn("pval", F.coalesce("share", F.lit(0.0))).drop("share")


def strict_pvalues(matches: DataFrame, null: DataFrame) -> DataFrame:
    """``matches`` with pval: the share of the null scores of its number of fragments strictly above its score; 0 where there are none."""
    joined = share_reaching(matches.drop("pval"), null.withColumnRenamed("score", "null_score"), "num_frags", strict=True)
    return joined.withColumn("pval", F.coalesce("share", F.lit(0.0))).drop("share")


def chunk_scores(matches: DataFrame) -> DataFrame:
    """(match_id, chunk, score) of the chunks that aren't gaps; score is the sum of the three parts."""
    rows = matches.select("match_id", F.posexplode("alignment").alias("chunk", "x")).filter(~F.col("x.is_contig_gap"))
    return rows.select("match_id", "chunk", (F.col("x.score.contig") + F.col("x.score.optical") + F.col("x.score.sizing")).alias("score"))


def bootstrap(pool: DataFrame, sizes: DataFrame, samples: int = 10_000) -> DataFrame:
    """(num_chunks, sample, score): sums of ``num_chunks`` scores drawn with replacement from ``pool`` (place, score), once for each of the sizes.

    Rows are samples times distinct sizes; sums are built by a partial aggregation of the draws.
    """
    n = pool.agg(F.count("*").alias("n")).first()["n"]
    draws = sizes.select("num_chunks").distinct().select("num_chunks", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    draws = draws.select("num_chunks", "sample", F.explode(F.sequence(F.lit(0), F.col("num_chunks") - 1)).alias("k"))
    draws = draws.withColumn("place", pick(F.lit(max(n, 1)), F.col("num_chunks"), F.col("sample"), F.col("k")))
    return draws.join(pool, "place").groupBy("num_chunks", "sample").agg(F.sum("score").alias("score"))


def bootstrap_pvalues(matches: DataFrame, boot: DataFrame) -> DataFrame:
    """(match_id, num_chunks, pval): share of the bootstrap sums for the match's number of chunks, gaps included, that reach its score."""
    rows = matches.select("match_id", "score", F.size("alignment").alias("num_chunks"))
    out = share_reaching(rows, boot.withColumnRenamed("score", "null_score"), "num_chunks")
    return out.filter(F.col("share").isNotNull()).select("match_id", "num_chunks", F.col("share").alias("pval"))


def plotting_quantile(values: DataFrame, group: str, column: str, q: float, a: float = 0.4, b: float = 0.4) -> DataFrame:
    """(group, quantile) by plotting positions with ``a`` and ``b``: at n * q + m, m = a + q (1 - a - b), between the neighbouring order statistics."""
    w = Window.partitionBy(group)
    rows = values.select(group, column, F.row_number().over(w.orderBy(column)).alias("i"), F.count("*").over(w).alias("n"))
    aleph = F.col("n") * q + F.lit(a + q * (1 - a - b))
    k = F.floor(F.greatest(F.lit(1.0), F.least(aleph, (F.col("n") - 1).cast("double"))))
    gamma = F.greatest(F.lit(0.0), F.least(F.lit(1.0), aleph - k))
    rows = rows.withColumns({"k": k, "gamma": gamma})
    part = F.when(F.col("i") == F.col("k"), (1 - F.col("gamma")) * F.col(column)).when(F.col("i") == F.col("k") + 1, F.col("gamma") * F.col(column)).when(F.col("n") == 1, F.col(column))
    return rows.groupBy(group).agg(F.sum(part).alias("quantile"))


def shuffled_maps(maps: DataFrame, trial: int = 0, trials: int | None = None) -> DataFrame:
    """``maps`` (map_id, frags) with all their fragments dealt out anew: a permutation of the whole pool, each map keeping its number of fragments.

    With ``trials``, one such permutation for each trial from 0 on, and a column trial; else the permutation of ``trial``.
    Fragments are ordered by the md5 of (trial, place); ranges of it and their counts give new places without a single-task sort.
    """
    pool = fragment_pool(maps)
    numbers = F.sequence(F.lit(0), F.lit(trials - 1)) if trials is not None else F.array(F.lit(trial))
    pool = pool.withColumn("trial", F.explode(numbers))
    digits = F.md5(F.concat_ws("|", F.col("trial").cast("string"), F.col("place").cast("string")).cast("binary"))
    keyed = pool.select("trial", "size", digits.alias("h")).withColumn("head", F.substring("h", 1, 3))
    heads = keyed.groupBy("trial", "head").agg(F.count("*").alias("n"))
    heads = heads.select("trial", "head", F.coalesce(F.sum("n").over(Window.partitionBy("trial").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    dealt = keyed.withColumn("k", F.row_number().over(Window.partitionBy("trial", "head").orderBy("h")) - 1).join(heads, ["trial", "head"])
    dealt = dealt.select("trial", (F.col("before") + F.col("k")).cast("bigint").alias("place"), "size")
    homes = _starts(maps.select("map_id", F.size("frags").alias("n")).filter("n > 0"))
    placed = homes.select("map_id", F.posexplode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)).alias("i", "place"))
    # A row for each fragment on both sides: the size Spark assumes of an exploded sequence is that of its ends, so it would be broadcast.
    out = placed.join(dealt.hint("merge"), "place").groupBy("trial", "map_id").agg(F.sort_array(F.collect_list(F.struct("i", "size"))).alias("s"))
    return out.select("map_id", *["trial"] * (trials is not None), F.col("s.size").alias("frags"))


def shuffle_null(contigs: DataFrame, maps: DataFrame, p: Params) -> DataFrame:
    """(map_id, trial, score): each query's best score on maps whose fragments were dealt out anew, once for each of ``p.trials``; one plan for all trials."""
    if p.trials <= 0:
        return contigs.select("map_id", F.lit(0).alias("trial"), F.lit(None).cast("double").alias("score")).limit(0)
    return null_scores(contigs, shuffled_maps(maps, trials=p.trials), p, by="trial")


def quantile_table(values: DataFrame, group: str, column: str, quantiles: list[float]) -> DataFrame:
    """(group, q, quantile) for several quantiles, e.g. cut-off scores for each number of chunks."""
    out = None
    for q in quantiles:
        one = plotting_quantile(values, group, column, q).withColumn("q", F.lit(q))
        out = one if out is None else out.unionByName(one)
    return out


def stored(spark, path: str, build) -> DataFrame:
    """The table at ``path``, which ``build()`` makes if it isn't there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
