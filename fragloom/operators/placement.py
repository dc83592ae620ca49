"""What follows an alignment: ranks, unique placements, summaries, tilings, scaffolds and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .align import greedy_ids, top_matches
from .ranges import ranged


def significant(matches: DataFrame, p: float = 0.05) -> DataFrame:
    return matches.filter(F.col("pval") <= p)


def unique(matches: DataFrame) -> DataFrame:
    """Matches of queries that have exactly one."""
    return matches.withColumn("_n", F.count("*").over(Window.partitionBy("contig_id"))).filter("_n = 1").drop("_n")


def aligned_bases(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count("*").alias("n_matches"), F.coalesce(F.sum("c_aligned_bases"), F.lit(0)).alias("aligned_bases"))


def is_quality(frags: int = 3) -> Column:
    aligned = F.col("num_frags") - F.col("contig_unaligned_frags")
    return (aligned >= frags) & (F.col("aligned_length_ratio") >= 0.90) & (F.col("total_miss_rate") <= 1.0) & (F.col("pval") <= 0.05) & (F.col("contig_unaligned_base_ratio") <= 0.10)


def one_to_one(matches: DataFrame) -> DataFrame:
    """With the inner blocks of one fragment on each side: their bases and share, and mean, median, least and largest deviation in standard deviations."""
    inner = F.filter("alignment", lambda x: ~x["is_contig_gap"] & ~x["is_boundary_chunk"])
    size = lambda x, side: x[side]["end_bp"] - x[side]["start_bp"]
    pure = F.filter(inner, lambda x: (x["contig"]["end"] - x["contig"]["start"] == 1) & (x["optical"]["end"] - x["optical"]["start"] == 1))
    add = lambda chunks: F.aggregate(chunks, F.lit(0), lambda a, x: a + size(x, "contig"))
    off = F.transform(inner, lambda x: F.abs(size(x, "optical") - size(x, "contig")) / (F.lit(0.3 * 1000**0.5) * F.sqrt(size(x, "contig"))))
    n = F.size("_off")
    out = matches.withColumns({"bases_one_to_one": add(pure), "_inner": add(inner), "_off": F.array_sort(off)})
    out = out.withColumns({
        "one_to_one_ratio": F.when(F.col("_inner") > 0, F.col("bases_one_to_one") / F.col("_inner")), "mean_sd": F.when(n > 0, F.aggregate("_off", F.lit(0.0), lambda a, x: a + x) / n),
        "median_sd": F.when(n > 0, (F.get("_off", F.floor((n - 1) / 2).cast("int")) + F.get("_off", F.floor(n / 2).cast("int"))) / 2), "min_sd": F.get("_off", F.lit(0)), "max_sd": F.get("_off", n - 1),
    })
    return out.drop("_inner", "_off")


def is_strict_quality() -> Column:
    """For matches with :func:`one_to_one`."""
    return is_quality() & (F.col("one_to_one_ratio") >= 0.70) & (F.col("bases_one_to_one") >= 5000) & (F.col("pval") <= 0.01)


def quality_order() -> list[Column]:
    """Score, then unaligned share, misses, median deviation and length ratio; for matches with :func:`one_to_one`."""
    return [F.col("score").desc(), F.col("contig_unaligned_base_ratio"), F.col("total_misses"), F.col("median_sd"), F.col("aligned_length_ratio"), F.col("match_id")]


def chromosome_order() -> list[Column]:
    number = F.regexp_extract("chromosome", r"chr(\d+)", 1)
    return [F.when(number == "", -1).otherwise(number.try_cast("int")), F.col("op_start_index"), F.col("op_end_index"), F.col("match_id")]


def one_to_one_order() -> list[Column]:
    return [F.col("one_to_one_ratio").desc(), F.col("match_id")]


def refine(matches: DataFrame) -> DataFrame:
    """Per query, the non-overlapping matches of two sites or more, best first; half-open intervals on one map."""
    some = one_to_one(matches).filter(F.col("contig_hits") >= 2)
    return _tiled(some, ["contig_id", "chromosome"], quality_order())


def _tiled(matches: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return matches.join(greedy_ids(matches, by, order, "op_start_bp", "op_end_bp"), "match_id", "left_semi")


def tiling(matches: DataFrame, overlap: str = "one-sided", allow_overlaps: bool = False) -> DataFrame:
    """Per map, matches taken by aligned bases, largest first.

    ``one-sided``: a candidate goes if it begins behind the end of an accepted match and ends behind that one's start, so only what lies wholly to the right of an
    accepted match is left out; this reproduces tilings made so.  What goes ends behind the first end accepted so far, so the least end of all earlier candidates
    is that of the accepted ones, a running value over ranges.  ``interval``: a candidate goes if the two intervals overlap.
    """
    if overlap not in ("one-sided", "interval"):
        raise ValueError(overlap)
    if allow_overlaps:
        return matches
    order = [F.col("c_aligned_bases").desc(), F.col("match_id").desc()]
    if overlap == "interval":
        return _tiled(matches, ["chromosome"], order)
    ends = ranged(matches, ["chromosome"], order).running("end_", "min", F.col("op_end_bp")).plain()
    return ends.filter(F.col("end_").isNull() | (F.col("op_start_bp") <= F.col("end_"))).drop("end_")


def scaffold_rows(placed: DataFrame, all_matches: DataFrame) -> DataFrame:
    """Tiled matches with gap_after (to the next start on the map, 0 at the end), placements (matches of the query) and orientation."""
    counts = all_matches.groupBy("contig_id").agg(F.count("*").alias("placements"))
    # Backwards, the least start so far is that of the next one.
    back = ranged(placed, ["chromosome"], [F.col("op_start_bp").desc(), F.col("match_id").desc()]).running("next_", "min", F.col("op_start_bp")).plain()
    gap = F.coalesce(F.col("next_") - F.col("op_end_bp"), F.lit(0))
    return back.withColumn("gap_after", gap).drop("next_").join(counts, "contig_id").withColumn("orientation", F.when(F.col("forward"), "F").otherwise("R"))


def coverage(placed: DataFrame, maps: DataFrame) -> DataFrame:
    """Per map with placements and, with a null chromosome, overall: length, contigs placed, covered size and ratio.

    Overall length is that of all maps, with placements or without.
    """
    each = placed.groupBy("chromosome").agg(F.count("*").alias("contigs_placed"), F.sum(F.col("op_end_bp") - F.col("op_start_bp")).cast("bigint").alias("covered_size"))
    by_map = each.join(maps.select(F.col("map_id").alias("chromosome"), F.col("length").cast("bigint").alias("length")), "chromosome")
    whole = maps.agg(F.sum("length").cast("bigint").alias("length"))
    total = each.agg(F.coalesce(F.sum("contigs_placed"), F.lit(0)).alias("contigs_placed"), F.coalesce(F.sum("covered_size"), F.lit(0)).alias("covered_size"))
    # Both are one row.
    overall = total.withColumn("k", F.lit(1)).join(whole.withColumn("k", F.lit(1)), "k").drop("k").withColumn("chromosome", F.lit(None).cast("string"))
    return by_map.unionByName(overall.select(*by_map.columns)).withColumn("covered_ratio", F.col("covered_size") / F.col("length"))


def contig_summary(contigs: DataFrame, matches: DataFrame) -> DataFrame:
    """Per query: size, fragments, number of matches, whether there is exactly one, number and list of maps; largest first when sorted by size."""
    each = matches.groupBy("contig_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("chromosome")).alias("chroms"))
    size = F.aggregate("frags", F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = contigs.select(F.col("map_id").alias("contig_id"), size.alias("size"), F.size("frags").alias("num_frags"))
    n = F.coalesce("n", F.lit(0))
    return rows.join(each, "contig_id", "left").select(
        F.col("contig_id").alias("contig"), "size", "num_frags", n.alias("num_alignments"), (n == 1).alias("aligned_uniquely"),
        F.coalesce(F.size("chroms"), F.lit(0)).alias("num_chroms"), F.coalesce(F.array_join("chroms", ";"), F.lit("")).alias("chroms"),
    )


def special_contigs(contigs: DataFrame, share: float = 0.995) -> DataFrame:
    """Queries with a fragment above the given quantile of all fragments' lengths, and n_long, how many such fragments they have."""
    limit = contigs.select(F.explode("frags").alias("size")).agg(F.percentile("size", F.lit(share)).alias("q")).first()["q"]
    n_long = F.size(F.filter("frags", lambda x: x > F.lit(limit))) if limit is not None else F.lit(0)
    return contigs.withColumn("n_long", n_long.cast("bigint")).filter("n_long > 0")


def adjustment_matches(matches: DataFrame, hits: int = 10, rate: float = 0.10) -> DataFrame:
    """Unique matches that are good enough to correct a map by."""
    return unique(matches.filter((F.col("contig_hits") >= hits) & (F.greatest("contig_miss_rate", "optical_miss_rate") <= rate)))


def inner_chunks(matches: DataFrame) -> DataFrame:
    """(match_id, chunk, contig, optical): lengths of the blocks between two sites."""
    rows = matches.select("match_id", F.posexplode("alignment").alias("chunk", "x")).filter(~F.col("x.is_contig_gap") & ~F.col("x.is_boundary_chunk"))
    size = lambda side: F.col(f"x.{side}.end_bp") - F.col(f"x.{side}.start_bp")
    return rows.select("match_id", "chunk", size("contig").alias("contig"), size("optical").alias("optical"))


def match_strings(matches: DataFrame) -> DataFrame:
    """(match_id and six strings): fragments and indices of both sides with ``;`` at matched sites, gaps, and scores to three digits."""
    solid = F.filter("alignment", lambda x: ~x["is_contig_gap"])
    first_solid = F.get(solid, F.lit(0))
    opens = ~first_solid["is_boundary_chunk"]
    lead = F.when(opens, "; ").otherwise("")
    text = lambda a: F.transform(a, lambda v: v.cast("string"))
    before = lambda i: F.size(F.filter(F.slice("alignment", 1, i), lambda y: ~y["is_contig_gap"])) == 0
    closes = lambda x, i: before(i) | ~x["is_boundary_chunk"]

    def shown(solid_part, gap_part):
        return F.array_join(F.transform("alignment", lambda x, i: F.when(x["is_contig_gap"], gap_part(x)).otherwise(F.concat(F.when(before(i), lead).otherwise(""), solid_part(x), F.when(closes(x, i), F.lit("@")).otherwise("")))), "")

    indices = lambda x, side: F.array_join(text(F.sequence(x[side]["start"], x[side]["end"] - 1)), ",")
    end = lambda c, mark: F.replace(c, F.lit("@"), F.lit(mark))
    number = lambda v: F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(F.format_string("%.3g", v))
    score = F.array_join(F.transform("alignment", lambda x: F.concat(F.lit("("), number(x["score"]["contig"]), F.lit(","), number(x["score"]["optical"]), F.lit(","), number(x["score"]["sizing"]), F.lit(")"))), " / ")
    return matches.select(
        "match_id",
        end(shown(lambda x: F.concat(F.lit(" "), F.array_join(x["optical"]["frags"], "  "), F.lit(" ")), lambda x: F.lit(" --- ")), "; ").alias("optical_match_string"),
        end(shown(lambda x: indices(x, "optical"), lambda x: F.lit("")), ";").alias("optical_aligned_index"),
        end(shown(lambda x: F.concat(F.lit(" "), F.array_join(x["contig"]["frags"], ",  "), F.lit(", ")), lambda x: F.concat(F.lit(" ("), (x["contig"]["end_bp"] - x["contig"]["start_bp"]).cast("string"), F.lit(") "))), "; ").alias("contig_match_string"),
        score.alias("score_string"),
        end(shown(lambda x: indices(x, "contig"), lambda x: F.lit("")), ";").alias("contig_aligned_index"),
        F.array_join(F.transform(F.filter("alignment", lambda x: x["is_contig_gap"]), lambda x: x["contig"]["start"].cast("string")), ",").alias("contig_lost_index"),
    )


def last_by_contig(matches: DataFrame) -> DataFrame:
    """Each query's last match in the order of a file, here that of match_id, as readers keep it that map a query to one match."""
    last = matches.groupBy("contig_id").agg(F.max("match_id").alias("match_id"))
    return matches.join(last, ["contig_id", "match_id"], "left_semi")


def by_contig(matches: DataFrame) -> DataFrame:
    """(contig_id, matches): the ids of each query's matches, best first; of equal scores the later id first."""
    item = F.struct("score", "match_id")
    return matches.groupBy("contig_id").agg(F.sort_array(F.collect_list(item), asc=False).getField("match_id").alias("matches"))


def length_deviations(matches: DataFrame) -> DataFrame:
    """Inner blocks (match_id, chunk, contig, optical) with their deviation in standard deviations, e.g. for plots."""
    return inner_chunks(matches).withColumn("deviation", F.when(F.col("contig") > 0, (F.col("optical") - F.col("contig")) / (F.lit(0.3 * 1000**0.5) * F.sqrt("contig"))))


def refined_lists(matches: DataFrame) -> dict[str, DataFrame]:
    """Matches that pass the quality test, of these the refined ones, of these the best of each query and the unique ones."""
    good = matches.filter(is_quality())
    fine = refine(good).persist()
    return {"quality": good, "refined": fine, "best": top_matches(fine.drop("rank"), 1), "unique": unique(fine)}


def fragment_lines(maps: DataFrame) -> DataFrame:
    """(map_id, value): a map's id and size, then one fragment a line."""
    head = F.concat_ws(" ", "map_id", F.col("length").cast("string"))
    return maps.select("map_id", F.concat_ws("\n", head, F.transform("frags", lambda x: x.cast("string"))).alias("value"))
