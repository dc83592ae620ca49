"""Command line: align query maps to reference maps, or run the whole chain from sequences and optical maps to scaffolds."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.maps import clean_id, fragments, sites
from .operators import adjust, align, placement, significance
from .params import Params
from .sources import readers, writers


def parser() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="fragloom", description=__doc__)
    d = Params()
    a.add_argument("contig_map")
    a.add_argument("optical_map", nargs="+")
    a.add_argument("--output", default="matches")
    for flag in ("circular", "local", "noReverse", "oneToOneMatch", "noBoundaries"):
        a.add_argument(f"--{flag}", action="store_true")
    for name, kind, default in (
        ("sdMin", int, d.sd_min), ("sdMax", int, d.sd_max), ("pvalue", float, d.p_threshold), ("siteCostContig", float, d.cost_contig), ("siteCostOptical", float, d.cost_optical),
        ("maxMissRateContig", float, d.max_miss_rate), ("maxMatchesPerContig", int, d.max_matches), ("minSiteHits", int, d.min_hits), ("numPermutationTrials", int, d.trials), ("numThreads", int, 1),
    ):
        a.add_argument(f"--{name}", type=kind, default=default)
    return a


def params_of(o: argparse.Namespace) -> Params:
    return Params(
        circular=o.circular, local=o.local, reverse=not o.noReverse, one_to_one=o.oneToOneMatch, boundaries=not o.noBoundaries, p_threshold=o.pvalue, sd_min=o.sdMin, sd_max=o.sdMax,
        cost_contig=o.siteCostContig, cost_optical=o.siteCostOptical, max_miss_rate=o.maxMissRateContig, max_matches=o.maxMatchesPerContig, min_hits=o.minSiteHits, trials=o.numPermutationTrials,
    )


def show_params(spark: SparkSession, p: Params) -> DataFrame:
    """(name, value) rows of all parameters."""
    return spark.createDataFrame([(k, str(v)) for k, v in vars(p).items()], "name string, value string")


def aligned(contigs: DataFrame, maps: DataFrame, p: Params) -> DataFrame:
    """Matches with match_id and, if there are trials, p-values."""
    out = align.align(contigs, maps, p).withColumn("match_id", F.concat_ws("/", "contig_id", F.col("rank").cast("string")))
    if p.trials > 0:
        out = out.persist()
        null = significance.null_table(contigs, maps, p, out.select("num_frags"))
        out = significance.empirical_pvalues(out, null)
    return out


def digest(dna: DataFrame, motif: str, first: int = 0) -> DataFrame:
    """Maps of sequences (seq_id, dna) cut at each ``motif``."""
    cut = dna.select(F.col("seq_id").alias("map_id"), F.length("dna").alias("length"), fragments(sites(F.col("dna"), motif, first), F.length("dna")).cast("array<int>").alias("frags"))
    return cut.withColumn("num_frags", F.size("frags"))


def same_enzyme(maps: DataFrame) -> str:
    """The one enzyme of all maps; more than one raises."""
    names = [r.enzyme for r in maps.select("enzyme").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError(f"maps of one enzyme are needed, not of {names}")
    return names[0]


def random_chunk_scores(contigs: DataFrame, maps: DataFrame, n: int = 1000, frags: int = 10) -> DataFrame:
    """Chunk scores (place, score) of the best alignments of random maps of interior fragments, for the bootstrap."""
    spark = maps.sparkSession
    pool = significance.fragment_pool(contigs, interior=True)
    drawn = significance.random_contigs(pool, spark.createDataFrame([(frags,)], "num_frags int"), n)
    p = Params(boundaries=False, max_matches=1, max_miss_rate=1.0, min_hits=1, sd_min=4, sd_max=4)
    scores = significance.chunk_scores(aligned(drawn.select("map_id", "frags"), maps, p)).persist()
    numbered = scores.groupBy("match_id").agg(F.sort_array(F.collect_list("score")).alias("frags")).select(F.col("match_id").alias("map_id"), "frags")
    return significance.fragment_pool(numbered).withColumnRenamed("size", "score")


def scaffold_chain(spark: SparkSession, optical_file: str, fasta: str, enzymes: str, output: str) -> None:
    """Digest sequences by the maps' enzyme, align, test by the bootstrap, and write matches, reports and scaffolds under ``output``."""
    maps = readers.read_pair_lines(spark, optical_file).withColumn("map_id", clean_id(F.col("map_id")))
    name = spark.createDataFrame([(same_enzyme(maps),)], "name string")
    motif = readers.motif_of(readers.read_enzymes(spark, enzymes), name).first().motif
    contigs = digest(readers.read_fasta(spark, fasta), motif)
    p = Params(p_threshold=0.0, min_hits=2, sd_min=4, sd_max=4)
    matches = aligned(contigs, maps, p).persist()
    boot = significance.bootstrap(random_chunk_scores(contigs, maps), matches.select(F.size("alignment").alias("num_chunks")))
    matches = matches.drop("pval").join(significance.bootstrap_pvalues(matches, boot).select("match_id", "pval"), "match_id").persist()
    good = placement.significant(matches)
    single = placement.unique(good)
    for label, part in (("all", matches), ("sig", good), ("unique", single)):
        part.write.mode("overwrite").parquet(f"{output}/{label}")
    writers.write_info(single, f"{output}/info", placement.chromosome_order(), mode="overwrite")
    ranked = placement.one_to_one(single)
    for label, order in (("quality", placement.quality_order()), ("one_to_one", placement.one_to_one_order()), ("location", placement.chromosome_order())):
        writers.write_info(ranked, f"{output}/sorted_{label}", order, True, "overwrite")
    strict = ranked.filter(placement.is_strict_quality())
    writers.write_info(strict, f"{output}/strict", placement.quality_order(), True, "overwrite")
    writers.write_matched_chunks(single, f"{output}/chunks", "overwrite")
    writers.write_contig_summary(placement.contig_summary(contigs, good), f"{output}/summary", "overwrite")
    writers.alignment_tables(single).select("value").write.mode("overwrite").text(f"{output}/tables")
    for label, part in (("sig", good), ("unique", single)):
        for overlaps in (False, True):
            tiled = placement.tiling(part, allow_overlaps=overlaps)
            text = writers.scaffold_text(placement.scaffold_rows(tiled, part), placement.coverage(tiled, maps))
            text.orderBy(F.col("chromosome").asc_nulls_first()).select("value").write.mode("overwrite").text(f"{output}/scaffolds_{label}{'_overlaps' * overlaps}")


def corrected_maps(contigs: DataFrame, maps: DataFrame, p: Params) -> DataFrame:
    """Maps corrected by what their own unique good alignments say."""
    return adjust.adjust_maps(maps, placement.inner_chunks(placement.adjustment_matches(aligned(contigs, maps, p))))


def main(args: list[str] | None = None) -> None:
    o = parser().parse_args(args)
    p = params_of(o)
    spark = SparkSession.builder.appName("fragloom").getOrCreate()
    contigs, maps = readers.read_maps(spark, o.contig_map), readers.read_maps(spark, o.optical_map, circular=o.circular)
    show_params(spark, p).show(50, False)
    writers.write_all_and_significant(aligned(contigs, maps, p), o.output, p.p_threshold)


if __name__ == "__main__":
    main()
