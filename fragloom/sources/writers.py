"""Writers of map, alignment, report and scaffold files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.placement import inner_chunks, match_strings
from .readers import NUMBERS, STRINGS, snake


def map_lines(maps: DataFrame) -> DataFrame:
    frags = F.transform("frags", lambda x: x.cast("string"))
    return maps.select(F.concat_ws("\t", "map_id", F.col("length").cast("string"), F.size("frags").cast("string"), frags).alias("value"))


def write_maps(maps: DataFrame, path: str, mode: str = "errorifexists") -> None:
    map_lines(maps).write.mode(mode).text(path)


def xml_rows(matches: DataFrame) -> DataFrame:
    """Matches with the elements of an alignment file, in their order."""
    strings = matches.select("match_id", *[c for c in matches.columns if c not in {snake(s) for s in STRINGS} and c != "match_id"]).join(match_strings(matches), "match_id")
    flag = lambda c: F.when(c, "1").otherwise("0")

    def side(x: Column, name: str) -> Column:
        s = x[name]
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["start_bp"].alias("startBp"), s["end_bp"].alias("endBp"), F.struct(s["frags"].alias("frag")).alias("frags"))

    chunks = F.transform("alignment", lambda x: F.struct(side(x, "contig").alias("contig"), side(x, "optical").alias("optical"), flag(x["is_contig_gap"]).alias("isContigGap"), flag(x["is_boundary_chunk"]).alias("isBoundaryChunk"), x["score"].alias("score")))
    return strings.select(
        F.struct(F.col("contig_id").alias("name"), F.col("contig_length").alias("length")).alias("contig"), "chromosome", flag(F.col("forward")).alias("forward"),
        *[F.col(snake(k)).alias(k) for k in NUMBERS], *[F.col(snake(k)).alias(k) for k in STRINGS], F.struct(chunks.alias("chunk")).alias("alignment"),
    )


def write_alignments(matches: DataFrame, path: str, mode: str = "errorifexists") -> None:
    xml_rows(matches).write.mode(mode).format("xml").option("rootTag", "alignments").option("rowTag", "MatchResult").save(path)


def write_all_and_significant(matches: DataFrame, prefix: str, p: float = 0.05) -> None:
    """``<prefix>_AllMatches.xml`` and, up to ``p``, ``<prefix>_SigMatches.xml``."""
    write_alignments(matches, f"{prefix}_AllMatches.xml")
    write_alignments(matches.filter(F.col("pval") <= p), f"{prefix}_SigMatches.xml")


INFO = (
    "contig_id", "chromosome", "c_start_index", "c_end_index", "c_start_bp", "c_end_bp", "c_aligned_bases", "op_start_index", "op_end_index", "op_start_bp", "op_end_bp", "op_aligned_bases",
    "contig_misses", "contig_miss_rate", "optical_misses", "optical_miss_rate", "total_hits", "total_misses", "total_miss_rate", "score",
)
INFO_HEADER = "#contigId,chromosome,cStartIndex,cEndIndex,cStartBp,cEndBp,cAlignedBases,opStartIndex,opEndIndex,opStartBp,opEndBp,opAlignedBases,contigMisses,contigMissRate,opticalMisses,opticalMissRate,totalHits,totalMisses,totalMissRate,score"


#: Fixed by the format: names and widths of the columns of :func:`fixed_info_lines`.
FIXED_INFO = (
    ("contigName", 15), ("chrom", 15), ("start", 5), ("end", 5), ("Forwd", 5), ("sites", 5), ("size", 10), ("Cmiss", 4), ("Omiss", 4), ("missr", 5), ("fragMiss", 8), ("unalignedBaseRatio", 20), ("score", 10),
    ("pval", 6), ("meanSD", 6), ("medSD", 6), ("minSD", 6), ("maxSD", 6), ("lRat", 6), ("1to2b", 10), ("1to1r", 6),
)


def write_info(matches: DataFrame, path: str, order: list[Column], fixed: bool = False, mode: str = "errorifexists") -> None:
    """An info file in order: the header line in the folder ``0``, the lines behind it in ``1``, whose files follow each other."""
    matches.sparkSession.range(1).select(F.lit("\t".join(name.rjust(width) for name, width in FIXED_INFO) if fixed else INFO_HEADER).alias("value")).coalesce(1).write.mode(mode).text(f"{path}/0")
    lines = (fixed_info_lines if fixed else info_lines)(matches)
    matches.join(lines, "match_id").orderBy(*order).select("value").write.mode(mode).text(f"{path}/1")


def info_lines(matches: DataFrame) -> DataFrame:
    """(match_id, value): 20 comma-separated columns, floats with three digits."""
    kinds = dict(matches.dtypes)
    shown = [F.format_string("%6.3f", F.col(c)) if kinds[c] == "double" else F.col(c).cast("string") for c in INFO]
    return matches.select("match_id", F.concat_ws(",", *shown).alias("value"))


def fixed_info_lines(matches: DataFrame) -> DataFrame:
    """(match_id, value): 21 columns of fixed width, tab-separated; for matches with one-to-one statistics."""
    kinds = "%15s\t%15s\t%5d\t%5d\t%5d\t%5d\t%10d\t%4d\t%4d\t%5.2f\t%8d\t%20.3f\t%10.2f\t%6.4f\t%6.2f\t%6.2f\t%6.2f\t%6.2f\t%6.2f\t%10d\t%6.3f"
    columns = [
        "contig_id", "chromosome", "op_start_index", "op_end_index", F.col("forward").cast("int"), F.col("num_frags") - 1, "contig_length", "contig_misses", "optical_misses", 100 * F.col("total_miss_rate"),
        "contig_unaligned_frags", "contig_unaligned_base_ratio", "score", "pval", "mean_sd", "median_sd", "min_sd", "max_sd", "aligned_length_ratio", "bases_one_to_one", "one_to_one_ratio",
    ]
    return matches.select("match_id", F.format_string(kinds, *[F.col(c) if isinstance(c, str) else c for c in columns]).alias("value"))


def write_contig_summary(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    summary.orderBy(F.col("size").desc(), "contig").write.mode(mode).option("header", "true").csv(path)


def write_matched_chunks(matches: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated lengths of inner blocks, with a header."""
    inner_chunks(matches).select("contig", "optical").write.mode(mode).option("header", "true").option("sep", "\t").csv(path)


def null_lines(null: DataFrame) -> DataFrame:
    scores = F.transform(F.sort_array(F.collect_list("score")), lambda s: s.cast("string"))
    return null.groupBy("num_frags").agg(scores.alias("s")).select(F.concat_ws(" ", F.col("num_frags").cast("string"), "s").alias("value"))


def write_enzymes(enzymes: DataFrame, path: str) -> None:
    """Never overwrites."""
    enzymes.write.mode("errorifexists").parquet(path)


def _centred(text: Column, width: Column) -> Column:
    left = F.floor((width - F.length(text)) / 2).cast("int")
    return F.rpad(F.concat(F.repeat(F.lit(" "), left), text), width, F.lit(" "))


def alignment_tables(matches: DataFrame) -> DataFrame:
    """(match_id, value): a readable table of each match's chunks, in three centred columns under a header of four lines."""
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x).cast("string")
    plus = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " + ")
    c = F.transform("alignment", lambda x: F.concat(plus(x["contig"]["frags"]), F.lit(" = "), add(x["contig"]["frags"])))
    o = F.transform("alignment", lambda x: F.when(x["is_contig_gap"], F.lit("GAP")).otherwise(F.concat(add(x["optical"]["frags"]), F.lit(" = "), plus(x["optical"]["frags"]))))
    s = F.transform("alignment", lambda x: F.format_string("%6.3f %6.3f %6.3f", x["score"]["sizing"], x["score"]["contig"], x["score"]["optical"]))
    rows = matches.withColumns({"_c": F.concat(F.array(F.lit("Query Frags")), c), "_o": F.concat(F.array(F.lit("Reference Frags")), o), "_s": F.concat(F.array(F.lit("Chunk Score")), s)})
    widest = lambda name: F.array_max(F.transform(name, lambda x: F.length(x)))
    rows = rows.withColumns({"_cw": widest("_c"), "_ow": widest("_o"), "_sw": widest("_s")})
    lines = F.transform(F.arrays_zip("_c", "_o", "_s"), lambda x: F.concat_ws(" | ", _centred(x["_c"], F.col("_cw")), _centred(x["_o"], F.col("_ow")), _centred(x["_s"], F.col("_sw"))))
    way = F.when(F.col("forward"), "Forward").otherwise("Reverse")
    head = F.concat_ws(
        "\n",
        F.format_string("%s %d %f", "contig_id", "contig_length", "pval"),
        F.concat(F.format_string("%s %d to %d ", "chromosome", "op_start_index", "op_end_index"), way),
        F.concat(F.format_string("query_coords: %s (%d, %d) (%d,%d) ", "contig_id", "c_start_index", "c_end_index", "c_start_bp", "c_end_bp"), way),
        F.format_string("ref_coords: %s (%d, %d) (%d,%d) Forward", "chromosome", "op_start_index", "op_end_index", "op_start_bp", "op_end_bp"),
    )
    return rows.select("match_id", F.concat_ws("\n", head, F.array_join(lines, "\n")).alias("value"))


def scaffold_text(rows: DataFrame, coverage: DataFrame) -> DataFrame:
    """(chromosome, value): overall figures (chromosome null), then a section for each map; ``rows`` and ``coverage`` as in :mod:`placement`."""
    line = F.format_string("%-20s\t%10d\t%-10s\t%10d\t%10d\t%10d\t%10d", "contig_id", "c_aligned_bases", "orientation", "placements", "op_start_bp", "op_end_bp", "gap_after")
    body = rows.groupBy("chromosome").agg(F.array_join(F.sort_array(F.collect_list(F.struct("op_start_bp", "match_id", line.alias("line")))).getField("line"), "\n").alias("body"))
    stars = "*" * 50
    header = "\t".join(f"{h:<{w}s}" for h, w in (("contigId", 20), ("length", 10), ("orientation", 10), ("placements", 10), ("start", 10), ("end", 10), ("gap after", 10)))
    section = F.concat(F.format_string(f"{stars}\n%s\n{stars}\nchromSize: %d coveredSize: %d coveredRatio: %6.3f\n", "chromosome", "length", "covered_size", "covered_ratio"), F.lit(header + "\n"), F.col("body"))
    sections = coverage.filter(F.col("chromosome").isNotNull()).join(body, "chromosome").select("chromosome", section.alias("value"))
    top = F.format_string(f"Total Optical Map Size: %d\nContigs Placed in Scaffold: %d\nCovered bases: %d\nCovered fraction: %8.5f\n{stars}\n", "length", "contigs_placed", "covered_size", "covered_ratio")
    return coverage.filter(F.col("chromosome").isNull()).select("chromosome", top.alias("value")).unionByName(sections)
