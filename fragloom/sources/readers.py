"""Readers of map, sequence, enzyme and alignment files.  All read with Spark's own sources, so any path that Spark can open will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.maps import kb_to_bp
from ..operators.align import CHUNK


def _lines(spark: SparkSession, paths: str | list[str], blank: bool = True) -> DataFrame:
    """(file, line_no, value) of all lines, numbered from 0 in their file; without ``blank``, those of white space alone are left out first.

    Large files are read in blocks.  Each block counts its lines; the sums of the blocks before it, a row for each block, give the number of its first one.
    """
    value, raw = F.regexp_replace("value", "\r$", ""), spark.read.text(paths)
    raw = raw if blank else raw.filter(F.trim(value) != "")
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), value.alias("value"))
    # A block is read by one task, line by line, so its ids have no holes: the least of them gives the number of a line within it, without a sort.
    counts = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("row").alias("least"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("path", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("least")).alias("ahead"))
    return rows.join(starts, ["path", "block"]).select("file", (F.col("ahead") + F.col("row")).alias("line_no"), "value")


def _single_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, place, value) of lines that stand alone; large files are read in parallel.  ``place`` orders the lines of a file: by block, then within it."""
    rows = spark.read.text(paths).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.rtrim("value").alias("value"))
    return rows.select("file", F.struct("block", F.monotonically_increasing_id().alias("row")).alias("place"), "value")


def read_maps(spark: SparkSession, paths: str | list[str], mode: str = "strict", circular: bool = False) -> DataFrame:
    """Tab-separated maps, one a line: id, length, number of fragments, fragments.  -> map_id, length, num_frags, frags, is_circular.

    ``strict`` raises on a line whose count is wrong; ``permissive`` keeps lines of fewer than three fields as empty maps, and drops other bad lines.  Blank
    lines are skipped.
    """
    rows = spark.read.text(paths).filter(F.trim("value") != "").select(F.split(F.rtrim("value"), "\t").alias("f"))
    few = F.size("f") < 3
    count = F.get("f", F.lit(2)).try_cast("int")
    frags = F.transform(F.slice("f", 4, F.greatest(F.size("f") - 3, F.lit(0))), lambda x: x.try_cast("int"))
    out = rows.select(
        F.get("f", F.lit(0)).alias("map_id"), F.when(few, 0).otherwise(F.get("f", F.lit(1)).try_cast("int")).alias("length"), F.when(few, 0).otherwise(count).alias("num_frags"),
        F.when(few, F.array().cast("array<int>")).otherwise(frags).alias("frags"), few.alias("few"),
    )
    good = ~F.col("few") & F.col("num_frags").isNotNull() & (F.size("frags") == F.col("num_frags")) & ~F.exists("frags", lambda x: x.isNull())
    if mode == "strict":
        checked = F.when(good, F.col("frags")).otherwise(F.raise_error(F.concat(F.lit("bad map line: "), F.coalesce("map_id", F.lit("")))))
        out = out.withColumn("frags", checked)
    elif mode == "permissive":
        out = out.filter(F.col("few") | F.coalesce(good, F.lit(False)))
    else:
        raise ValueError(mode)
    return out.drop("few").withColumn("is_circular", F.lit(circular))


def read_maps_by_id(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Maps split at any white space; of lines with the same id in a file the last one counts."""
    rows = _single_lines(spark, paths).filter(F.trim("value") != "").select("file", "place", F.split(F.trim("value"), r"\s+").alias("f"))
    last = rows.groupBy(F.get("f", F.lit(0)).alias("map_id")).agg(F.max_by("f", F.struct("file", "place")).alias("f"))
    frags = F.transform(F.slice("f", 4, F.greatest(F.size("f") - 3, F.lit(0))), lambda x: x.cast("int"))
    return last.select("map_id", F.get("f", F.lit(1)).cast("int").alias("length"), F.get("f", F.lit(2)).cast("int").alias("num_frags"), frags.alias("frags"))


def check_maps(maps: DataFrame) -> DataFrame:
    """Maps whose number of fragments or length doesn't agree with the fragments, with the reason."""
    total = F.aggregate("frags", F.lit(0).cast("bigint"), lambda a, x: a + x)
    reason = F.when(F.size("frags") != F.col("num_frags"), "count").when(total != F.col("length"), "length")
    return maps.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def read_kb_sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``size sd`` in kb, one fragment a line; the file's name is the map's id.  Sizes are rounded to bp, deviations are not kept."""
    rows = _single_lines(spark, paths).filter(F.trim("value") != "").select("file", "place", kb_to_bp(F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).cast("double"), True).alias("size"))
    return _gathered(rows.withColumnRenamed("file", "map_id"), "place")


def _gathered(rows: DataFrame, order: str, *more: str) -> DataFrame:
    """(map_id, length, num_frags, frags) of fragment rows (map_id, size, and their order)."""
    out = rows.groupBy("map_id", *more).agg(F.sort_array(F.collect_list(F.struct(order, "size"))).alias("s"), F.sum("size").cast("int").alias("length"))
    return out.select("map_id", "length", F.size("s").alias("num_frags"), F.col("s.size").alias("frags"), *more)


def read_pair_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A name line, then ``enzyme B kb kb ...``; blank lines are skipped, sizes are truncated to bp."""
    rows = _lines(spark, paths, blank=False).withColumnRenamed("line_no", "k")
    pairs = rows.groupBy("file", F.floor(F.col("k") / 2).alias("pair")).agg(F.max(F.when(F.col("k") % 2 == 0, F.trim("value"))).alias("map_id"), F.max(F.when(F.col("k") % 2 == 1, F.split(F.trim("value"), r"\s+"))).alias("f"))
    frags = F.transform(F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0))), lambda x: kb_to_bp(x.cast("double"), False))
    out = pairs.filter(F.col("f").isNotNull()).select("map_id", frags.alias("frags"), F.get("f", F.lit(0)).alias("enzyme"))
    return out.select("map_id", F.aggregate("frags", F.lit(0), lambda a, x: a + x).alias("length"), F.size("frags").alias("num_frags"), "frags", "enzyme")


def read_map_xml(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``RESTRICTION_MAP`` elements with ID and ENZYME, and fragments with S (bp) and STDDEV; those with a deviation of 0 are left out."""
    ended = spark.read.option("lineSep", "</RESTRICTION_MAP>").text(paths)  # a record for each element, read in blocks
    maps = ended.select(F.regexp_extract("value", r"(?s)(<RESTRICTION_MAP .*)", 1).alias("x")).filter("x <> ''")
    sizes = F.regexp_extract_all("x", F.lit(r'S="(\d+)" STDDEV="([\d.]+)"'), F.lit(1))
    sds = F.regexp_extract_all("x", F.lit(r'S="(\d+)" STDDEV="([\d.]+)"'), F.lit(2))
    pairs = F.filter(F.arrays_zip(sizes.alias("s"), sds.alias("d")), lambda p: p["d"].cast("double") != 0)
    frags = F.transform(pairs, lambda p: p["s"].cast("int"))
    out = maps.select(F.regexp_extract("x", r'ID="([^"]+)"', 1).alias("map_id"), frags.alias("frags"), F.regexp_extract("x", r'ENZYME="([^"]+)"', 1).alias("enzyme"))
    return out.select("map_id", F.aggregate("frags", F.lit(0), lambda a, x: a + x).alias("length"), F.size("frags").alias("num_frags"), "frags", "enzyme")


def kb_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, value): ``kb sd`` lines of a summary in text (index, size, deviation) or XML, with a separator line between maps."""
    rows = _lines(spark, paths)
    plain = F.regexp_extract("value", r"\d+\s+([\d.]+)\s+([\d.]+)", 1)
    xml = F.regexp_extract("value", r'S="(\d+)" STDDEV="([\d.]+)"', 1)
    # Whether a map has ended by a line is a matter of its file's first end, a row for each file.
    ends = rows.filter(F.contains(F.col("value"), F.lit("</RESTRICTION_MAP>"))).groupBy("file").agg(F.min("line_no").alias("end"))
    rows = rows.join(ends, "file", "left")
    lines = F.array_compact(F.array(
        F.when(plain != "", F.concat_ws(" ", plain, F.regexp_extract("value", r"\d+\s+([\d.]+)\s+([\d.]+)", 2))),
        F.when(xml != "", F.format_string("%.3f %s", xml.try_cast("double") / 1000, F.regexp_extract("value", r'S="(\d+)" STDDEV="([\d.]+)"', 2))),
        F.when((F.col("line_no") >= F.col("end")) & F.contains(F.col("value"), F.lit("<RESTRICTION_MAP")), F.lit("100.000 0.000")),
    ))
    return rows.select("file", "line_no", F.posexplode(lines).alias("k", "value"))


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(seq_id, dna): the id is the header's first word, letters are put in upper case.  Records are split by Spark, so large files are read in parallel."""
    rows = spark.read.option("lineSep", "\n>").text(paths)
    record = F.regexp_replace("value", "^>", "")
    rows = rows.select(F.regexp_extract(record, r"^[ \t]*(\S*)", 1).alias("seq_id"), F.upper(F.regexp_replace(F.regexp_replace(record, r"^[^\n]*\n?", ""), r"\s", "")).alias("dna"))
    return rows.filter((F.col("seq_id") != "") | (F.col("dna") != ""))


def read_enzymes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(enzyme, motifs): ``NAME/SEQ'/.../SEQ//`` lines, cut marks taken out, upper case; a name that comes again adds its motifs; other lines are comments."""
    rows = _single_lines(spark, paths).select("file", F.col("place").alias("line_no"), F.trim("value").alias("v")).filter(F.col("v").endswith("//") & (F.length("v") >= 2))
    f = F.split("v", "/")
    motifs = F.filter(F.transform(F.slice(f, 2, F.size(f)), lambda x: F.upper(F.replace(x, F.lit("'"), F.lit("")))), lambda x: x != "")
    each = rows.select("file", "line_no", F.upper(F.get(f, F.lit(0))).alias("enzyme"), motifs.alias("motifs"))
    return each.groupBy("enzyme").agg(F.sort_array(F.collect_list(F.struct("file", "line_no", "motifs"))).alias("s")).select("enzyme", F.flatten("s.motifs").alias("motifs"))


def motif_of(enzymes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, motif): the single plain motif of each name; an unknown name, several motifs or letters other than ACGT raise."""
    joined = names.withColumn("enzyme", F.upper("name")).join(enzymes, "enzyme", "left")
    motif = (
        F.when(F.col("motifs").isNull(), F.raise_error(F.concat(F.lit("unknown enzyme "), F.col("name"))))
        .when(F.size("motifs") != 1, F.raise_error(F.concat(F.lit("several motifs for "), F.col("name"))))
        .when(F.get("motifs", F.lit(0)).rlike("[^ACGT]"), F.raise_error(F.concat(F.lit("no plain motif for "), F.col("name"))))
        .otherwise(F.get("motifs", F.lit(0)))
    )
    return joined.select("name", motif.alias("motif"))


NUMBERS = {
    "score": "double", "pval": "double", "chi2": "double", "cStartIndex": "int", "cEndIndex": "int", "cStartBp": "int", "cEndBp": "int", "cAlignedBases": "int", "opStartIndex": "int",
    "opEndIndex": "int", "opStartBp": "int", "opEndBp": "int", "opAlignedBases": "int", "totalHits": "int", "totalMisses": "int", "totalMissRate": "double", "contigHits": "int",
    "contigMisses": "int", "contigMissRate": "double", "contigUnalignedBases": "int", "contigUnalignedBaseRatio": "double", "contigUnalignedFrags": "int", "opticalHits": "int",
    "opticalMisses": "int", "opticalMissRate": "double", "alignedLengthRatio": "double",
}
STRINGS = ("opticalMatchString", "opticalAlignedIndex", "contigMatchString", "scoreString", "contigAlignedIndex", "contigLostIndex")


def snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def _xml_side() -> str:
    return "struct<start:int,end:int,startBp:int,endBp:int,frags:struct<frag:array<int>>>"


def xml_schema() -> T.StructType:
    chunk = f"struct<contig:{_xml_side()},optical:{_xml_side()},isContigGap:string,isBoundaryChunk:string,score:struct<contig:double,optical:double,sizing:double>>"
    fields = ["contig struct<name:string,length:int>", "chromosome string", "forward string"] + [f"{k} {v}" for k, v in NUMBERS.items()] + [f"{k} string" for k in STRINGS]
    return T._parse_datatype_string(", ".join([*fields, f"alignment struct<chunk:array<{chunk}>>"]))


def read_alignments(spark: SparkSession, paths: str, quality_only: bool = False) -> DataFrame:
    """Matches of an alignment file, as :func:`align` gives them (columns in snake case, ``alignment`` as an array of chunks)."""
    raw = spark.read.format("xml").option("rowTag", "MatchResult").schema(xml_schema()).load(paths)

    def side(x: Column, name: str) -> Column:
        s = x[name]
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["startBp"].alias("start_bp"), s["endBp"].alias("end_bp"), F.coalesce(s["frags"]["frag"], F.array().cast("array<int>")).alias("frags"))

    truth = lambda c: c.isin("1", "true")
    chunks = F.transform("alignment.chunk", lambda x: F.struct(side(x, "contig").alias("contig"), side(x, "optical").alias("optical"), truth(x["isContigGap"]).alias("is_contig_gap"), truth(x["isBoundaryChunk"]).alias("is_boundary_chunk"), x["score"].alias("score")))
    out = raw.select(
        F.col("contig.name").alias("contig_id"), F.col("contig.length").alias("contig_length"), "chromosome", truth(F.col("forward")).alias("forward"),
        *[F.col(k).alias(snake(k).replace("op_", "op_", 1)) for k in NUMBERS], *[F.col(k).alias(snake(k)) for k in STRINGS], chunks.cast(T.ArrayType(CHUNK)).alias("alignment"),
    )
    aligned = F.aggregate("alignment", F.lit(0), lambda a, x: a + x["contig"]["end"] - x["contig"]["start"])
    out = out.withColumn("num_frags", aligned)
    if quality_only:
        from ..operators.placement import is_quality

        out = out.filter(is_quality())
    return out


def read_placements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of five lines: ``id size forward start end [type]``, a line that isn't used, reference string, query string, site positions."""
    rows = _lines(spark, paths)
    r = rows.groupBy("file", F.floor(F.col("line_no") / 5).alias("record")).agg(*[F.max(F.when(F.col("line_no") % 5 == k, F.col("value"))).alias(f"l{k}") for k in (0, 2, 3, 4)])
    f = F.split(F.trim("l0"), r"\s+")
    pos = F.transform(F.filter(F.split(F.trim("l4"), r"\s+"), lambda x: x != ""), lambda x: x.cast("int"))
    return r.filter(F.trim("l0") != "").select(
        "file", "record", f[0].alias("contig_id"), f[1].cast("int").alias("size"), (f[2] == "1").alias("forward"), f[3].cast("int").alias("op_start"), f[4].cast("int").alias("op_end"),
        F.get(f, F.lit(5)).alias("type"), F.col("l2").alias("optical_string"), F.col("l3").alias("contig_string"), pos.alias("sites"),
    )


def read_null_scores(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(num_frags, trial, score) of lines ``num_frags score score ...``."""
    f = F.split(F.trim("value"), r"\s+")
    # A line is split before its scores become rows, not once more for each of them.
    lines = spark.read.text(paths).filter(F.trim("value") != "").select(f[0].cast("int").alias("num_frags"), F.slice(f, 2, F.size(f)).alias("scores"))
    rows = lines.select("num_frags", F.posexplode("scores").alias("trial", "s"))
    return rows.select("num_frags", "trial", F.col("s").cast("double").alias("score"))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A summary of queries, as :func:`write_contig_summary` writes it."""
    schema = "contig string, size bigint, num_frags int, num_alignments bigint, aligned_uniquely boolean, num_chroms int, chroms string"
    return spark.read.option("header", "true").schema(schema).csv(path).withColumn("chroms", F.coalesce("chroms", F.lit("")))
