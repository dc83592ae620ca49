"""Registered queries on files: a table is written by a sink into the shared folder and read back by a source; the SQL is that of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maps as M
from ..functions import probability as P
from ..operators import joint, placement
from ..scratch import cut, new_path
from ..sources import readers, writers
from . import bridge
from .oracle import FRAGS, PLACEMENTS, TRUTH, on
from .registry import query

CHECK = "CAST(sum(size * (frag_idx + 1)) AS BIGINT) AS checksum"


def _checksum():
    return F.aggregate(F.transform("frags", lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("checksum")


def _written(lines: DataFrame, label: str) -> str:
    """A folder of text files with ``lines``' column value."""
    path = new_path(lines.sparkSession, label)
    lines.select("value").write.text(path)
    return path


@query(on(FRAGS, f"SELECT map_id, CAST(count(*) AS INTEGER) AS num_frags, CAST(sum(size) AS INTEGER) AS length, {CHECK} FROM frags GROUP BY 1"))
def file_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "maps")
    writers.write_maps(bridge.reference_maps(spark, sf_dir), path)
    return readers.read_maps(spark, path).select("map_id", "num_frags", "length", _checksum())


@query(on(FRAGS, f"SELECT map_id, CAST(count(*) AS INTEGER) AS num_frags, CAST(sum(size) AS INTEGER) AS length, {CHECK} FROM frags GROUP BY 1"))
def file_maps_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each map's line stands after one of the same id that doesn't count."""
    maps = bridge.reference_maps(spark, sf_dir)
    lines = writers.map_lines(maps).select(F.concat_ws("\n", F.concat_ws("\t", F.get(F.split("value", "\t"), F.lit(0)), F.lit("9\t1\t9")), "value").alias("value"))
    return readers.read_maps_by_id(spark, _written(lines, "maps-by-id")).select("map_id", "num_frags", "length", _checksum())


KB = "(CAST(size // 1000 AS VARCHAR) || '.' || lpad(CAST(size % 1000 AS VARCHAR), 3, '0'))::DOUBLE"


def _kb():
    return lambda x: F.concat(F.floor(x / 1000).cast("string"), F.lit("."), F.lpad((x % 1000).cast("string"), 3, "0"))


@query(on(FRAGS, f"SELECT map_id, 'XhoI' AS enzyme, CAST(count(*) AS INTEGER) AS num_frags, CAST(sum(trunc(1000 * {KB})) AS INTEGER) AS length, CAST(sum(CAST(trunc(1000 * {KB}) AS BIGINT) * (frag_idx + 1)) AS BIGINT) AS checksum FROM frags GROUP BY 1"))
def file_pair_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = bridge.reference_maps(spark, sf_dir)
    lines = maps.select(F.concat("map_id", F.lit("\nXhoI B "), F.array_join(F.transform("frags", _kb()), " "), F.lit("\n")).alias("value"))
    return readers.read_pair_lines(spark, _written(lines, "pairs")).select("map_id", "enzyme", "num_frags", "length", _checksum())


@query(on(FRAGS, "SELECT map_id, CAST(count(*) AS INTEGER) AS n, CAST(sum(size * (frag_idx + 1)) AS BIGINT) AS checksum FROM frags GROUP BY 1"))
def file_kb_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries with a line for each fragment (index, size, deviation), turned into lines of size and deviation; map and place are taken back from the deviation."""
    frags = bridge.frag_rows(spark, sf_dir)
    sd = F.concat(F.substring("map_id", 4, 20), F.lit("."), F.lpad((F.col("frag_idx") + 1).cast("string"), 6, "0"))
    lines = frags.select(F.concat_ws("   ", (F.col("frag_idx") + 1).cast("string"), _kb()(F.col("size")), sd).alias("value"))
    f = F.split("value", " ")
    back = readers.kb_lines(spark, _written(lines, "kb-lines")).select(F.concat(F.lit("map"), F.split(f[1], r"\.")[0]).alias("map_id"), F.split(f[1], r"\.")[1].cast("int").alias("place"), M.kb_to_bp(f[0].cast("double"), True).alias("size"))
    return back.groupBy("map_id").agg(F.count("*").cast("int").alias("n"), F.sum(F.col("size").cast("bigint") * F.col("place")).alias("checksum"))


@query(on(FRAGS, f", kept AS (SELECT map_id, size, row_number() OVER (PARTITION BY map_id ORDER BY frag_idx) - 1 AS frag_idx FROM frags WHERE frag_idx % 7 <> 0) SELECT map_id, 'E1' AS enzyme, CAST(count(*) AS INTEGER) AS num_frags, CAST(sum(size) AS INTEGER) AS length, {CHECK} FROM kept GROUP BY 1"))
def file_map_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh fragment has a deviation of 0 and is left out."""
    maps = bridge.reference_maps(spark, sf_dir)
    body = F.array_join(F.transform("frags", lambda x, i: F.concat(F.lit('<F S="'), x.cast("string"), F.lit('" STDDEV="'), F.when(i % 7 == 0, "0.000").otherwise("0.150"), F.lit('"/>'))), "\n")
    lines = maps.select(F.concat(F.lit('<RESTRICTION_MAP ID="'), "map_id", F.lit('" ENZYME="E1" >\n'), body, F.lit("\n</RESTRICTION_MAP>")).alias("value"))
    return readers.read_map_xml(spark, _written(lines, "map-xml")).select("map_id", "enzyme", "num_frags", "length", _checksum())


DNA = "upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g'))"


@query(f"""WITH d AS (SELECT doc_id, {DNA} AS dna FROM documents),
s AS (SELECT doc_id, dna, p FROM d, unnest(range(greatest(length(dna) - 2, 0))) u(p) WHERE substr(dna, p + 1, 3) = 'GAT'),
f AS (SELECT doc_id, p - lag(p, 1, 0) OVER (PARTITION BY doc_id ORDER BY p) AS size FROM s UNION ALL SELECT doc_id, max(length(dna)) - max(p) FROM s GROUP BY doc_id)
SELECT 'doc' || doc_id AS map_id, length(dna) AS length, CAST(coalesce(n, 0) AS INTEGER) AS num_frags, coalesce(longest, 0) AS longest FROM d LEFT JOIN (SELECT doc_id, count(*) AS n, CAST(max(size) AS INTEGER) AS longest FROM f GROUP BY 1) USING (doc_id)""")
def file_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences, made of the texts' letters, in lines of 60, read and digested."""
    from ..cli import digest

    docs = bridge.table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTacgt]", "").alias("dna"))
    lines = docs.select(F.concat(F.lit(">doc"), F.col("doc_id").cast("string"), F.lit(" a sequence\n"), F.regexp_replace("dna", "(.{60})", "$1\n")).alias("value"))
    maps = digest(readers.read_fasta(spark, _written(lines, "fasta")), "GAT")
    return maps.select("map_id", "length", "num_frags", F.coalesce(F.array_max("frags"), F.lit(0)).alias("longest"))


MOTIF = "translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ACGTACGTAC')"


@query(f"SELECT 'ENZ' || p_partkey % 97 AS enzyme, CAST(count(*) AS INTEGER) AS n_motifs, string_agg({MOTIF}, ',' ORDER BY p_partkey) AS motifs FROM part GROUP BY 1")
def file_enzymes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enzyme lines in one file, in order; the cut mark goes, a name that comes again adds its motif; then the enzyme table as it is stored."""
    part = bridge.table(spark, sf_dir, "part").select("p_partkey", F.translate(F.col("p_partkey").cast("string"), "0123456789", "ACGTACGTAC").alias("m"))
    line = F.concat(F.lit("enz"), (F.col("p_partkey") % 97).cast("string"), F.lit("/"), F.substring("m", 1, 1), F.lit("'"), F.substring("m", 2, 40), F.lit("//"))
    read = readers.read_enzymes(spark, _written(part.orderBy("p_partkey").select(line.alias("value")).coalesce(1), "enzymes"))
    path = new_path(spark, "enzyme-table")
    writers.write_enzymes(read, path)
    return spark.read.parquet(path).select("enzyme", F.size("motifs").alias("n_motifs"), F.array_join("motifs", ",").alias("motifs"))


@query(f"SELECT p_partkey, 'enz' || p_partkey AS name, {MOTIF} AS motif FROM part")
def file_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each enzyme's one motif, looked up by its name in a list that was written and read."""
    part = bridge.table(spark, sf_dir, "part").select("p_partkey", F.translate(F.col("p_partkey").cast("string"), "0123456789", "ACGTACGTAC").alias("m"))
    lines = part.select(F.concat(F.lit("Enz"), F.col("p_partkey"), F.lit("/'"), "m", F.lit("//")).alias("value"))
    names = part.select(F.concat(F.lit("enz"), F.col("p_partkey")).alias("name"))
    found = readers.motif_of(readers.read_enzymes(spark, _written(lines, "motifs")), names)
    return found.select(F.substring("name", 4, 20).cast("bigint").alias("p_partkey"), "name", "motif")


@query(on(TRUTH, " SELECT CAST(c AS INTEGER) AS contig, CAST(o AS INTEGER) AS optical, count(*) AS n FROM truth WHERE NOT boundary GROUP BY 1, 2"))
def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of inner blocks, written as a tab-separated table and read back."""
    path = new_path(spark, "chunks")
    writers.write_matched_chunks(bridge.best(spark, sf_dir), path)
    back = spark.read.option("header", "true").option("sep", "\t").schema("contig int, optical int").csv(path)
    return back.groupBy("contig", "optical").agg(F.count("*").alias("n"))


@query(on(PLACEMENTS, "SELECT contig_id, num_frags AS size, forward, op_start_index AS op_start, op_end_index AS op_end, 'MATCH' AS type, num_frags || ' ;' AS optical_string, ';' || num_frags AS contig_string, [1, num_frags] AS sites FROM matches"))
def file_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of five lines."""
    m = bridge.placements(spark, sf_dir)
    n = F.col("num_frags").cast("string")
    head = F.concat_ws(" ", "contig_id", n, F.when(F.col("forward"), "1").otherwise("0"), F.col("op_start_index").cast("string"), F.col("op_end_index").cast("string"), F.lit("MATCH"))
    lines = m.select(F.concat_ws("\n", head, F.lit("not used"), F.concat(n, F.lit(" ;")), F.concat(F.lit(";"), n), F.concat(F.lit("1 "), n)).alias("value"))
    return readers.read_placements(spark, _written(lines, "placements")).drop("file", "record")


@query("SELECT CAST(10 + k % 5 AS INTEGER) AS num_frags, -(k * 7 % 50) / 4.0::DOUBLE AS score, count(*) AS n FROM (SELECT p_partkey AS k FROM part) GROUP BY 1, 2")
def file_null_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    null = bridge.table(spark, sf_dir, "part").select((10 + k % 5).cast("int").alias("num_frags"), (-(k * 7 % 50) / 4.0).alias("score"))
    back = readers.read_null_scores(spark, _written(writers.null_lines(null), "null-scores"))
    return back.groupBy("num_frags", (F.col("score") + 0.0).alias("score")).agg(F.count("*").alias("n"))


SUMMARY = "SELECT 'contig' || m.suppkey AS contig, m.length AS size, m.num_frags, coalesce(c.n, 0) AS num_alignments, coalesce(c.n, 0) = 1 AS aligned_uniquely, CAST(coalesce(c.k, 0) AS INTEGER) AS num_chroms, coalesce(c.chroms, '') AS chroms FROM maps m LEFT JOIN c ON c.contig_id = 'contig' || m.suppkey"


@query(on(PLACEMENTS, ", c AS (SELECT contig_id, count(*) AS n, count(DISTINCT chromosome) AS k, string_agg(DISTINCT chromosome, ';' ORDER BY chromosome) AS chroms FROM matches WHERE pval <= 0.05 GROUP BY 1) " + SUMMARY))
def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = placement.significant(bridge.placements(spark, sf_dir))
    contigs = bridge.reference_maps(spark, sf_dir).withColumn("map_id", F.concat(F.lit("contig"), F.col("suppkey")))
    path = new_path(spark, "summary")
    writers.write_contig_summary(placement.contig_summary(contigs, few), path)
    return readers.read_summary(spark, path)


@query(on(TRUTH, """ SELECT contig_id, chromosome, forward, CAST(min(o_start) AS INTEGER) AS op_start_index, CAST(max(o_end) - 1 AS INTEGER) AS op_end_index, CAST(max(m) AS INTEGER) AS num_frags, CAST(max(m) - 1 AS INTEGER) AS contig_hits,
  CAST(sum(c) AS INTEGER) AS c_aligned_bases, CAST(count(*) AS INTEGER) AS n_chunks, CAST(sum(o) AS BIGINT) AS optical_bases, string_agg(CAST(i AS VARCHAR), ';' ORDER BY i) AS contig_aligned_index FROM truth GROUP BY 1, 2, 3"""))
def file_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best placements, written as alignment XML and read back."""
    path = new_path(spark, "alignments")
    writers.write_alignments(bridge.best(spark, sf_dir), path)
    back = readers.read_alignments(spark, path)
    bases = F.aggregate("alignment", F.lit(0).cast("bigint"), lambda a, x: a + F.aggregate(x["optical"]["frags"], F.lit(0).cast("bigint"), lambda b, y: b + y))
    return back.select("contig_id", "chromosome", "forward", "op_start_index", "op_end_index", "num_frags", "contig_hits", "c_aligned_bases", F.size("alignment").alias("n_chunks"), bases.alias("optical_bases"), "contig_aligned_index")


# -- special functions and placement records


#: Degrees 2 to 20 and arguments of either side of the two expansions; tails of normals by Simpson's rule; beta functions of whole numbers as sums.
SPECIAL = """WITH p AS (SELECT p_partkey, p_size AS x, 1 + p_partkey % 10 AS k, 1 + p_partkey % 7 AS a, 1 + p_size % 5 AS b, (p_partkey % 161 - 80) / 20.0::DOUBLE AS z FROM part),
f AS (SELECT list_prepend(1.0::DOUBLE, list_transform(range(1, 30), lambda n: list_product(list_transform(range(1, n + 1), lambda i: CAST(i AS DOUBLE))))) AS f)
SELECT p_partkey, round(-x / 2.0::DOUBLE + ln(list_sum(list_transform(range(0, k), lambda i: power(x / 2.0::DOUBLE, i) / f[i + 1]))) - ln(f[k]) + 1e-9::DOUBLE, 6) AS chi_tail,
  round(lgamma(x / 2.0::DOUBLE) + 1e-9::DOUBLE, 6) AS gamma,
  round(list_sum(list_transform(range(a, a + b), lambda j: f[a + b] / (f[j + 1] * f[a + b - j]) * power(x / 51.0::DOUBLE, j) * power(1 - x / 51.0::DOUBLE, a + b - 1 - j))) + 1e-9::DOUBLE, 6) AS beta,
  round(ln(0.5::DOUBLE - z / 1000 / 3 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 1001), lambda i: (CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(z * i / 1000, 2) / 2)))) + 1e-9::DOUBLE, 5) AS normal_tail
FROM p, f"""


@query(SPECIAL)
def special_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tails of chi squared of even degrees and of normals, the gamma function, and beta functions of whole numbers, where other ways lead to the same values."""
    k, x = F.col("p_partkey"), F.col("p_size").cast("double")
    part = bridge.table(spark, sf_dir, "part").select("p_partkey", x.alias("x"), (2.0 * (1 + k % 10)).alias("df"), (1 + k % 7).cast("double").alias("a"), (1 + F.col("p_size") % 5).cast("double").alias("b"), ((k % 161 - 80) / 20.0).alias("z"))
    shown = lambda c, digits=6: F.round(c + 1e-9, digits)
    return part.select(
        "p_partkey", shown(P.vectorised(P.ln_chi_tail)("df", "x")).alias("chi_tail"), shown(P.vectorised(P.ln_gamma)(F.col("x") / 2)).alias("gamma"),
        shown(P.vectorised(P.beta_inc)("a", "b", F.col("x") / 51)).alias("beta"), shown(P.vectorised(P.ln_normal_tail)("z", F.lit(0.0), F.lit(1.0)), 5).alias("normal_tail"),
    )


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Placement records with three sites each, and the optical maps with a separator at every hundredth fragment, which are written: all steps read them."""
    m = bridge.placements(spark, sf_dir).filter("pval <= 0.04")
    number = F.row_number().over(bridge.Window.partitionBy("chromosome").orderBy("match_id")) - 1
    records = m.select(
        F.col("chromosome").alias("map_id"), number.cast("bigint").alias("record"), "contig_id", F.lit(12000).alias("size"), "forward", F.col("op_start_index").alias("op_start"), F.col("op_end_index").alias("op_end"),
        F.lit("3000 ;4000 5000 ;1000").alias("optical_string"), F.lit("1500 ;4000 5000 ;1500").alias("contig_string"), F.array(*[F.lit(x) for x in (1500, 5500, 10500)]).alias("sites"), F.lit("").alias("type"),
    )
    place = F.col("frag_idx")
    optical = bridge.frag_rows(spark, sf_dir).select("map_id", place.alias("place"), F.col("size").cast("double").alias("size"), F.when(place % 100 == 99, 0.0).otherwise(50.0).alias("sd"))
    return records, cut(optical, "optical")


#: Four kinds of records: the strings, the sites of matched fragments, and, as the SQL states it, the query bp outside the outermost matched sites forward and reversed, and the
#: map's fragments before the first and the last matched site.
KINDS = (
    ("3000 ;4000 5000 ;1000", "1500 ;4000 5000 ;1500", (1500, 5500, 10500), (1500, 1500), (1500, 1500), (1, 3)),
    ("3000 2000 ;4000 5000 ;1000 900", "500 1500 ;4000 ;3000 3000", (500, 2000, 6000, 9000), (2000, 6000), (6000, 2000), (2, 4)),
    ("3000 ;4000 5000 ;1000", "1500 ;4000 5000 ;1500", (1500, 1900, 5500, 10500), (1500, 1500), (1500, 1500), (1, 3)),
    ("3000 ;4000 5000 ;1000", "9000 ;1000 1500 ;500", (9000, 10000, 11500), (9000, 500), (500, 9000), (1, 3)),
)


def _ambiguous(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Placement records of four kinds, crowded into the first fragments of each map, where neighbouring suppliers' queries go by one name; and the maps."""
    _, optical = _records(spark, sf_dir)
    m = bridge.placements(spark, sf_dir)
    k = F.substring("contig_id", 7, 20).cast("bigint")
    number = F.row_number().over(bridge.Window.partitionBy("chromosome").orderBy("match_id")) - 1
    of = lambda i, shown: F.element_at(F.array(*[shown(x[i]) for x in KINDS]), (F.pmod(k, F.lit(4)) + 1).cast("int"))
    start = F.pmod("op_start_index", F.lit(50))
    rows = m.select(
        F.col("chromosome").alias("map_id"), number.cast("bigint").alias("record"), F.concat(F.lit("contig"), F.floor(k / 6)).alias("contig_id"), F.lit(12000).alias("size"), "forward", start.alias("op_start"),
        (start + F.col("op_end_index") - F.col("op_start_index")).alias("op_end"), of(0, F.lit).alias("optical_string"), of(1, F.lit).alias("contig_string"),
        of(2, lambda x: F.array(*[F.lit(v) for v in x])).alias("sites"), F.lit("").alias("type"),
    )
    return rows, optical


def _turns_sql(select: str) -> str:
    """The turns of each map as a recursion on its state: sizes, deviations, fixed records still to come, open ones, and the one placed last."""
    by_kind = ", ".join(f"({i}, {fw[0]}, {fw[1]}, {rv[0]}, {rv[1]}, {at[0]}, {at[1]})" for i, (_, _, _, fw, rv, at) in enumerate(KINDS))
    room = lambda a, b: f"coalesce(list_sum(list_transform(range({a}, {b}), lambda k: sz[k + 1])), 0) + 12 * sqrt(coalesce(list_sum(list_transform(range({a}, {b}), lambda k: sd[k + 1] * sd[k + 1])), 0))"
    head = lambda r: f"greatest(0, trunc({r}.cs - ({room(f'{r}.s + 1', f'{r}.o1')})))"
    tail = lambda r: f"greatest(0, trunc({r}.ce - ({room(f'{r}.o2', f'{r}.e')})))"
    return f"""WITH RECURSIVE {PLACEMENTS},
kinds(kind, fs, fe, rs, re, o1, o2) AS (VALUES {by_kind}),
rec AS (SELECT chromosome AS map_id, row_number() OVER (PARTITION BY chromosome ORDER BY match_id) - 1 AS record, CAST(substr(contig_id, 7) AS BIGINT) AS k, forward, op_start_index % 50 AS s, op_start_index % 50 + op_end_index - op_start_index AS e FROM matches),
full_ AS (SELECT map_id, CAST(record AS BIGINT) AS record, 'contig' || (k // 6) AS contig_id, forward, s, e, CASE WHEN forward THEN fs ELSE rs END AS cs, CASE WHEN forward THEN fe ELSE re END AS ce, s + o1 AS o1, s + o2 AS o2,
  count(*) OVER (PARTITION BY map_id, k // 6) AS copies FROM rec JOIN kinds ON kind = k % 4),
packed AS (SELECT map_id, list(struct_pack(record, contig_id, s, e, cs, ce, o1, o2) ORDER BY record) FILTER (copies = 1) AS fixed, list(struct_pack(record, contig_id, s, e, cs, ce, o1, o2) ORDER BY record) FILTER (copies > 1) AS open FROM full_ GROUP BY 1),
state AS (SELECT map_id, list(CAST(size AS DOUBLE) ORDER BY frag_idx) AS sz, list(CASE WHEN frag_idx % 100 = 99 THEN 0.0::DOUBLE ELSE 50.0::DOUBLE END ORDER BY frag_idx) AS sd FROM frags GROUP BY 1),
turns AS (
  SELECT map_id, 0 AS t, sz, sd, coalesce(fixed, []) AS fixed, coalesce(open, []) AS open, -1::BIGINT AS one, FALSE AS was_fixed, TRUE AS more FROM state JOIN packed USING (map_id)
  UNION ALL
  SELECT map_id, t + 1,
    CASE WHEN r IS NULL THEN sz ELSE list_transform(sz, lambda x, i: CASE WHEN i = r.s + 1 THEN greatest(x - hs, 0) WHEN i = r.e + 1 THEN greatest(x - he, 0) ELSE x END) END,
    CASE WHEN r IS NULL THEN sd ELSE list_transform(sd, lambda x, i: CASE WHEN i > r.s + 1 AND i < r.e + 1 THEN 0.0::DOUBLE ELSE x END) END,
    fixed[2:], CASE WHEN r IS NULL OR len(fixed) > 0 THEN stay ELSE list_filter(stay, lambda x: x.record <> r.record) END, coalesce(r.record, -1), len(fixed) > 0, r IS NOT NULL
  FROM (SELECT *, {head("r")} AS hs, {tail("r")} AS he FROM (
    SELECT *, CASE WHEN len(fixed) > 0 THEN fixed[1] ELSE list_filter(stay, lambda x: len(list_filter(stay, lambda y: y.contig_id = x.contig_id)) = 1)[1] END AS r FROM (
      SELECT *, CASE WHEN len(fixed) > 0 THEN open ELSE list_filter(open, lambda x: NOT (len(list_filter(range(x.s, x.e + 1), lambda k: sd[k + 1] = 0)) > 0
        OR sz[x.s + 1] + 12 * sd[x.s + 1] < {head("x")} OR sz[x.e + 1] + 12 * sd[x.e + 1] < {tail("x")})) END AS stay FROM turns WHERE more)))),
ended AS (SELECT map_id, unnest(list_transform(open, lambda x: x.record)) AS record FROM turns WHERE NOT more),
typed AS (SELECT f.*, CASE WHEN t.was_fixed THEN 'MATCH' WHEN t.one IS NOT NULL THEN 'FILTER' WHEN e.record IS NOT NULL THEN 'rest' ELSE 'conflict' END AS type
  FROM full_ f LEFT JOIN turns t ON t.map_id = f.map_id AND t.one = f.record LEFT JOIN ended e ON e.map_id = f.map_id AND e.record = f.record){select}"""


@query(_turns_sql(" SELECT map_id, record, contig_id, type FROM typed"))
def legacy_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each ambiguous placement record: placed at once, placed in turns, in conflict, or left over."""
    return joint.placed_records(*_ambiguous(spark, sf_dir)).select("map_id", "record", "contig_id", "type")


@query(_turns_sql(""", p AS (SELECT map_id, record, contig_id, forward, s, cs, ce, z.end_bp - z.size AS b1, y.end_bp - y.size AS b2, o1 // 100 AS z1, o2 // 100 AS z2
  FROM typed t JOIN ends z USING (map_id) JOIN ends y USING (map_id) WHERE type IN ('MATCH', 'FILTER') AND z.frag_idx = o1 AND y.frag_idx = o2),
g AS (SELECT *, coalesce(z1 > lag(z2) OVER w, TRUE) AS breaks, greatest(1, greatest(0, b1 - lag(b2) OVER w) - lag(ce) OVER w - cs) AS gap_in FROM p WINDOW w AS (PARTITION BY map_id ORDER BY s, record)),
h AS (SELECT *, sum(CAST(breaks AS INTEGER)) OVER (PARTITION BY map_id ORDER BY s, record) - 1 AS scaffold FROM g),
r AS (SELECT map_id || '_scaff' || scaffold AS object, contig_id, forward, row_number() OVER w AS o, coalesce(lead(gap_in) OVER w, 0) AS gap FROM h WINDOW w AS (PARTITION BY map_id, scaffold ORDER BY s, record)),
q AS (SELECT object, o, 0 AS k, contig_id, forward, 12000 AS span FROM r UNION ALL SELECT object, o, 1, contig_id, forward, gap FROM r WHERE gap > 0)
SELECT object, CAST(sum(span) OVER w - span + 1 AS BIGINT) AS object_begin, CAST(sum(span) OVER w AS BIGINT) AS object_end, CAST(row_number() OVER w AS INTEGER) AS part_number, CASE k WHEN 0 THEN 'W' ELSE 'N' END AS component_type,
  CASE k WHEN 0 THEN contig_id ELSE CAST(span AS VARCHAR) END AS component, CASE k WHEN 0 THEN '1' ELSE 'fragment' END AS component_begin, CASE k WHEN 0 THEN '12000' ELSE 'No' END AS component_end,
  CASE k WHEN 0 THEN CASE WHEN forward THEN '+' ELSE '-' END ELSE '' END AS orientation
FROM q WINDOW w AS (PARTITION BY object ORDER BY o, k)"""))
def legacy_scaffolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain from placement records over the fixpoint to scaffolds, as AGP rows."""
    return joint.legacy_chain(*_ambiguous(spark, sf_dir))["agp"]


@query(_turns_sql(""", p AS (SELECT map_id, record, contig_id, forward, type, s, cs, ce, z.end_bp - z.size AS b1, y.end_bp - y.size AS b2, o1, o2, o1 // 100 AS z1, o2 // 100 AS z2
  FROM typed t JOIN ends z USING (map_id) JOIN ends y USING (map_id) WHERE type IN ('MATCH', 'FILTER') AND z.frag_idx = o1 AND y.frag_idx = o2),
g AS (SELECT *, coalesce(z1 > lag(z2) OVER w, TRUE) AS breaks, greatest(1, greatest(0, b1 - lag(b2) OVER w) - lag(ce) OVER w - cs) AS gap_in,
  trunc(sqrt(greatest(0, o1 - z1 - lag(o2 - z2) OVER w) * 2500.0::DOUBLE)) AS sd_in FROM p WINDOW w AS (PARTITION BY map_id ORDER BY s, record)),
h AS (SELECT *, sum(CAST(breaks AS INTEGER)) OVER (PARTITION BY map_id ORDER BY s, record) - 1 AS scaffold FROM g),
r AS (SELECT *, row_number() OVER w AS o, coalesce(lead(gap_in) OVER w, 0) AS gap, CAST(coalesce(lead(sd_in) OVER w, 0) AS INTEGER) AS gap_sd FROM h WINDOW w AS (PARTITION BY map_id, scaffold ORDER BY s, record))
SELECT map_id, CAST(r.scaffold AS BIGINT) AS scaffold, '>scaff' || r.scaffold || ' ' || count(*) || ' ' || 12000 * count(*) || ' ' || CAST(12000 * count(*) + sum(gap) AS BIGINT) || chr(10)
  || string_agg(contig_id || ' ' || CASE WHEN forward THEN 'BE' ELSE 'EB' END || ' 12000 ' || gap || ' ' || gap_sd || ' ' || type, chr(10) ORDER BY o) AS value FROM r GROUP BY map_id, r.scaffold"""))
def legacy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scaffolds as their text: a header and a line for each query, with gaps and their deviations."""
    return joint.legacy_chain(*_ambiguous(spark, sf_dir))["lines"].withColumn("scaffold", F.col("scaffold").cast("bigint"))


@query()
def joint_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All anchors that both of two maps place, tried in one plan."""
    records, optical = _records(spark, sf_dir)
    return joint.try_anchors(records.filter("forward"), optical, records.filter("NOT forward"), optical)


@query(on(PLACEMENTS, """, boxes AS (SELECT map_id, 'fragment' AS kind, end_bp - size AS a, size FROM ends
  UNION ALL SELECT chromosome, 'contig', e.end_bp - e.size, 12000 FROM matches JOIN ends e ON e.map_id = chromosome AND e.frag_idx = op_start_index WHERE pval <= 0.04)
SELECT map_id, kind, CAST(floor(a / 1000000) AS BIGINT) AS page_row, count(*) AS boxes, CAST(sum(size) AS BIGINT) AS bp, CAST(sum(a % 1000000) AS BIGINT) AS lefts, CAST(max(floor(a / 1000000) * 3 + CASE kind WHEN 'contig' THEN 1 ELSE 0 END) AS DOUBLE) AS y FROM boxes GROUP BY 1, 2, 3"""))
def figure_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout of the maps' fragments and of placed queries in rows of a million bp, counted back."""
    records, optical = _records(spark, sf_dir)
    boxes = joint.figure_layout(records, optical)
    bp = lambda c: F.round(F.sum(c) * 100).cast("bigint")
    return boxes.groupBy("map_id", "kind", "page_row").agg(F.count("*").alias("boxes"), bp(F.col("x1") - F.col("x0")).alias("bp"), bp(F.col("x0")).alias("lefts"), F.max("y").alias("y"))


@query(on(FRAGS, "SELECT map_id, CAST(frag_idx AS INTEGER) AS frag_idx, frag_idx = 0 OR frag_idx = num_frags - 1 AS at_end, size FROM frags JOIN maps USING (map_id) WHERE frag_idx < 3 OR frag_idx >= num_frags - 3"))
def map_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last fragments of each map are marked; the three at each end are shown."""
    maps = bridge.reference_maps(spark, sf_dir).withColumn("flags", M.flags(F.col("frags")))
    rows = maps.select("map_id", "num_frags", F.posexplode(F.arrays_zip("frags", "flags")).alias("frag_idx", "x"))
    return rows.filter((F.col("frag_idx") < 3) | (F.col("frag_idx") >= F.col("num_frags") - 3)).select("map_id", "frag_idx", F.col("x.flags").alias("at_end"), F.col("x.frags").alias("size"))
