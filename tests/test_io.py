"""Readers and writers: round trips and stated cases."""

import pytest
from pyspark.errors import PySparkException

from fragloom.functions import maps as M
from fragloom.sources import readers as R
from fragloom.sources import writers as W
from pyspark.sql import functions as F


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_map_file_round_trip(spark, tmp_path):
    path = put(tmp_path, "a.map", "m1\t600\t3\t100\t200\t300\nm2\t5\t1\t5\n\n")
    maps = R.read_maps(spark, path)
    assert {r.map_id: r.frags for r in maps.collect()} == {"m1": [100, 200, 300], "m2": [5]}
    W.write_maps(maps, str(tmp_path / "out"))
    assert sorted(R.read_maps(spark, str(tmp_path / "out")).collect()) == sorted(maps.collect())
    assert R.check_maps(maps).count() == 0


def test_bad_map_lines(spark, tmp_path):
    path = put(tmp_path, "a.map", "m1\t600\t2\t100\t200\t300\nshort\nm3\t7\t1\t7\n")
    with pytest.raises(PySparkException):
        R.read_maps(spark, path).collect()
    kept = {r.map_id: r.frags for r in R.read_maps(spark, path, mode="permissive").collect()}
    assert kept == {"short": [], "m3": [7]}


def test_last_line_of_an_id_counts(spark, tmp_path):
    path = put(tmp_path, "a.map", "m 3 1 3\nm 4 1 4\n")
    assert [r.frags for r in R.read_maps_by_id(spark, path).collect()] == [[4]]


def test_kb_formats(spark, tmp_path):
    kb = R.read_kb_sizes(spark, put(tmp_path, "m.opt", "1.2345 0.1\n2.0006 0.2\n")).first()
    assert (kb.map_id, kb.frags) == ("m.opt", [1235, 2001])
    pair = R.read_pair_lines(spark, put(tmp_path, "p.txt", "chr 1\n\nXhoI B 1.2349 2.0006\nchr2\nXhoI B 3\n")).orderBy("map_id").collect()
    assert [(r.map_id, r.enzyme, r.frags) for r in pair] == [("chr 1", "XhoI", [1234, 2000]), ("chr2", "XhoI", [3000])]


def test_map_xml(spark, tmp_path):
    text = '<X>\n<RESTRICTION_MAP ID="a b" ENZYME="E1" >\n<F S="1500" STDDEV="0.2"/>\n<F S="900" STDDEV="0.000"/>\n<F S="20" STDDEV="0.1"/>\n</RESTRICTION_MAP>\n<RESTRICTION_MAP ID="c" ENZYME="E1" >\n<F S="7" STDDEV="1"/>\n</RESTRICTION_MAP>\n</X>\n'
    path = put(tmp_path, "m.xml", text)
    assert {r.map_id: (r.frags, r.enzyme) for r in R.read_map_xml(spark, path).collect()} == {"a b": ([1500, 20], "E1"), "c": ([7], "E1")}
    lines = [r.value for r in R.kb_lines(spark, path).orderBy("line_no", "k").collect()]
    assert lines == ["1.500 0.2", "0.900 0.000", "0.020 0.1", "100.000 0.000", "0.007 1"]


def test_fasta_and_digestion(spark, tmp_path):
    path = put(tmp_path, "s.fa", ">one first\nacgt\nACGTT\n>two\nAAAA\n>three x\n")
    rows = {r.seq_id: r.dna for r in R.read_fasta(spark, path).collect()}
    assert rows == {"one": "ACGTACGTT", "two": "AAAA", "three": ""}
    df = spark.createDataFrame([("ACGTACGTT",), ("AAAA",), ("",), (None,), ("TTAA",), ("AA",)], "dna string")
    s = df.select("dna", M.sites(F.col("dna"), "AA").alias("aa"), M.sites(F.col("dna"), "ACG").alias("acg"), M.fragments(M.sites(F.col("dna"), "AA"), F.length("dna")).alias("f"), M.sites(F.col("dna"), "AA", 1).alias("late")).collect()
    got = {r.dna: (r.aa, r.acg, r.f, r.late) for r in s}
    assert got["AAAA"] == ([0, 1, 2], [], [0, 1, 1, 2], [1, 2]) and got["ACGTACGTT"][:3] == ([], [0, 4], []) and got["TTAA"][2] == [2, 2]
    assert got["AA"][0] == [0] and got[""][0] == [] and got[None][0] is None


def test_enzymes(spark, tmp_path):
    path = put(tmp_path, "e.txt", "comment\nXhoI/C'TCGAG//\nEcoRI/G'AATTC//\nxhoi/CTC'GAG//\nAmb/RAY//\n")
    enzymes = R.read_enzymes(spark, path)
    assert {r.enzyme: r.motifs for r in enzymes.collect()} == {"XHOI": ["CTCGAG", "CTCGAG"], "ECORI": ["GAATTC"], "AMB": ["RAY"]}
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert R.motif_of(enzymes, names("ecori")).first().motif == "GAATTC"
    for bad in ("nope", "XhoI", "amb"):
        with pytest.raises(PySparkException):
            R.motif_of(enzymes, names(bad)).collect()


def test_alignment_xml_round_trip(spark, tmp_path):
    from fragloom.plans import bridge

    m = bridge.matches(spark, "/root/testdata/sf0.001").withColumn("pval", F.lit(0.01))
    W.write_all_and_significant(m, str(tmp_path / "x"), 0.005)
    back = R.read_alignments(spark, str(tmp_path / "x_AllMatches.xml"))
    key = lambda r: (r.contig_id, r.chromosome, r.op_start_index, r.forward)
    one, two = sorted(m.collect(), key=key), sorted(back.collect(), key=key)
    assert len(one) == len(two) > 0
    for a, b in zip(one, two, strict=True):
        assert (a.score, a.chi2, a.contig_hits, a.num_frags) == (b.score, b.chi2, b.contig_hits, b.num_frags) and a.alignment == b.alignment
    strings = {r.match_id: r for r in __import__("fragloom.operators.placement", fromlist=["x"]).match_strings(m).collect()}
    assert two[0].contig_aligned_index == strings[one[0].match_id].contig_aligned_index
    assert not [p for p in (tmp_path / "x_SigMatches.xml").glob("part*") if p.read_text().count("<contig>")]


def test_reports(spark):
    from fragloom.operators import placement as P
    from fragloom.plans import bridge

    sf = "/root/testdata/sf0.001"
    m = bridge.matches(spark, sf).withColumn("pval", F.lit(0.0))
    line = W.info_lines(m).first().value.split(",")
    assert len(line) == 20 == len(W.INFO_HEADER.split(","))
    assert len(W.fixed_info_lines(P.one_to_one(m)).filter("value is not null").first().value.split("\t")) == 21
    table = W.alignment_tables(m).first().value.split("\n")
    assert len({len(x) for x in table[4:]}) == 1 and "Query Frags" in table[4]
    maps = bridge.reference_maps(spark, sf)
    tiled = P.tiling(m, "interval")
    text = W.scaffold_text(P.scaffold_rows(tiled, m), P.coverage(tiled, maps)).collect()
    assert sum(r.chromosome is None for r in text) == 1 and "Covered bases" in next(r.value for r in text if r.chromosome is None)


def test_info_files_have_headers_and_an_order(spark, tmp_path):
    from fragloom.operators import placement as P
    from fragloom.plans import bridge

    m = bridge.matches(spark, "/root/testdata/sf0.001").withColumn("pval", F.lit(0.0)).filter("rank = 1")
    W.write_info(m, str(tmp_path / "a"), P.chromosome_order())
    W.write_info(P.one_to_one(m), str(tmp_path / "b"), P.one_to_one_order(), fixed=True)
    head = [r.value for r in spark.read.text(str(tmp_path / "a" / "0")).collect()]
    assert head == [W.INFO_HEADER] and spark.read.text(str(tmp_path / "a" / "1")).count() == m.count()
    fixed = spark.read.text(str(tmp_path / "b" / "0")).first().value
    lines = [x for f in sorted((tmp_path / "b" / "1").glob("part*")) for x in f.read_text().split("\n") if x]
    assert len(fixed.split("\t")) == 21 == len(lines[0].split("\t")) and fixed.split("\t")[0] == "     contigName"
    shares = [float(x.split("\t")[-1]) for x in lines]
    assert shares == sorted(shares, reverse=True)
    strict = P.one_to_one(m).filter(P.is_strict_quality())
    assert strict.count() <= m.count() and strict.filter("one_to_one_ratio < 0.7").count() == 0
    W.write_matched_chunks(m, str(tmp_path / "c"))
    assert spark.read.option("header", "true").option("sep", "\t").csv(str(tmp_path / "c")).columns == ["contig", "optical"]
    assert P.last_by_contig(m.unionByName(m.withColumn("match_id", F.concat("contig_id", F.lit("/9"))))).select("match_id").collect() == m.select(F.concat("contig_id", F.lit("/9"))).collect()


def test_null_scores_round_trip(spark, tmp_path):
    null = spark.createDataFrame([(3, 0, -1.5), (3, 1, -2.0), (4, 0, -0.25)], "num_frags int, trial int, score double")
    W.null_lines(null).write.text(str(tmp_path / "n"))
    back = R.read_null_scores(spark, str(tmp_path / "n"))
    assert sorted((r.num_frags, r.score) for r in back.collect()) == sorted((r.num_frags, r.score) for r in null.collect())


def test_records_of_one_file_are_read_in_blocks(spark, tmp_path):
    """Pair lines, five-line records and elements that blocks cut through, with blank lines and both line ends, are the same as in one block."""
    pairs, records, xml, lines = [], [], [], []
    for k in range(400):
        pairs += [f"map {k}", *[""] * (k % 3), f"XhoI B {k}.5 {k % 7}.25"]
        records += [f"c{k} 100 {k % 2} {k} {k + 3} T{k}", "x" * (k % 50), f"{k} ;", f"; {k}", f"1 {k}"]
        xml += [f'<RESTRICTION_MAP ID="m{k}" ENZYME="E{k % 3}" >', *[f'<F S="{k + j}" STDDEV="0.{j}"/>' for j in range(k % 6)], "</RESTRICTION_MAP>"]
    read = {"pairs": R.read_pair_lines, "records": R.read_placements, "xml": R.read_map_xml, "kb": R.kb_lines}
    paths = {"pairs": put(tmp_path, "pairs.txt", "\n".join(pairs)), "records": put(tmp_path, "records.txt", "\r\n".join(records) + "\r\n"), "xml": put(tmp_path, "maps.xml", "\n".join(xml))}
    paths["kb"] = paths["xml"]
    shown = lambda name: sorted(repr(r) for r in read[name](spark, paths[name]).collect())
    whole = {name: shown(name) for name in read}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 1500)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        assert spark.read.text(paths["pairs"]).rdd.getNumPartitions() > 3
        assert {name: shown(name) for name in read} == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [len(whole[x]) for x in ("pairs", "records", "xml")] == [400, 400, 400]
    got = {r.map_id: r for r in R.read_pair_lines(spark, paths["pairs"]).collect()}
    assert got["map 9"].frags == [9500, 2250] and got["map 399"].enzyme == "XhoI"
    place = {r.contig_id: r for r in R.read_placements(spark, paths["records"]).collect()}
    assert (place["c7"].forward, place["c7"].op_end, place["c7"].type, place["c7"].sites, place["c7"].optical_string) == (True, 10, "T7", [1, 7], "7 ;")
