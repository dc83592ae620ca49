"""Placement records, joint maps and special functions."""

import math

import pytest
from pyspark.sql import functions as F

from fragloom.functions import maps as M
from fragloom.functions import probability as P
from fragloom.operators import joint
from fragloom.operators import significance as G

OPT = [(f"m{k}", i, float(1000 * (i % 5 + 1)), 0.0 if i == 12 else 50.0) for k in (1, 2) for i in range(20)]


def optical(spark):
    return spark.createDataFrame(OPT, "map_id string, place int, size double, sd double")


def records(spark, rows):
    return spark.createDataFrame(rows, "map_id string, record bigint, contig_id string, size int, forward boolean, op_start int, op_end int, optical_string string, contig_string string, sites array<int>, type string")


# A query with three sites, the fragments 3 and 4 of the map between its outer sites.
ROW = ("m1", 0, "c0", 12000, True, 2, 5, "3000 ;4000 5000 ;1000", "1500 ;4000 5000 ;1500", [1500, 5500, 10500], "MATCH")


def test_ends_and_overhangs(spark):
    r = joint.overhangs(records(spark, [ROW]), optical(spark)).first()
    assert (r.c_start, r.c_end, r.o_first, r.o_last) == (1500, 1500, 3, 5)
    assert (r.start_hang, r.end_hang) == (1500, 1500)
    back = joint.with_ends(records(spark, [(*ROW[:4], False, *ROW[5:])])).first()
    assert (back.c_start, back.c_end) == (1500, 1500)
    near = joint.with_ends(records(spark, [(*ROW[:9], [1500, 1600, 10500], "MATCH")]))
    assert near.select(joint.merged_sites(F.col("sites")).alias("s")).first().s == [1500, 10500]


def test_scaffolds_break_at_separators_and_agp(spark):
    rows = [ROW, ("m1", 1, "c1", 9000, False, 6, 9, "1 ;2 3 ;4", "1000 ;3000 4000 ;1000", [1000, 4000, 8000], "FILTER"), ("m1", 2, "c2", 9000, True, 13, 16, "1 ;2 3 ;4", "1000 ;3000 4000 ;1000", [1000, 4000, 8000], "MATCH")]
    out = joint.scaffolds(records(spark, rows), optical(spark)).orderBy("scaffold", "order").collect()
    assert [(r.scaffold, r.order, r.contig_id, r.orientation) for r in out] == [(0, 1, "c0", "BE"), (0, 2, "c1", "EB"), (1, 1, "c2", "BE")]
    span = sum(1000 * (i % 5 + 1) for i in range(5, 7))
    assert out[0].gap == max(1, span - 1500 - 1000) and out[1].gap == 0
    lines = {r.scaffold: r.value for r in joint.scaffold_lines(joint.scaffolds(records(spark, rows), optical(spark))).collect()}
    assert lines[1].startswith(">scaff1 1 9000 9000\nc2 BE 9000 0 0 MATCH")
    a = joint.agp(joint.scaffolds(records(spark, rows), optical(spark))).orderBy("object", "part_number").collect()
    assert [(r.object, r.part_number, r.component_type) for r in a] == [(0, 1, "W"), (0, 2, "N"), (0, 3, "W"), (1, 1, "W")]
    assert all(x.object_end + 1 == y.object_begin for x, y in zip(a, a[1:]) if x.object == y.object)


def test_fixpoint_places_unique_ones_in_turn(spark):
    c = [("m1", 0, "a", 0, 3, 0, 0), ("m1", 1, "b", 1, 4, 0, 0), ("m1", 2, "b", 5, 8, 0, 0), ("m1", 3, "d", 10, 13, 0, 0), ("m1", 4, "e", 15, 17, 0, 0), ("m1", 5, "e", 15, 18, 0, 0)]
    cand = spark.createDataFrame(c, "map_id string, record bigint, contig_id string, op_start int, op_end int, start_hang int, end_hang int")
    got = {r.record: r.status for r in joint.place_to_fixpoint(cand, optical(spark)).collect()}
    # a is placed first and occupies 1 and 2, so b has one place left; d meets the separator; e stays open.
    assert got == {0: "placed", 1: "conflict", 2: "placed", 3: "conflict", 4: "rest", 5: "rest"}


def walk(rows, sizes, anchor, sites):
    """Locations by walking round fragment by fragment."""
    n = len(sizes)
    at = {r["id"]: r for r in rows}
    a = at[anchor]
    way = 1 if a["fw"] else -1
    out = {}
    for r in rows:
        if r is a:
            out[r["id"]] = -r["size"]
            continue
        span, i = 0, (a["last"] if way > 0 else a["first"] - 1) % n
        end = r["first"] % n if way > 0 else (r["last"] - 1) % n
        while i != end:
            span += sizes[i]
            i = (i + way) % n
        own, other = (r["cs"], a["ce"]) if way > 0 else (r["ce"], a["cs"])
        out[r["id"]] = max(0, span - own - other)
    return out


@pytest.mark.parametrize("anchor", ["c0", "c1", "c2"])
def test_anchored_locations(spark, anchor):
    rows = [ROW, ("m1", 1, "c1", 9000, False, 8, 11, "1 ;2 3 ;4", "1000 ;3000 4000 ;1000", [1000, 4000, 8000], ""), ("m1", 2, "c2", 9000, True, 13, 16, "1 ;2 3 ;4", "1000 ;3000 4000 ;1000", [1000, 4000, 8000], "")]
    got = {r.contig_id: r for r in joint.anchored(records(spark, rows), optical(spark).filter("map_id = 'm1'"), anchor).collect()}
    plain = [{"id": r.contig_id, "size": r["size"], "fw": r.forward, "first": r.o_first, "last": r.o_last, "cs": r.c_start, "ce": r.c_end} for r in joint.with_ends(records(spark, rows), 800).collect()]
    want = walk(plain, [s for m, _, s, _ in OPT if m == "m1"], anchor, None)
    assert {k: v.loc for k, v in got.items()} == want and got[anchor].dir == "BE"


def test_merge_resolve_emit(spark):
    loc = "contig_id string, dir string, loc double, sd double"
    one = spark.createDataFrame([("a", "BE", 0.0, 1.0), ("b", "BE", 100.0, 1.0), ("c", "EB", 500.0, 1.0), ("d", "BE", 900.0, 1.0)], loc)
    two = spark.createDataFrame([("b", "BE", 110.0, 1.0), ("c", "BE", 500.0, 1.0), ("d", "BE", 2000.0, 1.0), ("e", "BE", 300.0, 1.0)], loc)
    merged = joint.merge_maps(one, two)
    assert {r.contig_id: (r.outcome, r.loc) for r in merged.collect()} == {"a": ("one", 0.0), "b": ("both", 110.0), "c": ("direction", None), "d": ("location", None), "e": ("two", 300.0)}
    rest1 = spark.createDataFrame([("c", "BE", 700.0, 1.0), ("a", "BE", 5.0, 1.0)], loc)
    rest2 = spark.createDataFrame([("c", "BE", 710.0, 1.0), ("c", "EB", 701.0, 1.0), ("a", "BE", 5.0, 1.0)], loc)
    assert [tuple(r) for r in joint.resolve_ambiguous(rest1, rest2, merged).collect()] == [("c", "BE", 710.0, 1.0)]
    placed = spark.createDataFrame([("s", "x", "BE", 0.0, 1.0, 100), ("s", "y", "BE", 50.0, 1.0, 20), ("s", "z", "EB", 95.0, 1.0, 100), ("s", "w", "BE", 300.0, 1.0, 10)], "scaffold string, contig_id string, dir string, loc double, sd double, size int")
    out = joint.emit_ordered(placed).orderBy("order").collect()
    assert [(r.contig_id, r.gap) for r in out] == [("x", 1), ("z", 105), ("w", 0)]


def test_all_anchors_are_tried_at_once(spark):
    rows = [ROW, ("m1", 1, "c1", 9000, False, 8, 11, "1 ;2 3 ;4", "1000 ;3000 4000 ;1000", [1000, 4000, 8000], ""), ("m1", 2, "c2", 9000, True, 13, 16, "1 ;2 3 ;4", "1000 ;3000 4000 ;1000", [1000, 4000, 8000], "")]
    two = [("m2", *r[1:]) for r in rows[:2]]
    opt = optical(spark)
    one_map, two_map = opt.filter("map_id = 'm1'"), opt.filter("map_id = 'm2'")
    got = {r.anchor: r for r in joint.try_anchors(records(spark, rows), one_map, records(spark, two), two_map).collect()}
    assert set(got) == {"c0", "c1"}  # c2 is on one map only
    for a in got:
        merged = joint.merge_maps(joint.anchored(records(spark, rows), one_map, a), joint.anchored(records(spark, two), two_map, a)).collect()
        sizes = {"c0": 12000, "c1": 9000, "c2": 9000}
        placed = spark.createDataFrame([("s", r.contig_id, r.dir, r.loc, r.sd, sizes[r.contig_id]) for r in merged if r.loc is not None], "scaffold string, contig_id string, dir string, loc double, sd double, size int")
        kept = joint.emit_ordered(placed).collect()
        assert (got[a].contigs, got[a].bases) == (len(kept), sum(r["size"] for r in kept))
        assert got[a].direction_mismatch == sum(r.outcome == "direction" for r in merged)
    assert joint.try_anchors(records(spark, rows), one_map, records(spark, two).limit(0), two_map).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_ordered_scan_against_a_loop(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(3)}", f"c{k}", "BE", float(rng.randrange(0, 4000)), float(rng.randrange(0, 9)), rng.randrange(1, 300)) for k in range(120)]
    want = {}
    for s in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[3], r[1])):
            end = kept[-1][3] + kept[-1][5] if kept else None
            if not kept or r[3] >= end or (r[3] + r[5] > end and r[3] + 12 * (r[4] + kept[-1][4]) > end):
                kept.append(r)
        want[s] = [r[1] for r in kept]
    out = joint.emit_ordered(spark.createDataFrame(rows, "scaffold string, contig_id string, dir string, loc double, sd double, size int")).collect()
    assert {s: [r.contig_id for r in sorted(out, key=lambda r: r.order) if r.scaffold == s] for s in want} == want


@pytest.mark.parametrize("seed", range(4))
def test_greedy_choices_against_loops(spark, seed):
    import random

    from fragloom.operators import align
    from fragloom.operators import placement as PL

    rng = random.Random(seed)
    rows = []
    for k in range(150):
        a = rng.randrange(0, 400)
        rows.append((f"m{k:03}", f"chr{rng.randrange(2)}", a, a + rng.choice([0, 1, 5, 30, 60]), float(rng.randrange(20)), rng.randrange(40)))
    df = spark.createDataFrame(rows, "match_id string, chromosome string, op_start_bp int, op_end_bp int, score double, c_aligned_bases int").withColumns({"op_start_index": F.col("op_start_bp"), "op_end_index": F.col("op_end_bp")})

    def loop(order, clash, most=10**9):
        kept = []
        for r in sorted(rows, key=order):
            if sum(x[1] == r[1] for x in kept) < most and not any(x[1] == r[1] and clash(r, x) for x in kept):
                kept.append(r)
        return sorted(r[0] for r in kept)

    ids = lambda out: sorted(r.match_id for r in out.select("match_id").collect())
    by_bases = lambda r: (-r[5], [-ord(c) for c in r[0]])
    assert ids(PL.tiling(df, "one-sided")) == loop(by_bases, lambda x, y: not (x[2] <= y[3] or x[3] <= y[2]))
    assert ids(PL.tiling(df, "interval")) == loop(by_bases, lambda x, y: not (x[3] <= y[2] or x[2] >= y[3]))
    by_score = lambda r: (-r[4], r[2], r[3], r[0])
    assert ids(align.non_overlapping(df, ["chromosome"])) == loop(by_score, lambda x, y: not (x[3] <= y[2] or x[2] >= y[3]))
    assert ids(align.non_overlapping(df, ["chromosome"], 5)) == loop(by_score, lambda x, y: not (x[3] <= y[2] or x[2] >= y[3]), 5)
    assert ids(PL.tiling(df, allow_overlaps=True)) == sorted(r[0] for r in rows)


def test_legacy_chain(spark):
    rows = [ROW, ("m1", 1, "c1", 9000, False, 6, 9, "1 ;2 3 ;4", "1000 ;3000 4000 ;1000", [1000, 4000, 8000], ""), ("m1", 2, "c2", 9000, True, 6, 9, "1 ;2 3 ;4", "1000 ;3000 4000 ;1000", [1000, 4000, 8000], ""), ("m1", 3, "c2", 9000, True, 13, 16, "1 ;2 3 ;4", "1000 ;3000 4000 ;1000", [1000, 4000, 8000], "")]
    out = joint.legacy_chain(records(spark, rows), optical(spark).filter("map_id = 'm1'"))
    assert {r.record: r.type for r in out["records"].collect()} == {0: "MATCH", 1: "MATCH", 2: "conflict", 3: "FILTER"}
    assert [r.contig_id for r in out["scaffolds"].orderBy("scaffold", "order").collect()] == ["c0", "c1", "c2"]
    s = out["summary"].first()
    assert (s.matched, s.filtered, s.mbp) == (2, 1, pytest.approx(0.03)) and out["lines"].count() == 2
    assert {r.object for r in out["agp"].collect()} == {"m1_scaff0", "m1_scaff1"}


def test_p_values_and_starts(spark):
    null = spark.createDataFrame([(3, -1.0), (3, -2.0), (3, -2.0), (3, None), (4, 0.0)], "num_frags int, score double")
    matches = spark.createDataFrame([("a", 3, -2.0), ("b", 3, -1.0), ("c", 3, 0.0), ("d", 4, -9.0), ("e", 5, 1.0)], "match_id string, num_frags int, score double").withColumn("pval", F.lit(9.0))
    assert {r.match_id: r.pval for r in G.empirical_pvalues(matches, null).collect()} == {"a": 0.75, "b": 0.25, "c": 0.0, "d": 1.0, "e": 0.0}
    assert {r.match_id: r.pval for r in G.strict_pvalues(matches, null).collect()} == {"a": 0.25, "b": 0.0, "c": 0.0, "d": 1.0, "e": 0.0}
    shared = G.share_reaching(matches, null.withColumnRenamed("score", "null_score"), "num_frags")
    assert {r.match_id: r.share for r in shared.collect()} == {"a": 0.75, "b": 0.25, "c": 0.0, "d": 1.0, "e": None}
    names = spark.createDataFrame([(f"contig{k}", [1] * (k % 4)) for k in range(300)], "map_id string, frags array<int>")
    want, total = {}, 0
    for k in sorted(range(300), key=lambda k: f"contig{k}"):
        if k % 4:
            want[f"contig{k}"] = total
            total += k % 4
    counts = names.select("map_id", F.size("frags").alias("n")).filter("n > 0")
    assert {r.map_id: r.before for r in G._starts(counts).collect()} == want
    two = {(r.trial, r.map_id): r.frags for r in G.shuffled_maps(spark.createDataFrame([("a", [1, 2, 3]), ("b", [4, 5])], "map_id string, frags array<int>"), trials=3).collect()}
    assert len(two) == 6 and all(sorted(two[t, "a"] + two[t, "b"]) == [1, 2, 3, 4, 5] for t in range(3))


def test_long_sequences_take_linear_time(spark):
    import time

    df = spark.createDataFrame([("AC" * 1_000_000,)], "dna string")
    start = time.time()
    n, last = df.select(F.size(M.sites(F.col("dna"), "CA")), F.element_at(M.fragments(M.sites(F.col("dna"), "CA"), F.length("dna")), -1)).first()
    assert (n, last) == (999_999, 3) and time.time() - start < 60


def test_special_functions():
    for a in (0.5, 1.0, 3.7, 20.0):
        for x in (0.01, 0.5, 1.0, 5.0, 30.0):
            n = 200_000
            # Upper tail by summing the density
            top = x + 60 + 10 * a
            h = (top - x) / n
            tail = sum(math.exp(-t + (a - 1) * math.log(t) - math.lgamma(a)) for t in (x + (k + 0.5) * h for k in range(0, n, 1))) * h if a >= 1 and x >= 0.5 else None
            if tail and tail > 1e-12:
                assert P.ln_gamma_upper(a, x) == pytest.approx(math.log(tail), rel=1e-4, abs=1e-6)
    assert P.ln_gamma_upper(1.0, 2.5) == pytest.approx(-2.5) and P.ln_gamma_upper(0, 3) == 0.0
    assert P.ln_normal_tail(1.96, 0, 1) == pytest.approx(math.log(0.0249979), rel=1e-5) and math.exp(P.ln_normal_tail(-1, 0, 1)) == pytest.approx(0.8413447)
    assert P.beta_inc(2, 3, 0.4) == pytest.approx(0.5248) and P.beta_inc(1, 1, 0.3) == pytest.approx(0.3) and P.beta_inc(5, 2, 1.0) == 1.0
    assert P.ln_chi_tail(2, 3.0) == pytest.approx(-1.5)


def test_vectorised_and_likelihood(spark):
    df = spark.createDataFrame([(2.0, 3.0), (None, 1.0)], "a double, x double")
    got = [r[0] for r in df.select(P.vectorised(P.ln_gamma_upper)("a", "x")).collect()]
    assert got[0] == pytest.approx(P.ln_gamma_upper(2, 3)) and got[1] is None
    row = spark.range(1).select(P.block_likelihood(F.lit(100000), F.lit(1), F.lit(100000), F.lit(1), F.array(F.lit(100000))).alias("v"), P.block_likelihood(F.lit(0), F.lit(0), F.lit(1350), F.lit(1)).alias("lost")).first()
    want = -0.5 + math.log(0.8) - 0.5 * math.log(2 * math.pi) - math.log(math.sqrt(300 * 100000))
    assert row.v == pytest.approx(want) and row.lost == pytest.approx(math.log(0.5) + math.log(0.8))


def test_quantiles_and_pool(spark):
    df = spark.createDataFrame([("g", float(k)) for k in (1, 2, 3, 4)] + [("h", 5.0)], "g string, v double")
    got = {r.g: r.quantile for r in G.plotting_quantile(df, "g", "v", 0.5).collect()}
    assert got == {"g": pytest.approx(2.5), "h": pytest.approx(5.0)}
    c = spark.createDataFrame([("a", [1, 2, 3]), ("b", [4, 5]), ("c", [])], "map_id string, frags array<int>")
    assert sorted((r.place, r["size"]) for r in G.fragment_pool(c).collect()) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]
    assert [r["size"] for r in G.fragment_pool(c, interior=True).collect()] == [2]


def test_array_functions(spark):
    df = spark.createDataFrame([([10, 20, 30],)], "f array<int>")
    b = M.bounds(F.col("f"))
    r = df.select(b.alias("b"), M.start_bp(b, F.lit(0)).alias("s"), M.end_bp(b, F.lit(0), False).alias("e"), M.flags(F.col("f")).alias("l"), M.replaced(F.col("f"), F.array(F.lit(0), F.lit(9)), F.array(F.lit(7), F.lit(8))).alias("r"), M.count_char(F.lit("a;b;"), ";").alias("n")).first()
    assert (r.b, r.s, r.e, r.l, r.r, r.n) == ([0, 10, 30, 60], 0, 30, [True, False, True], [7, 20, 30], 2)


def test_synthetic_queries_find_their_place(spark, tmp_path):
    from fragloom.operators import placement as PL
    from fragloom.operators.align import align
    from fragloom.params import Params
    from fragloom.sources.synthetic import random_maps, sampled_contigs

    maps = random_maps(spark, 2, 120)
    again = random_maps(spark, 2, 120)
    assert sorted(maps.collect()) == sorted(again.collect())
    contigs = sampled_contigs(maps, 4, low=14, missed=0.05)
    sizes = {r.map_id: r.frags for r in maps.collect()}
    for r in contigs.collect():
        assert sum(r.frags) == sum(sizes[r.true_map][r.true_start : r.true_end]) and min(r.frags) >= 1
    best = align(contigs.select("map_id", "frags"), maps, Params(sd_max=4)).filter("rank = 1").join(contigs.withColumnRenamed("map_id", "contig_id").drop("frags"), "contig_id").collect()
    right = [r.chromosome == r.true_map and r.forward == r.true_forward and abs(r.op_start_index - r.true_start) <= 1 for r in best]
    assert len(best) == 8 and sum(right) >= 7
    assert PL.fragment_lines(maps).first().value.count("\n") == 120


def test_shuffled_maps_keep_the_pool_and_stored_tables_are_built_once(spark, tmp_path):
    from fragloom.params import Params

    maps = spark.createDataFrame([("a", [1, 2, 3]), ("b", [4, 5]), ("c", []), ("d", [6])], "map_id string, frags array<int>")
    got = {r.map_id: r.frags for r in G.shuffled_maps(maps, 3).collect()}
    assert {k: len(v) for k, v in got.items()} == {"a": 3, "b": 2, "d": 1} and sorted(x for v in got.values() for x in v) == [1, 2, 3, 4, 5, 6]
    null = G.shuffle_null(spark.createDataFrame([("q", [5000, 9000, 7000])], "map_id string, frags array<int>"), spark.createDataFrame([("m", [5000, 9000, 7000, 3000, 8000])], "map_id string, frags array<int>"), Params(trials=2))
    assert sorted(r.trial for r in null.collect()) == [0, 1]
    made = []
    build = lambda: made.append(1) or spark.range(3)
    path = str(tmp_path / "t")
    assert G.stored(spark, path, build).count() == 3 == G.stored(spark, path, build).count() and len(made) == 1
    table = G.quantile_table(spark.createDataFrame([("g", float(k)) for k in range(1, 12)], "g string, v double"), "g", "v", [0.5, 0.9]).collect()
    assert {r.q: r.quantile for r in table}[0.5] == pytest.approx(6.0)


def test_refined_lists(spark):
    from fragloom.operators import placement as PL
    from fragloom.plans import bridge

    m = bridge.matches(spark, "/root/testdata/sf0.001").withColumn("pval", F.lit(0.0))
    lists = PL.refined_lists(m)
    n = {k: v.count() for k, v in lists.items()}
    assert n["quality"] >= n["refined"] >= n["best"] >= n["unique"] and n["best"] > 0
    assert PL.length_deviations(m).filter("abs(deviation) > 100").count() == 0
    assert PL.by_contig(m).count() == m.select("contig_id").distinct().count()
