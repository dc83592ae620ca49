"""What larger tables showed: each of these failed, or grew faster than its input, before."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fragloom.operators import align, blocks, pruned, seeds
from fragloom.params import Params
from fragloom.sources import readers as R


def test_a_line_of_null_scores_is_split_once(spark, tmp_path):
    (tmp_path / "n").write_text("3 -1.5 -2.0\n4 " + " ".join(str(-k / 4) for k in range(30_000)) + "\n")
    back = R.read_null_scores(spark, str(tmp_path / "n"))
    above = back._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "split" not in above
    assert sorted((r.num_frags, r.trial, r.score) for r in back.collect()) == [(3, 0, -1.5), (3, 1, -2.0)] + [(4, k, -k / 4) for k in range(30_000)]


@pytest.mark.parametrize("local", [False, True])
def test_best_matches_come_from_a_join_of_sizes(spark, local):
    """Queries with cheap matches need neither the index's scans nor full tables, and equal maps are looked at once; the rows are those of the exhaustive operator."""
    rng = np.random.default_rng(5)
    maps = [(f"m{k}", rng.integers(2500, 90_000, 60).tolist()) for k in range(3)]
    queries = [(f"q{k}", (np.array(f[7:20]) + rng.integers(-5, 6, 13)).tolist()[:: 1 if k % 2 else -1]) for k, (_, f) in enumerate(maps)]
    queries[1] = ("q1", [*queries[1][1][:3], queries[1][1][3] + queries[1][1][4], *queries[1][1][5:]])
    copies = [(f"{name}{c}", f) for name, f in maps for c in "cab"]
    schema = "map_id string, frags array<int>"
    m, c, p = spark.createDataFrame(copies, schema), spark.createDataFrame(queries, schema), Params(sd_min=4, sd_max=4, min_hits=3, max_matches=1, local=local)
    kept = seeds.first_copies(m, None, 2)
    assert sorted(r.map_id for r in kept.collect()) == sorted(f"{name}{c}" for name, _ in maps for c in "ab")
    found = seeds.matches_within(c.selectExpr("0 as group", "map_id", "frags"), seeds.first_copies(m, None, 1), p, 5.25, 3, 8, 2).collect()
    assert {r.contig_id for r in found} == {"q0", "q1", "q2"} and {r.chromosome[-1] for r in found} == {"a"}
    shown = lambda df: sorted(repr(r.asDict(True)) for r in df.collect())
    want = align.align(c, m, p)
    assert shown(pruned.align_pruned(c, m, p).select(sorted(want.columns))) == shown(want.select(sorted(want.columns)))


def test_pairs_in_tolerance_are_counted_without_rows_for_them(spark):
    rng = np.random.default_rng(2)
    rows = lambda label, n, size: [(f"{label}{k}", rng.integers(0, 6000, size).tolist(), k % 2) for k in range(n)]
    schema = "map_id string, frags array<int>, genome int"
    c, m = spark.createDataFrame([*rows("c", 5, 9), ("none", [], 0)], schema), spark.createDataFrame([*rows("m", 4, 30), ("short", [700], 1), ("far", [10**7], 1), ("none", [], 0)], schema)
    p = Params()
    parts = lambda df: blocks.blocks(df.selectExpr("map_id", "posexplode(frags) as (frag_idx, size)"), 5).join(df.select("map_id", "genome"), "map_id")
    pairs = blocks.sizing_join(parts(c), parts(m), 4, p, by="genome")
    want = pairs.groupBy("contig_id", "map_id").agg(F.count("*").alias("n_pairs"), F.sum(F.abs(F.col("c_len") - F.col("o_len"))).alias("total_off"))
    got = blocks.sizing_counts(c, m, 4, p, 5, by="genome")
    assert "Join" in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_null_scores_look_at_equal_maps_once(spark):
    rng = np.random.default_rng(4)
    maps = [(f"m{k}", rng.integers(900, 90_000, 25).tolist()) for k in range(2)]
    queries = spark.createDataFrame([("r0", rng.integers(900, 90_000, 6).tolist()), ("r1", maps[0][1][4:12])], "map_id string, frags array<int>")
    frame = lambda rows: spark.createDataFrame(rows, "map_id string, frags array<int>")
    more = align.null_scores(queries, frame(maps + [(f"{name}c", f) for name, f in maps]), Params(sd_max=4))
    assert sorted(map(tuple, more.collect())) == sorted(map(tuple, align.null_scores(queries, frame(maps), Params(sd_max=4)).collect()))
    assert "min(map_id" in more._jdf.queryExecution().optimizedPlan().toString()


def test_batches_become_python_numbers_in_small_parts():
    batch = pa.RecordBatch.from_arrays([pa.array(range(250))], names=["x"])
    parts = list(align.in_slices(iter([batch, batch.slice(0, 0), batch.slice(0, 5)])))
    assert [x.num_rows for x in parts] == [100, 100, 50, 5] and sum((x.column(0).to_pylist() for x in parts), []) == [*range(250), *range(5)]
