"""What the fourth round's review showed on larger tables: each of these failed, or took more than it had to, before."""

import numpy as np
import pytest

from fragloom.operators import seeds
from fragloom.params import Params


@pytest.mark.parametrize("local", [False, True])
def test_segments_are_looked_up_in_blocks_of_maps(spark, local):
    """Each segment was a row for every cell that it may meet, and these rows were broadcast; at 360 times sf0.1 that ended the driver."""
    rng = np.random.default_rng(8)
    maps = [(k % 2, f"m{k}", rng.integers(2500, 90_000, 40).tolist()) for k in range(6)]
    queries = [(g, f"q{k}", (np.array(f[9:20]) + rng.integers(-5, 6, 11)).tolist()[:: 1 if k % 4 < 2 else -1]) for k, (g, _, f) in enumerate(maps)]
    queries += [(0, "none", []), (2, "alone", maps[0][2][5:15]), (1, "small", [700] * 12)]
    schema = "group int, map_id string, frags array<int>"
    c, m, p = spark.createDataFrame(queries, schema), spark.createDataFrame([*maps, (1, "short", [4000, 5000])], schema), Params(sd_min=4, sd_max=4, min_hits=3, max_matches=1, local=local)
    shown = lambda df: sorted(repr(r.asDict(True)) for r in df.collect())
    for length in (3, 2, 1):
        whole = seeds.matches_within(c, m, p, 5.25, length, 8)
        dealt = seeds.matches_within(c, m, p, 5.25, length, 8, 3, map_frags=60, most_queries=2, most_held=5)
        assert {r.contig_id for r in whole.collect()} == {f"q{k}" for k in range(6)}
        assert shown(whole) == shown(dealt)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "key#" not in plan and "posexplode" not in plan


@pytest.mark.parametrize("by", [None, "trial"])
def test_null_scores_are_searched_within_the_best_so_far(spark, monkeypatch, by):
    """All tables of all maps were filled, at 60 times sf0.1 for longer than the query may take; scores are those of the full tables."""
    from fragloom.operators import align, bounded
    from fragloom.operators.kernel import best_score
    from fragloom.operators.pruned import Index

    rng = np.random.default_rng(9)
    maps = [(f"m{k}", k % 2, rng.integers(300, 60_000, int(rng.integers(1, 90))).tolist()) for k in range(9)]
    queries = [(f"q{k}", rng.integers(300, 60_000, n).tolist()) for k, n in enumerate((1, 4, 6, 9, 13, 19))] + [("far", [10**7] * 8), ("taken", maps[1][2][:12])]
    p = Params(sd_min=4, sd_max=5)
    m, c = spark.createDataFrame(maps, "map_id string, trial int, frags array<int>"), spark.createDataFrame(queries, "map_id string, frags array<int>")
    full = lambda q, own: max(best_score(np.array(x), np.array(o), len(o), p.sd_max, p) for o in own for x in (q, q[::-1]))
    monkeypatch.setattr(align, "FIRST", 2)
    got = {(r.map_id, r[by] if by else 0): r.score for r in align.null_scores(c, m, p, by).collect()}
    for k in (0, 1) if by else (0,):
        for name, q in queries:
            want = full(q, [o for _, t, o in maps if not by or t == k])
            assert got[name, k] == (None if want == -np.inf else want)
    # What is known bounds the work: fewer places are followed than the tables have cells, and a known score is kept.
    index, q = Index([(name, np.array(o)) for name, _, o in maps], p.delta), np.array(queries[4][1])
    best = full(queries[4][1], [o for *_, o in maps])
    monkeypatch.setattr(bounded, "best_score", lambda c, o, *rest: best_score(c, o, *rest) if len(o) <= len(c) * p.delta else pytest.fail("a full table"))
    assert bounded.best_over(q, index, p, best - 4) == bounded.best_over(q, index, p, best) == best and bounded.best_over(q, index, p, best + 1) == best + 1
