"""The alignment kernel against a plain table of loops, and its stated peculiarities."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fragloom.operators import kernel as K
from fragloom.params import Params


def slow_block(c, o, edge, p, sd):
    cl, ol = sum(c), sum(o)
    if edge and cl < ol:
        chi2 = 0.0
    elif cl == 0:
        return -math.inf
    else:
        chi2 = (cl - ol) ** 2 / (cl * p.sigma2)
        if chi2 > sd * sd:
            return -math.inf
    cost, at = 0.0, 0
    for x in c[:-1]:
        at += x
        d = min(at, cl - at)
        cost += -p.cost_contig if d > p.small else (-d * p.small_slope if d < p.small else -math.inf) + 1e-6
    return cost - p.cost_optical * (len(o) - 1) - chi2


def slow_table(c, o, p, sd, n_chrom):
    m, n = len(c) + 1, len(o) + 1
    s = [[-math.inf] * n for _ in range(m)]
    back = [[(-1, -1)] * n for _ in range(m)]
    s[0] = [0.0] * n
    gap = lambda x: -x * p.small_slope if x < p.small else -math.inf
    for i in range(1, m):
        s[i][0], back[i][0] = s[i - 1][0] + gap(c[i - 1]), (i - 1, 0)
        for j in range(1, n):
            if i == 1 and j > n_chrom:
                continue
            for k in range(i - 1, max(0, i - p.delta) - 1, -1):
                for q in range(j - 1, max(0, j - p.delta) - 1, -1):
                    v = s[k][q] + slow_block(c[k:i], o[q:j], (k == 0 or i == m - 1) and p.boundaries, p, sd)
                    if v > s[i][j]:
                        s[i][j], back[i][j] = v, (k, q)
            v = s[i - 1][j] + gap(c[i - 1])
            if v > s[i][j]:
                s[i][j], back[i][j] = v, (i - 1, j)
    return s, back


SIZES = st.lists(st.sampled_from([0, 500, 1000, 1999, 2000, 2001, 5000, 5000, 9000, 30000]), min_size=1, max_size=9)


@settings(max_examples=60, deadline=None)
@given(SIZES, SIZES, st.booleans(), st.integers(1, 8))
def test_global_table_and_tie_order(c, o, boundaries, sd):
    p = Params(boundaries=boundaries)
    with np.errstate(all="ignore"):
        got = K.fill(np.array(c), np.array(o), len(o), sd, p)
    want, back = slow_table(c, o, p, sd, len(o))
    assert np.allclose(got.score, np.array(want), equal_nan=True)
    for i in range(1, len(c) + 1):
        for j in range(1, len(o) + 1):
            if want[i][j] > -math.inf:
                assert (got.row[i, j], got.col[i, j]) == back[i][j]


def make(seed, n=200):
    rng = random.Random(seed)
    optical = [rng.randrange(500, 70000) for _ in range(n)]
    return rng, np.array(optical)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("local", [False, True])
def test_a_changed_slice_is_found(seed, local):
    rng, optical = make(seed)
    start, n = rng.randrange(0, 180), rng.randrange(12, 18)
    contig = [x + rng.randrange(-40, 40) for x in optical[start : start + n].tolist()]
    contig[4:6] = [sum(contig[4:6])]
    forward = seed % 2 == 0
    found = K.align_pair(np.array(contig if forward else contig[::-1]), optical, Params(sd_max=4, local=local))
    f, sd, best = max(found, key=lambda x: x[2].score)
    n = len(optical[start : start + n])
    assert (f, sd) == (forward, 4)
    assert start <= best.chunks[0].o_start <= start + 1 and start + n - 2 <= best.chunks[-1].o_end - 1 <= start + n - 1


@pytest.mark.parametrize("local", [False, True])
def test_chunk_scores_add_up_and_twins_agree(local):
    rng, optical = make(3)
    contig = np.array([x + 7 for x in optical[40:55].tolist()])
    p = Params(sd_max=4, local=local, boundaries=False)
    for _, _, m in K.align_pair(contig, optical, p):
        assert sum(map(sum, (x.parts for x in m.chunks))) == pytest.approx(m.score, abs=1e-6)
    one = max(x[2].score for x in K.align_pair(contig, optical, p))
    two = max(x[2].score for x in K.align_pair(contig[::-1].copy(), optical[::-1].copy(), p))
    assert one == pytest.approx(two)


@pytest.mark.parametrize("seed", range(12))
def test_chunk_scores_add_up_with_boundaries_and_gaps(seed):
    rng, optical = make(seed)
    start = rng.randrange(0, 180)
    contig = [x + rng.randrange(-40, 40) for x in optical[start : start + 15].tolist()]
    contig[0] += rng.choice([-900, 300, 0])  # an end may stick out or fall short
    contig[-1] += rng.choice([-900, 250, 0])
    contig.insert(rng.randrange(3, 12), rng.randrange(50, 800))  # a fragment that the map doesn't have
    contig = np.array(contig if seed % 2 else contig[::-1])
    p = Params(sd_max=4)
    found = K.align_pair(contig, optical, p)
    assert found
    for _, _, m in found:
        assert sum(map(sum, (x.parts for x in m.chunks))) == pytest.approx(m.score, abs=1e-6)
    assert any(x.boundary for _, _, m in found for x in m.chunks)


def test_ends_that_are_too_long_cost():
    _, optical = make(4)
    contig = optical[50:64].copy()
    contig[0] += 300
    contig[-1] += 250
    best = max(K.align_pair(contig, optical, Params(sd_max=4)), key=lambda x: x[2].score)[2]
    want = -(300**2) / (100 * contig[0]) - 250**2 / (100 * contig[-1])
    assert best.score == pytest.approx(want) == pytest.approx(best.chunks[0].parts[2] + best.chunks[-1].parts[2])


@pytest.mark.parametrize("seed", range(10))
@pytest.mark.parametrize("local", [False, True])
@pytest.mark.parametrize("boundaries", [False, True])
def test_trails_judged_at_once_are_judged_alike(seed, local, boundaries):
    rng, optical = make(seed, 90)
    contig = np.array([rng.randrange(100, 40000) for _ in range(11)] if seed % 2 else [max(1, x + rng.randrange(-2500, 2500)) for x in optical[20:32].tolist()])
    p = Params(local=local, boundaries=boundaries, min_hits=2 + seed % 3, min_length_ratio=0.97, max_miss_rate=0.1)
    table = K.fill(contig, optical, 90, 6, p)
    cells = table.score > 0 if local else table.score > -np.inf
    i, j = np.nonzero(cells[1:, 1:])
    i, j = i + 1, j + 1
    c, o = ([0, *np.cumsum(x).tolist()] for x in (contig, optical))
    got = K.may_pass(table, i, j, np.array(c), np.array(o), p)
    for a, b, good in zip(i.tolist(), j.tolist(), got.tolist(), strict=True):
        chunks = K.chunks_of(K.trail(table, a, b), c, o, p)
        # A boundary chunk's coordinates are the query's, so inner lengths are the fragments' on both ways.
        assert good == (bool(chunks) and K.passes(K.statistics(chunks, c[-1], p), p)), (a, b)


def test_wider_tolerance_never_scores_less():
    rng, optical = make(5)
    contig = np.array([rng.randrange(500, 70000) for _ in range(12)])
    scores = [K.best_score(contig, optical, len(optical), sd, Params()) for sd in range(2, 12)]
    assert scores == sorted(scores)


def test_peculiarities():
    p = Params()
    assert K.missed_score(2000, p) == -math.inf and K.missed_score(2001, p) == -3.0 and K.missed_score(1000, p) == pytest.approx(-1.5 + 1e-6)
    assert K.gap_score(2000, p) == -math.inf and Params(cost_contig=9.0).small_slope == p.small_slope
    stats = {"inner_blocks": 0, "chi2": 0.0, "length_ratio": math.nan, "c_miss_rate": 0.0, "hits": 5}
    assert not K.passes(stats, p) and K.passes(stats, p.but(local=True))  # as many hits as asked for are enough in local mode only
    assert K.best_score(np.array([5000, 6000, 7000]), np.array([5000, 6000, 7000]), 3, 4, p.but(one_to_one=True)) == -math.inf
    gap = K.chunks_of([(0, 0), (1, 0), (2, 1)], [0, 100, 600], [0, 500], p.but(boundaries=False))
    assert gap[0].gap and (gap[0].o_start_bp, gap[0].o_end_bp) == (0, 0) and K.statistics(gap, 600, p)["hits"] == 1


def test_circular_maps_are_read_round():
    rng, optical = make(9, 60)
    contig = np.concatenate([optical[-6:], optical[:8]])
    plain = K.align_pair(contig, optical, Params(sd_max=4))
    round_ = K.align_pair(contig, optical, Params(sd_max=4, circular=True))
    best = max(round_, key=lambda x: x[2].score)[2]
    assert best.chunks[0].o_start == 54 and best.score > max([x[2].score for x in plain], default=-math.inf)


def test_max_matches_of_zero_gives_none():
    rng, optical = make(1)
    assert K.matches_of(optical[10:22], optical, 200, 4, Params(max_matches=0)) == []
    assert len(K.matches_of(optical[10:22], optical, 200, 4, Params(max_matches=-1))) >= 1
