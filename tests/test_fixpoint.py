"""Placement in turns: the worklist on components against the loop over all records."""

import math
import random
import time

import numpy as np
import pytest

from fragloom.operators import fixpoint
from fragloom.operators.components import components

SCHEMA = "map_id string, record bigint, contig_id string, op_start int, op_end int, c_start double, c_end double, o_first int, o_last int, fixed boolean"


def loop(records, frags):
    """Every turn tests all records that are open, on one map."""
    size, sd = [f[0] for f in frags], [f[1] for f in frags]
    n = len(frags)
    status = {}

    def hang(own, a, b):
        room = sum(size[k % n] for k in range(a, b)) + 12 * math.sqrt(sum(sd[k % n] ** 2 for k in range(a, b)))
        return 0 if own is None else max(int(own - room), 0)

    def hangs(r):
        return hang(r[5], r[3] + 1, r[7]), hang(r[6], r[8], r[4])

    def occupy(r):
        for k, h in zip((r[3], r[4]), hangs(r), strict=True):
            size[k % n] = max(size[k % n] - h, 0)
        for k in range(r[3] + 1, r[4]):
            sd[k % n] = 0

    def clashes(r):
        if any(sd[k % n] == 0 for k in range(r[3], r[4] + 1)):
            return True
        return any(size[k % n] + 12 * sd[k % n] < h for k, h in zip((r[3], r[4]), hangs(r), strict=True))

    records = sorted(records, key=lambda r: r[1])
    for r in records:
        if r[-1]:
            occupy(r)
    open_ = [r for r in records if not r[-1]]
    while open_ and n:
        left = [r for r in open_ if not clashes(r)]
        status.update((r[1], "conflict") for r in open_ if r not in left)
        one = next((r for r in left if sum(x[2] == r[2] for x in left) == 1), None)
        open_ = [r for r in left if r is not one]
        if one is None:
            break
        status[one[1]] = "placed"
        occupy(one)
    return {r[1]: status.get(r[1], "rest") for r in records if not r[-1]}


def made(rng, map_id, n, many):
    frags = [(float(rng.choice([0, 500, 3000, 20000])), rng.choice([0.0, 5.0, 60.0]) if rng.random() < 0.2 else 50.0) for _ in range(n)]
    records = []
    for k in range(many):
        start = rng.randrange(n)
        end = start + rng.choice([0, 1, 2, 4, 7])
        first, last = min(end, start + rng.randrange(1, 4)), max(start, end - rng.randrange(3))
        own = lambda: rng.choice([None, 0.0, 700.0, 4000.0, 25000.0])
        records.append((map_id, k, f"c{rng.randrange(max(1, many // 3))}", start, end, own(), own(), first, last, rng.random() < 0.1))
    return records, frags


def fragments(frags):
    """Those of one map, in any order, as a board takes them."""
    order = np.random.default_rng(len(frags)).permutation(len(frags))
    size, sd = (np.array(x)[order] for x in zip(*frags, strict=True))
    return np.zeros(len(frags), np.int64), order, np.full(len(frags), len(frags)), size, sd


@pytest.mark.parametrize("seed", range(3))
def test_same_statuses_as_the_loop(spark, seed, monkeypatch):
    rng = random.Random(seed)
    maps = {f"m{k}": made(rng, f"m{k}", rng.choice([5, 40, 400]), rng.choice([1, 30, 120])) for k in range(8)}
    records = [r for rs, _ in maps.values() for r in rs] + [("none", 0, "c", 0, 2, 1.0, 1.0, 1, 2, False)]
    optical = [(m, k, *f) for m, (_, fs) in maps.items() for k, f in enumerate(fs)]
    df = spark.createDataFrame(records, SCHEMA).repartition(5)
    opt = spark.createDataFrame(optical, "map_id string, place int, size double, sd double").repartition(3)
    monkeypatch.setattr(fixpoint, "BATCH", rng.choice([1, 20, 50_000]))
    got = {(r.map_id, r.record): r.status for r in fixpoint.settled(df, opt).collect()}
    want = {(m, k): s for m, (rs, fs) in maps.items() for k, s in loop(rs, fs).items()}
    assert got == {**want, ("none", 0): "rest"}
    assert fixpoint.settled(df.limit(0), opt).count() == 0


def test_boards_against_the_loop():
    seen = set()
    for seed in range(300):
        rng = random.Random(seed)
        records, frags = made(rng, "m", rng.choice([3, 12, 60]), rng.choice([5, 25, 60]))
        board = fixpoint.Board(fragments(frags), [(0, *r[1:]) for r in records])
        got = {r[1]: s for r, s in zip(records, board.settle(), strict=True) if not r[-1]}
        assert got == loop(records, frags), seed
        seen |= set(got.values())
    assert seen == {"placed", "conflict", "rest"}


def test_work_grows_with_the_records():
    """A chain in which each placement frees the next: the loop would test all records at each of its turns."""
    took = {}
    for many in (2_000, 20_000):
        records, k = [], 0
        for c in range(many):  # query c is at 4 c and, as a second choice, where query c + 1 is
            for start in (4 * c, 4 * c + 4) if c < many - 1 else (4 * c,):
                records.append((0, k, f"c{c:06}", start, start + 3, 0.0, 0.0, start + 1, start + 3, False))
                k += 1
        began = time.time()
        status = fixpoint.Board(fragments([(1000.0, 50.0)] * (4 * many + 8)), records).settle()
        took[many] = time.time() - began
        assert status.count("placed") == many and status.count("rest") == 0
    assert took[20_000] < 40 * max(took[2_000], 0.02)


@pytest.mark.parametrize("seed", range(2))
def test_components_against_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(200)] + [(5, 5), (1, 2), (2, 1)]
    up = {x: x for e in edges for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(up[a], up[b])
            moved |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == up
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
