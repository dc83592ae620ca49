"""Every registered query with SQL, in both engines, on the smallest tables."""

import math
import os

import duckdb
import pytest

from fragloom.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def shown(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0 if isinstance(v, float) else v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.sql(SQL[name])
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    a = sorted(tuple(shown(r[c]) for c in order) for r in got.collect())
    at = [want.columns.index(c) for c in order]
    b = sorted(tuple(shown(r[k]) for k in at) for r in want.fetchall())
    assert a == b and a


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_circular_maps_and_wider_tolerances(spark):
    """Queries across a circular map's origin, with sizing errors that need a wider tolerance, are found where they were taken."""
    import random

    from fragloom.operators.align import align
    from fragloom.params import Params

    rng = random.Random(4)
    frags = [rng.randrange(3000, 60000) for _ in range(70)]
    turned = frags[-6:] + frags[:9]
    off = [x + int(6.5 * (100 * x) ** 0.5) if k == 7 else x for k, x in enumerate(frags[20:36])]  # beyond four deviations at one place
    maps = spark.createDataFrame([("m", frags)], "map_id string, frags array<int>")
    queries = spark.createDataFrame([("round", turned), ("off", off[::-1])], "map_id string, frags array<int>")
    got = {r.contig_id: r for r in align(queries, maps, Params(circular=True, sd_min=4, sd_max=8)).filter("rank = 1").collect()}
    assert (got["round"].op_start_index, got["round"].op_end_index, got["round"].sd) == (64, 78, 4) and got["round"].op_end_bp > sum(frags)
    assert (got["off"].op_start_index % 70, got["off"].forward) == (20, False) and 4 <= got["off"].sd <= 8


def test_statistics_from_chunks_agree_with_the_kernel(spark):
    import numpy as np

    from fragloom.operators.kernel import align_pair
    from fragloom.plans import bridge

    maps = {r.map_id: r.frags for r in bridge.reference_maps(spark, SF).collect()}
    contigs = {r.map_id: r.frags for r in bridge.contigs(spark, SF).collect()}
    names = {"contig_hits": "hits", "contig_misses": "c_misses", "optical_misses": "o_misses", "c_aligned_bases": "c_bases", "op_aligned_bases": "o_bases", "contig_unaligned_frags": "unaligned_frags", "total_miss_rate": "miss_rate", "aligned_length_ratio": "length_ratio", "chi2": "chi2"}
    for r in bridge.matches(spark, SF).filter("rank = 1").collect():
        found = align_pair(np.array(contigs[r.contig_id]), np.array(maps[r.chromosome]), bridge.PARAMS)
        m = next(m for f, _, m in found if f == r.forward and m.score == r.score and m.chunks[0].o_start == r.op_start_index)
        for a, b in names.items():
            assert r[a] == pytest.approx(m.stats[b]), a
