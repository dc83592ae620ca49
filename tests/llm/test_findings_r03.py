"""What the third round's review measured on larger tables."""

import numpy as np

from fragloom.llm import divergence as D


def test_contributions_of_pairs_are_no_rows(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for no, n in ((1, 1), (2, 4), (3, 9)):
        for _ in range(40):
            holders = sorted(rng.choice(n, rng.integers(1, n + 1), replace=False).tolist())
            p = rng.integers(1, 10**9 + 2, n).tolist()
            rows.append((no, p, holders))
            for a in range(n):
                for b in range(n):
                    if a in holders or b in holders:
                        value, count = want.get((no, a, b), (0, 0))
                        want[no, a, b] = (value + (p[a] - p[b]) ** 2 // p[b], count + 1)
    vectors = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "no int, p array<bigint>, holders array<int>")
    for cells in (1, 20, 1 << 20):
        sums = D.pair_sums(vectors, cells).groupBy("no", "a", "b").sum("value", "n").collect()
        assert {tuple(r)[:3]: tuple(r)[3:] for r in sums} == want
    assert D.pair_sums(vectors.limit(0)).collect() == []
