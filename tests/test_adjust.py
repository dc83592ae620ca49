"""The curve that corrects maps, against a plain version over single points."""

import numpy as np
import pytest

from fragloom.operators import adjust


def plain_curve(x, y, at, span=0.75):
    """Vertices by ranks of the sorted points, a weighted least-squares fit at each, cubics between them."""
    order = np.argsort(x, kind="stable")
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    n = len(x)
    most, k = max(1, int(n * span * adjust.CELL)), min(n, max(3, int(np.floor(n * span + 1e-5))))
    cuts, cells = [], [(0, n)]
    while cells:
        a, b = cells.pop()
        if b - a > most:
            m = (a + 1 + b) // 2
            t = (x[m - 1] + x[m]) / 2
            m = int(np.searchsorted(x, t, "right"))
            if m < b:
                cuts.append(t)
                cells += [(a, m), (m, b)]
    margin = adjust.MARGIN * (x[-1] - x[0]) or 1.0
    vertices = sorted({x[0] - margin, x[-1] + margin, *cuts})
    fits = []
    for v in vertices:
        d = np.abs(x - v)
        h = np.sort(d)[k - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0) if h > 0 else (d == 0).astype(float)
        z = (x - v) / (h or 1.0)
        a = np.sqrt(w)[:, None] * np.column_stack([np.ones(n), z, z * z])
        beta = np.linalg.lstsq(a, np.sqrt(w) * y, rcond=1e-9)[0] if w.any() else [np.mean(np.unique(y[d <= h])), 0.0]
        fits.append((v, beta[0], beta[1] / h if h > 0 else 0.0))
    out = []
    for q in at:
        if not x[0] <= q <= x[-1]:
            out.append(np.nan)
            continue
        k_ = next(i for i in range(1, len(fits)) if q <= fits[i][0])
        (a, f, d), (b, g, e) = fits[k_ - 1], fits[k_]
        w, t = b - a, (q - a) / (b - a)
        out.append(f * (1 - t) ** 2 * (1 + 2 * t) + g * t * t * (3 - 2 * t) + d * w * t * (1 - t) ** 2 - e * w * t * t * (1 - t))
    return np.array(out)


def curve_at(spark, x, y, at, span=0.75):
    curve = adjust.fitted_curve(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double").repartition(3), span)
    rows = spark.createDataFrame([(k, float(q)) for k, q in enumerate(at)], "k int, x double")
    got = {r.k: r.y for r in rows.select("k", curve.at(rows["x"]).alias("y")).collect()}
    return np.array([np.nan if got[k] is None else got[k] for k in range(len(at))])


def test_quadratics_are_met_exactly(spark):
    x = np.arange(1.0, 41.0)
    at = [0.9, 1.0, 2.5, 7.25, 33.3, 40.0, 40.1]
    got = curve_at(spark, x, 3 * x * x - 2 * x + 1, at)
    assert np.isnan(got[[0, -1]]).all() and got[1:-1] == pytest.approx([3 * q * q - 2 * q + 1 for q in at[1:-1]])


@pytest.mark.parametrize(("seed", "span"), [(0, 0.75), (1, 0.4), (2, 0.75), (3, 1.0)])
def test_noise_and_ties_against_single_points(spark, seed, span):
    rng = np.random.default_rng(seed)
    n = int(rng.choice([4, 30, 400]))
    x = rng.integers(500, 60_000 if seed % 2 else 520, n)
    y = x + 200 * np.sin(x / 7000) + rng.normal(0, 50, n)
    at = [float(v) for v in np.unique(np.concatenate([x, rng.uniform(x.min() - 5, x.max() + 5, 40)]))]
    got, want = curve_at(spark, x, y, at, span), plain_curve(x, y, at, span)
    assert (np.isnan(got) == np.isnan(want)).all()
    assert got[~np.isnan(got)] == pytest.approx(want[~np.isnan(want)], rel=1e-6)


def test_vertices_do_not_grow_with_the_points(spark):
    rng = np.random.default_rng(5)
    sizes = []
    for n in (200, 5000):
        x = rng.integers(500, 90_000, n)
        sizes.append(len(adjust.fitted_curve(spark.createDataFrame([(float(v), float(v)) for v in x], "x double, y double")).vertices))
    assert max(sizes) <= 18 and abs(sizes[0] - sizes[1]) <= 4


def test_maps(spark):
    maps = spark.createDataFrame([("m", [100, 200, 5000], 5300)], "map_id string, frags array<int>, length bigint")
    chunks = spark.createDataFrame([(k + 10, k) for k in range(50, 1000, 50)], "contig int, optical int")
    r = adjust.adjust_maps(maps, chunks).first()
    assert (r.frags, r.length) == ([110, 210, 5000], 5320)
    assert adjust.adjust_maps(maps, chunks.limit(2)).first().frags == [100, 200, 5000]
    same = spark.createDataFrame([(90 + k, 100) for k in range(21)], "contig int, optical int")
    assert adjust.adjust_maps(maps, same).first().frags == [100, 200, 5000]
