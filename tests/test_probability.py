"""Special functions over whole arrays against single values of the standard library and of sums."""

import math

import numpy as np
import pytest

from fragloom.functions import probability as P


def test_gamma_functions():
    x = np.concatenate([np.linspace(0.01, 30, 400), [1e3, 1e6, 1e12]])
    assert P.ln_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)
    a, q = (v.ravel() for v in np.meshgrid(np.arange(1, 40), np.linspace(0.0, 90, 61)))
    want = [math.log(math.fsum(math.exp(-v + i * math.log(v) - math.lgamma(i + 1)) for i in range(int(k)))) if v else 0.0 for k, v in zip(a, q, strict=True)]
    assert P.ln_gamma_upper(a, q) == pytest.approx(want, rel=1e-9, abs=1e-11)
    assert P.ln_gamma_upper(np.array([0.0, 3.0]), np.array([5.0, 0.0])).tolist() == [0.0, 0.0]
    with pytest.raises(ValueError):
        P.ln_gamma_upper(np.array([1.0, -1.0]), np.array([1.0, 1.0]))


def test_normal_tails_far_out():
    z = np.concatenate([np.linspace(-30, 30, 301), [0.0]])
    got = P.ln_normal_tail(3 + 2 * z, 3.0, 4.0)
    assert got == pytest.approx([math.log(math.erfc(v / math.sqrt(2)) / 2) for v in z], rel=1e-11, abs=1e-14)
    assert P.ln_normal_tail(60.0, 0.0, 1.0) == pytest.approx(-1800 - math.log(60 * math.sqrt(2 * math.pi)) + math.log1p(-1 / 3600), abs=1e-6)


def test_beta_functions():
    rng = np.random.default_rng(2)
    a, b, x = rng.integers(1, 30, 500), rng.integers(1, 30, 500), rng.uniform(0, 1, 500)
    want = [math.fsum(math.comb(n, j) * v**j * (1 - v) ** (n - j) for j in range(k, n + 1)) for k, n, v in zip(a.tolist(), (a + b - 1).tolist(), x.tolist(), strict=True)]
    assert P.beta_inc(a, b, x) == pytest.approx(want, rel=1e-9, abs=1e-14)
    assert P.beta_inc(np.array([2.0, 2.0]), 3.0, np.array([0.0, 1.0])).tolist() == [0.0, 1.0]
    half = P.beta_inc(0.5, 0.5, np.linspace(0, 1, 11))
    assert half == pytest.approx([2 / math.pi * math.asin(math.sqrt(v)) for v in np.linspace(0, 1, 11)], abs=1e-12)


def test_columns_with_nulls(spark):
    df = spark.createDataFrame([(2.0, 3.0), (None, 3.0), (2.0, None), (4.0, 1.0)], "a double, x double")
    got = [r[0] for r in df.coalesce(1).select(P.vectorised(P.ln_chi_tail)("a", "x")).collect()]
    assert got[1] is None and got[2] is None and got[0] == pytest.approx(-1.5) and got[3] == pytest.approx(-0.5 + math.log(1.5))
