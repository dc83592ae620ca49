"""Special functions and the likelihood of an alignment block."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the block likelihood: chance that a site is cut, false cuts for each bp, median size of a lost fragment, variance for each bp.
CUT, FALSE_RATE, MEDIAN_LOST, VARIANCE = 0.8, 5e-6, 1350.0, 300.0
LOSS = math.log(2) / MEDIAN_LOST


#: Fixed values of Stirling's series: B(2k) / (2k (2k - 1)).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
SHIFT = 10
TINY = 1e-300


def _arrays(*values) -> tuple[list[np.ndarray], bool]:
    """The values as arrays of one shape, and whether all were single numbers."""
    out = np.broadcast_arrays(*[np.asarray(v, dtype=float) for v in values])
    return [np.atleast_1d(v).astype(float) for v in out], all(np.ndim(v) == 0 for v in values)


def _result(values: np.ndarray, single: bool):
    return float(values[0]) if single else values


def _open(state: list[np.ndarray], going: np.ndarray) -> list[np.ndarray]:
    return [v[going] for v in state]


def ln_gamma(x):
    """Logarithm of the gamma function of numbers or arrays above 0: Stirling's series at ``x`` + 10, and the recurrence back."""
    (x,), single = _arrays(x)
    y = x + SHIFT
    series = sum(c / y ** (2 * k + 1) for k, c in enumerate(STIRLING))
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - sum(np.log(x + k) for k in range(SHIFT))
    return _result(out, single)


def _series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lower regularised incomplete gamma function, for x < a + 1; what has converged is left alone."""
    total = 1 / a
    term, k, at = total.copy(), a.copy(), np.arange(len(a))
    while len(at):
        k, term = k + 1, term * x[at] / (k + 1)
        total[at] += term
        going = term > total[at] * 1e-16
        k, term, at = _open([k, term, at], going)
    return total * np.exp(-x + a * np.log(x) - ln_gamma(a))


def _lentz(b0: np.ndarray, step, most: int = 10_000) -> np.ndarray:
    """A continued fraction 1 / (b0 + a1 / (b1 + ...)); ``step(i, at)`` gives a_i and b_i of the places that are still going."""
    d = 1 / np.where(b0 == 0, TINY, b0)
    h, at = d.copy(), np.arange(len(b0))
    c = np.full(len(b0), 1 / TINY)
    for i in range(1, most):
        top, below = step(i, at)
        d = top * d + below
        d = 1 / np.where(d == 0, TINY, d)
        c = below + top / c
        c = np.where(c == 0, TINY, c)
        h[at] *= c * d
        going = np.abs(c * d - 1) >= 1e-15
        if not going.any():
            break
        c, d, at = _open([c, d, at], going)
    return h


def ln_gamma_upper(a, x):
    """Logarithm of the upper regularised incomplete gamma function; 0 for x <= 0 or a == 0."""
    (a, x), single = _arrays(a, x)
    if (a < 0).any() or (x < -1e-10).any():
        raise ValueError("a and x must not be negative")
    out, some = np.zeros(len(a)), (x > 0) & (a > 0)
    low, high = some & (x < a + 1), some & (x >= a + 1)
    out[low] = np.log1p(-np.minimum(_series(a[low], x[low]), 1 - 2**-53))
    p, q = a[high], x[high]
    h = _lentz(q + 1 - p, lambda i, at: (-i * (i - p[at]), q[at] + 1 - p[at] + 2 * i))
    out[high] = -q + p * np.log(q) - ln_gamma(p) + np.log(h)
    return _result(out, single)


def ln_chi_tail(df, x):
    """Logarithm of the upper tail of chi squared, less that of the gamma function of half its degrees."""
    (df, x), single = _arrays(df, x)
    return _result(ln_gamma_upper(df / 2, x / 2) - ln_gamma(df / 2), single)


def ln_normal_tail(x, mean, variance):
    """Logarithm of the upper tail of a normal distribution, however small."""
    (x, mean, variance), single = _arrays(x, mean, variance)
    z = (x - mean) / np.sqrt(2 * variance)
    both = ln_gamma_upper(np.full(len(z), 0.5), z * z)  # of both tails beyond z
    return _result(np.where(z > 0, both - math.log(2), np.log1p(-np.exp(both) / 2)), single)


def beta_inc(a, b, x):
    """Regularised incomplete beta function."""
    (a, b, x), single = _arrays(a, b, x)
    if not ((x >= 0) & (x <= 1)).all():
        raise ValueError("x must lie between 0 and 1")
    turned = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    out, some = np.zeros(len(x)), (y > 0) & (y < 1)
    p, q, y = p[some], q[some], y[some]

    def step(i: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, u, v, w = i // 2, p[at], q[at], y[at]
        top = m * (v - m) * w / ((u + 2 * m - 1) * (u + 2 * m)) if i % 2 == 0 else -(u + m) * (u + v + m) * w / ((u + 2 * m) * (u + 2 * m + 1))
        return top, np.ones(len(at))

    front = np.exp(ln_gamma(p + q) - ln_gamma(p) - ln_gamma(q) + p * np.log(y) + q * np.log1p(-y))
    out[some] = front * _lentz(np.ones(len(y)), step) / p
    out[np.where(turned, 1 - x, x) >= 1] = 1.0
    return _result(np.where(turned, 1 - out, out), single)


def vectorised(f):
    """A Pandas UDF of a function of arrays, one call for a batch; null where an argument is null."""

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        known = ~np.any([c.isna().to_numpy() for c in columns], axis=0)
        out = np.full(len(known), np.nan)
        if known.any():
            out[known] = f(*[c.to_numpy(float)[known] for c in columns])
        return pd.Series(out).where(known, None)

    return run


def ln_poisson(k: Column, mean: Column) -> Column:
    """``k`` up to 170: the factorial is a product of doubles, so it is exact enough for all of them."""
    ln_factorial = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    return -mean + k * F.log(mean) - ln_factorial


def ln_normal(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return -0.5 * z * z - F.lit(0.5 * math.log(2 * math.pi)) - F.log(sd)


def ln_lost(size: Column) -> Column:
    return -F.lit(LOSS) * size


def ln_kept(size: Column) -> Column:
    return F.log(1 - F.exp(-F.lit(LOSS) * size))


def block_likelihood(l_map: Column, n_map: Column, l_ref: Column, n_ref: Column, ref_frags: Column | None = None, missing_by_false_cuts: bool = True) -> Column:
    """Logarithm of the likelihood of a block of ``n_map`` measured fragments on ``n_ref`` reference fragments.

    False cuts are Poisson, the sizing error is normal, with ``ref_frags`` none of them was lost; ``n_map`` of 0 means that the reference
    fragments were.  ``missing_by_false_cuts`` counts uncut sites by the number of false cuts, as results made so far did; otherwise by that of missing cuts.
    """
    false_cuts = n_map - 1
    uncut = false_cuts if missing_by_false_cuts else n_ref - 1
    total = lambda f: F.aggregate(ref_frags, F.lit(0.0), lambda a, x: a + f(x)) if ref_frags is not None else None
    lost = (total(ln_lost) if ref_frags is not None else ln_lost(l_ref)) + F.lit(math.log(CUT))
    sizing = ln_normal(l_map, l_ref, F.lit(math.sqrt(VARIANCE)) * F.sqrt(l_ref))
    kept = ln_poisson(false_cuts, F.lit(FALSE_RATE) * l_map) + uncut * F.lit(math.log(1 - CUT)) + F.lit(math.log(CUT)) + sizing
    return F.when(n_map == 0, lost).otherwise(kept + total(ln_kept) if ref_frags is not None else kept)
