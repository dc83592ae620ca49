"""Correction of a map's systematic sizing error by local regression.

A curve of corrected against measured lengths is fitted at the vertices of a tree only: cells of the points' range are halved by rank until each holds a share of
the points.  At a vertex, a weighted quadratic gives a value and a slope; between neighbouring vertices the cubic with these values and slopes holds.  The number of vertices depends on
the shares alone, not on the number of points, so the curve is a short expression, and all that is ever brought to the driver are the vertices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .ranges import ranged

#: Share of a fit's points that a cell may hold, and how far the outer vertices lie beyond the points, as a share of their range.
CELL, MARGIN = 0.2, 0.10


@dataclass
class Curve:
    """Vertices with values and slopes; defined from ``low`` to ``high``."""

    vertices: list[float]
    values: list[float]
    slopes: list[float]
    low: float
    high: float

    def cells(self) -> list[tuple[float, float, float, list[float]]]:
        """(left, right, width, coefficients of 1, t, t^2, t^3 with t = (x - left) / width) of each cell."""
        out = []
        rows = list(zip(self.vertices, self.values, self.slopes, strict=True))
        for (a, f, d), (b, g, e) in zip(rows, rows[1:], strict=False):
            w = b - a
            out.append((a, b, w, [f, d * w, 3 * (g - f) - (2 * d + e) * w, 2 * (f - g) + (d + e) * w]))
        return out

    def at(self, x: Column) -> Column:
        """The curve's value; null outside its range."""
        out = None
        for a, b, w, c in self.cells():
            t = (x - F.lit(a)) / F.lit(w)
            y = F.lit(c[0]) + t * (F.lit(c[1]) + t * (F.lit(c[2]) + t * F.lit(c[3])))
            out = F.when(x <= b, y) if out is None else out.when(x <= b, y)
        return F.when((x >= self.low) & (x <= self.high), out)


def _at_ranks(ranked: DataFrame, ranks: list[int]) -> dict[int, tuple[float, int]]:
    """(value, rank of the last point of that value) for each rank, from 1."""
    rows = ranked.filter(F.exists(F.array(*[F.lit(r).cast("bigint") for r in ranks]), lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("n")))).select("x", "before", "n").collect()
    return {r: next((float(y.x), y.before + y.n) for y in rows if y.before < r <= y.before + y.n) for r in ranks}


def vertices_of(ranked: DataFrame, n: int, span: float) -> tuple[list[float], float, float]:
    """(vertices in order, least and largest point) of ``ranked`` (x, n points there, before: points at smaller x), ``n`` points in all."""
    most = max(1, int(n * span * CELL))
    ends = _at_ranks(ranked, [1, n])
    low, high = ends[1][0], ends[n][0]
    cuts, cells = [], [(1, n)]
    while cells := [(a, b) for a, b in cells if b - a + 1 > most]:
        middle = {(a, b): (a + b) // 2 for a, b in cells}
        found = _at_ranks(ranked, sorted({r + k for r in middle.values() for k in (0, 1)}))
        halves = []
        for (a, b), m in middle.items():
            (x, last), (y, _) = found[m], found[m + 1]
            last = m if x < y else last  # equal points stay together, on the left
            if last < b:
                cuts.append((x + y) / 2)
                halves += [(a, last), (last + 1, b)]
        cells = halves
    margin = MARGIN * (high - low) or 1.0
    return sorted({low - margin, high + margin, *cuts}), low, high


def fitted_curve(pairs: DataFrame, span: float = 0.75) -> Curve | None:
    """The curve of y over x for ``pairs`` (x, y), all of them, however many; None for fewer than three.

    Pairs are added up by x; each x then weighs as much as its pairs, so the fit is that of all pairs.  A vertex is fitted by the ``span`` of the points that are nearest, with tricube weights.
    """
    sums = pairs.groupBy(F.col("x").cast("double").alias("x")).agg(F.avg("y").alias("y"), F.count("*").alias("n"))
    ranked = cut(ranged(sums, [], [F.col("x")], "lengths").running("before", "sum", F.col("n")).plain(), "ranked")
    n = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if n < 3:
        return None
    vertices, low, high = vertices_of(ranked, n, span)
    k = min(n, max(3, int(np.floor(n * span + 1e-5))))
    each = ranked.select("x", "y", "n", F.explode(F.array(*map(F.lit, vertices))).alias("v")).withColumn("d", F.abs(F.col("x") - F.col("v")))
    near = ranged(each.select("v", "x", "d", "n"), ["v"], [F.col("d"), F.col("x")], "nearest").running("closer", "sum", F.col("n")).rows
    reach = near.filter(F.col("closer") + F.col("n") >= k).groupBy(F.col("v").alias("v_")).agg(F.min("d").alias("h"))
    z = F.when(F.col("h") > 0, (F.col("x") - F.col("v")) / F.col("h")).otherwise(F.lit(0.0))
    w = F.when(F.col("h") > 0, F.when(F.col("d") < F.col("h"), F.pow(1 - F.pow(F.col("d") / F.col("h"), 3), 3)).otherwise(0.0)).otherwise((F.col("d") == 0).cast("double"))
    weighed = each.join(F.broadcast(reach), F.col("v") == F.col("v_")).select("v", "h", "d", "y", z.alias("z"), (w * F.col("n")).alias("w"))  # a row for each vertex
    moments = weighed.groupBy("v").agg(F.first("h").alias("h"), *[F.sum(F.col("w") * F.pow("z", F.lit(a))).alias(f"m{a}") for a in range(5)], *[F.sum(F.col("w") * F.pow("z", F.lit(a)) * F.col("y")).alias(f"r{a}") for a in range(3)], F.avg(F.when(F.col("d") <= F.col("h"), F.col("y"))).alias("mean"))
    values, slopes = [], []
    for row in sorted(moments.collect(), key=lambda r: r.v):
        if not row.m0:  # all of the nearest points are as far away as the furthest of them
            values.append(float(row.mean))
            slopes.append(0.0)
            continue
        left = np.array([[row[f"m{i + j}"] for j in range(3)] for i in range(3)])
        beta = np.linalg.lstsq(left, np.array([row[f"r{i}"] for i in range(3)]), rcond=1e-12)[0]
        values.append(float(beta[0]))
        slopes.append(float(beta[1] / row.h) if row.h > 0 else 0.0)
    return Curve(vertices, values, slopes, low, high)


def adjust_maps(maps: DataFrame, chunks: DataFrame, span: float = 0.75) -> DataFrame:
    """``maps`` (map_id, frags, ...) with corrected frags and length; what lies outside the range of ``chunks`` (contig, optical) stays as it is, halves round to even."""
    pairs = chunks.filter(F.col("optical").isNotNull() & F.col("contig").isNotNull()).select(F.col("optical").alias("x"), F.col("contig").alias("y"))
    curve = fitted_curve(pairs, span)
    fitted = lambda x: x.cast("bigint") if curve is None else F.coalesce(F.rint(curve.at(x.cast("double"))).cast("bigint"), x.cast("bigint"))
    out = maps.withColumn("frags", F.transform("frags", fitted))
    return out.withColumn("length", F.aggregate("frags", F.lit(0).cast("bigint"), lambda a, x: a + x))
