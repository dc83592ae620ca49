"""Scores of alignment blocks as column expressions.  Impossible blocks score null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Params


def gap_penalty(size: Column, p: Params) -> Column:
    """Cost of leaving a query fragment unaligned; null from ``small`` on."""
    return F.when(size < p.small, -size * F.lit(p.small_slope))


def missed_site_penalty(distance: Column, p: Params) -> Column:
    """Cost of a query site without partner, by its distance to the nearest one that has; null exactly at ``small``."""
    return F.when(distance > p.small, F.lit(-p.cost_contig)).otherwise(gap_penalty(distance, p) + F.lit(1e-6))


def sizing(c: Column, o: Column, p: Params) -> Column:
    """Squared deviation of the reference length from the query length, over its variance; null for an empty query block."""
    d = (c - o).cast("double")
    return F.when(c > 0, d * d / (c.cast("double") * F.lit(p.sigma2)))


def _within(chi2: Column, sd: Column | int) -> Column:
    sd = F.lit(sd) if isinstance(sd, int) else sd
    return F.when(chi2 <= (sd * sd).cast("double"), chi2)


def global_block(frags: Column, o: Column, n_optical: Column, boundary: Column, p: Params, sd: Column | int) -> Column:
    """Score of a block of the query fragments ``frags`` on ``n_optical`` reference fragments of together ``o`` bp.

    A boundary block that is shorter than its partner has no sizing cost.
    """
    c = F.aggregate(frags, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    chi2 = F.when(boundary & (c < o), F.lit(0.0)).otherwise(_within(sizing(c, o, p), sd))
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0.0).alias("cost"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x
        return F.struct(at.alias("at"), (acc["cost"] + missed_site_penalty(F.least(at, c - at), p)).alias("cost"))

    inner = F.slice(frags, 1, F.size(frags) - 1)
    missed = F.aggregate(inner, state, step)["cost"]
    return missed + (F.lit(-p.cost_optical) * (n_optical - 1)) + (-1.0 * chi2)


def count_block(c: Column, o: Column, n_contig: Column, n_optical: Column, boundary: Column, p: Params, sd: Column | int) -> Column:
    """Score by the number of missed sites only."""
    chi2 = F.when(boundary & (c < o), F.lit(0.0)).otherwise(_within(sizing(c, o, p), sd))
    return -((n_contig - 1) * F.lit(p.cost_contig) + (n_optical - 1) * F.lit(p.cost_optical) + chi2)


def local_block(c: Column, o: Column, n_contig: Column, n_optical: Column, p: Params, sd: Column | int) -> Column:
    """Score that is positive for a good fit."""
    chi2 = _within(sizing(c, o, p), sd)
    return F.lit(-p.a) * (chi2 - F.lit(p.t2)) + (-(n_contig - 1) * F.lit(p.cost_contig) - (n_optical - 1) * F.lit(p.cost_optical))
