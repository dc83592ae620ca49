"""The best global score of a query over many maps at once, without an acceptance test, by a search whose budget is the best score so far.

In global mode every step of an alignment costs something.  Of an alignment within a budget, either the steps up to the middle of the query or those behind it cost half of the budget at most, so the rows of a
table of costs are filled from both ends with half of it, and only what is left is followed over the middle with all of it.  Within a budget most steps are ruled out by the number of sites they miss, and of the others a
step may only meet blocks of about its own size, which are a range of the blocks sorted by size.
"""

from __future__ import annotations

import math

import numpy as np

from ..params import Params
from .kernel import NONE, best_score, block_cost, gap_score
from .pruned import SLACK, Index

#: Budgets tried in turn as long as no score is known; a single map, and what costs more than the last, is looked at by full tables.
BUDGETS = (12.0, 18.0, 27.0, 40.0, 60.0, 90.0)
#: Share of a row's places below which they are followed one by one, not looked up by size.
FEW = 0.1


def served(contig: np.ndarray, p: Params) -> bool:
    """Whether the search gives what :func:`kernel.best_score` does: a shorter query may be one block, which that leaves out."""
    return not (p.one_to_one or p.circular) and len(contig) > p.delta


def dense_sizes(index: Index, w: int) -> np.ndarray:
    """The size of the block of ``w`` fragments from each site on, minus infinity where that goes beyond the map."""
    if ("dense", w) not in index.blocks:
        size = (index.bp[w:] - index.bp[:-w]).astype(float)
        size[np.arange(len(size)) + w > index.last[: len(size)]] = -np.inf
        index.blocks["dense", w] = size
    return index.blocks["dense", w]


def ends_within(contig: np.ndarray, index: Index, p: Params, budget: float, way: int) -> np.ndarray:
    """The least cost of an alignment that arrives at each site (``way`` -1: begins there), as far as it is within the budget and costs half of it at most before (behind) the middle; else infinite."""
    m, n, middle, limit = len(contig), len(index.bp), len(contig) // 2, float(p.sd_max**2)
    sums, half = np.concatenate([[0], np.cumsum(contig)]).tolist(), budget / 2 + SLACK
    start, goal = (0, m) if way > 0 else (m, 0)
    rows: dict[int, np.ndarray] = {start: np.zeros(n)}
    for r in range(m) if way > 0 else range(m, 0, -1):
        cost = rows.pop(r, None)
        if cost is None:
            continue
        alive = np.flatnonzero(cost < np.inf)
        if not len(alive):
            continue
        least, sparse = float(cost[alive].min()), len(alive) < FEW * n
        for a in range(1, min(p.delta, abs(goal - r)) + 1):
            k = r if way > 0 else r - a
            c, to_row = float(sums[k + a] - sums[k]), r + way * a
            most = half if (r < middle if way > 0 else to_row >= middle) else budget + SLACK
            base = -block_cost(contig[k : k + a].tolist(), p)
            if c <= 0 or base == math.inf:
                continue
            free = p.boundaries and (k == 0 or k + a == m)
            for w in range(1, p.delta + 1):
                rest = min(most - least - base - p.cost_optical * (w - 1), limit)
                if rest < 0:
                    break
                if r == start:  # from every site, at no cost: whole rows, not lists of sites
                    size = dense_sizes(index, w)
                    chi2 = (c - size) ** 2 / (c * p.sigma2)
                    if free:
                        chi2[size > c] = 0.0
                    new = chi2 + (base + p.cost_optical * (w - 1))
                    new[(new > most) | (chi2 > limit)] = np.inf
                    if to_row not in rows:
                        rows[to_row] = np.full(n, np.inf)
                    row = rows[to_row][w:] if way > 0 else rows[to_row][: max(0, n - w)]
                    np.minimum(row, new, out=row)
                    continue
                if sparse:
                    to = alive + way * w
                    good = to <= index.last[alive] if way > 0 else to >= index.first[alive]
                    at, to = alive[good], to[good]
                    size = np.abs(index.bp[to] - index.bp[at])
                else:
                    sizes, starts = index.sorted_blocks(w)
                    reach = math.sqrt(rest * c * p.sigma2) + 1
                    part = slice(int(np.searchsorted(sizes, c - reach, "left")), None if free else int(np.searchsorted(sizes, c + reach, "right")))
                    size, at = sizes[part], starts[part]
                    at, to = (at, at + w) if way > 0 else (at + w, at)
                chi2 = (c - size) ** 2 / (c * p.sigma2)
                if free:
                    chi2[size > c] = 0.0
                new = cost[at] + chi2 + (base + p.cost_optical * (w - 1))
                good = np.flatnonzero((new <= most) & (chi2 <= limit))
                if len(good):
                    if to_row not in rows:
                        rows[to_row] = np.full(n, np.inf)
                    row, to = rows[to_row], to[good]
                    row[to] = np.minimum(row[to], new[good])
        gap = -gap_score(int(contig[r if way > 0 else r - 1]), p)
        if gap < np.inf:
            most = half if (r < middle if way > 0 else r - 1 >= middle) else budget + SLACK
            good = alive[cost[alive] + gap <= most]
            if r + way not in rows:
                rows[r + way] = np.full(n, np.inf)
            rows[r + way][good] = np.minimum(rows[r + way][good], cost[good] + gap)
    return rows.get(goal, np.full(n, np.inf))


def best_within(contig: np.ndarray, index: Index, p: Params, budget: float) -> float:
    """The best score of one strand in an index if that is ``-budget`` at least, else -inf.  It is the kernel's, on windows around the cheapest places."""
    best = NONE
    for way in (1, -1):
        cost = ends_within(contig, index, p, budget, way)
        for site in np.flatnonzero((cost < np.inf) & (cost <= cost.min() + SLACK)).tolist():
            reach = len(contig) * p.delta
            first, last = (max(site - reach, int(index.first[site])), site) if way > 0 else (site, min(site + reach, int(index.last[site])))
            k, at = int(np.searchsorted(index.offset, site, "right")) - 1, int(index.first[site])
            part = index.frags[k][first - at : last - at]
            if len(part):
                best = max(best, best_score(contig, part, len(part), p.sd_max, p))
    return best if best >= -budget else NONE


def best_over(contig: np.ndarray, index: Index, p: Params, known: float = NONE) -> float:
    """The best score of both strands over all maps of an index, or ``known`` if that is better."""
    strands = (contig, contig[::-1].copy())
    for budget in (-known,) if known > NONE else () if len(index.frags) == 1 else BUDGETS:
        for x in strands:
            known = max(known, best_within(x, index, p, min(budget, -known)))
        if known > NONE:
            return known
    return max((best_score(x, o, len(o), p.sd_max, p) for o in index.frags for x in strands), default=NONE)
