"""The alignment kernel: one query strand against one reference map.

The table of scores has a row for each query prefix and a column for each reference prefix.  A row is computed for all columns at once,
from its at most ``delta`` (local: one more) predecessor rows; the order in which predecessors are tried settles ties.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..params import Params

NONE = -np.inf


def gap_score(size: float, p: Params) -> float:
    return -size * p.small_slope if size < p.small else NONE


def missed_score(distance: float, p: Params) -> float:
    return -p.cost_contig if distance > p.small else gap_score(distance, p) + 1e-6


def block_cost(sizes: list[int], p: Params) -> float:
    """Cost of the inner sites of a block of query fragments."""
    total, at, cost = sum(sizes), 0, 0.0
    for x in sizes[:-1]:
        at += x
        cost += missed_score(min(at, total - at), p)
    return cost


@dataclass
class Table:
    score: np.ndarray
    row: np.ndarray
    col: np.ndarray


def fill(contig: np.ndarray, optical: np.ndarray, n_chrom: int, sd: float, p: Params, by_count: bool = False) -> Table:
    """Scores and predecessors.  ``n_chrom``: fragments of the map before doubling; no alignment starts behind them.

    ``by_count`` uses costs by the number of missed sites, and blocks of one fragment more, in global mode.
    """
    m, n = len(contig) + 1, len(optical) + 1
    local = p.local
    score = np.zeros((m, n)) if local else np.full((m, n), NONE)
    row, col = np.full((m, n), -1, np.int32), np.full((m, n), -1, np.int32)
    score[0] = 0.0
    if not local:
        for i in range(1, m):
            score[i, 0] = score[i - 1, 0] + gap_score(contig[i - 1], p)
            row[i, 0], col[i, 0] = i - 1, 0
    reach = p.delta + 1 if local or by_count else p.delta
    sums = np.concatenate([[0], np.cumsum(optical, dtype=np.int64)])
    limit = float(sd * sd)
    # Row w - 1 of these is for blocks of w reference fragments that end at each column; what would begin before the map is out.
    at = np.arange(n)
    w = np.arange(1, reach + 1)[:, None]
    lengths = (sums[at] - sums[np.maximum(at - w, 0)]).astype(np.float64)
    outside = at < w
    sites = -p.cost_optical * (w - 1)
    own, starts = contig.tolist(), np.concatenate([[0], np.cumsum(contig, dtype=np.int64)])
    padded = np.full((m, reach + n), NONE)
    down, step = padded.strides
    padded[0, reach:] = score[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(1, m):
            best, r, c = score[i], row[i], col[i]
            end = min(n, n_chrom + 1) if i == 1 else n
            # All blocks that end at this row at once, the shortest first.
            ks = [k for k in range(i - 1, max(0, i - reach) - 1, -1) if not (local and p.boundaries and (k == 0 or i == m - 1))]
            if ks:
                c_len = (starts[i] - starts[ks]).astype(np.float64)[:, None, None]
                missed = np.array([-p.cost_contig * (i - k - 1) if local or by_count else block_cost(own[k:i], p) for k in ks])[:, None, None]
                chi2 = c_len - lengths
                chi2 *= chi2
                chi2 /= c_len * p.sigma2
                if local:
                    value = -p.a * (chi2 - p.t2) + (missed + sites)
                else:
                    if p.boundaries:
                        for e, k in enumerate(ks):
                            if k == 0 or i == m - 1:
                                chi2[e][c_len[e] < lengths] = 0.0
                    used = (i - np.array(ks) - 1)[:, None, None]
                    value = -(used * p.cost_contig + (w - 1) * p.cost_optical + chi2) if by_count else (missed + sites) - chi2
                value[~(chi2 <= limit) | outside] = NONE  # also where 0 is divided by 0
                value += np.lib.stride_tricks.as_strided(padded[ks[0], reach - 1 :], (len(ks), reach, n), (-down, -step, step))
                value = value.reshape(-1, n)
                first = value.argmax(axis=0)  # of equal ones the shortest query block, then the shortest reference block
                top = value[first, at]
                better = top > best
                better[:1] = better[end:] = False
                here = np.flatnonzero(better)
                best[here] = top[here]
                r[here] = np.array(ks)[first[here] // reach]
                c[here] = here - first[here] % reach - 1
            if not local:
                gap = gap_score(contig[i - 1], p)
                if gap > NONE:
                    value = score[i - 1, 1:end] + gap
                    here = np.flatnonzero(value > best[1:end]) + 1
                    best[here] = value[here - 1]
                    r[here] = i - 1
                    c[here] = here
            padded[i, reach:] = best
    return Table(score, row, col)


def trail(table: Table, i: int, j: int) -> list[tuple[int, int]]:
    out = [(i, j)]
    while True:
        i, j = int(table.row[i, j]), int(table.col[i, j])
        if i < 0 or j < 0:
            return out[::-1]
        out.append((i, j))


@dataclass
class Chunk:
    c_start: int
    c_end: int
    o_start: int
    o_end: int
    c_start_bp: int
    c_end_bp: int
    o_start_bp: int
    o_end_bp: int
    gap: bool
    boundary: bool
    parts: tuple[float, float, float] = (0.0, 0.0, 0.0)


@dataclass
class Match:
    score: float
    chunks: list[Chunk]
    stats: dict = field(default_factory=dict)


def chunks_of(path: list[tuple[int, int]], c_bounds: list[int], o_bounds: list[int], p: Params) -> list[Chunk]:
    """A chunk for each step of a trail.  A gap sits at the end of the chunk before it, at 0 if there is none; a chunk with the query's first
    or last fragment is bounded by one site only and takes its other reference end from the query's length."""
    out, last = [], len(c_bounds) - 1
    for (cs, os_), (ce, oe) in zip(path, path[1:], strict=False):
        c0, c1 = c_bounds[cs], c_bounds[ce]
        gap = oe == os_
        o0, o1 = (o_bounds[os_],) * 2 if gap else (o_bounds[os_], o_bounds[oe])
        if p.boundaries and cs == 0:
            o0 = o1 - (c1 - c0)
        elif p.boundaries and ce == last:
            o1 = o0 + (c1 - c0)
        out.append(Chunk(cs, ce, os_, oe, c0, c1, o0, o1, gap, p.boundaries and (cs == 0 or ce == last)))
    return out


def statistics(chunks: list[Chunk], contig_length: int, p: Params) -> dict:
    """Coordinates, hits, misses, rates and sizing error of a match."""
    s = dict.fromkeys(("unaligned_frags", "unaligned_bases", "c_misses", "o_misses", "c_bases", "o_bases", "c_inner", "o_inner", "inner_blocks", "hits"), 0)
    chi2 = 0.0
    for k, x in enumerate(chunks):
        c, o = x.c_end_bp - x.c_start_bp, x.o_end_bp - x.o_start_bp
        if x.gap:
            s["unaligned_frags"] += x.c_end - x.c_start
            s["unaligned_bases"] += c
            continue
        s["o_misses"] += x.o_end - x.o_start - 1
        s["c_misses"] += x.c_end - x.c_start - 1
        s["c_bases"] += c
        s["o_bases"] += o
        if not x.boundary:
            chi2 += (o - c) ** 2 / (p.sigma2 * c) if c else (np.inf if o else np.nan)
            s["c_inner"] += c
            s["o_inner"] += o
            s["inner_blocks"] += 1
        if k == 0 and not x.boundary:
            s["hits"] += 1
        if not (x.boundary and x.c_start > 0):
            s["hits"] += 1
    rate = lambda miss, hit: miss / (hit + miss) if miss else 0.0
    big = max(s["c_inner"], s["o_inner"])
    s["chi2"] = chi2
    s["c_miss_rate"], s["o_miss_rate"] = rate(s["c_misses"], s["hits"]), rate(s["o_misses"], s["hits"])
    s["miss_rate"] = rate(s["c_misses"] + s["o_misses"], 2 * s["hits"])
    s["length_ratio"] = min(s["c_inner"], s["o_inner"]) / big if big else np.nan
    s["unaligned_ratio"] = s["unaligned_bases"] / contig_length if contig_length else np.nan
    return s


def passes(s: dict, p: Params) -> bool:
    """The acceptance test; a ratio of nothing to nothing passes it."""
    if s["inner_blocks"] and s["chi2"] / s["inner_blocks"] > p.max_avg_chi2:
        return False
    few = s["hits"] < p.min_hits if p.local else s["hits"] <= p.min_hits
    return not (s["length_ratio"] < p.min_length_ratio or s["c_miss_rate"] > p.max_miss_rate or few)


def chunk_parts(x: Chunk, contig: np.ndarray, optical: np.ndarray, p: Params) -> tuple[float, float, float]:
    """(query, reference, sizing) parts of a chunk's score, by its fragments: a boundary chunk's coordinates are no lengths."""
    sizes = contig[x.c_start : x.c_end]
    c, o = int(sizes.sum()), int(optical[x.o_start : x.o_end].sum())
    if x.gap:
        return (gap_score(c, p) if not p.local else 0.0, 0.0, 0.0)
    optical = -p.cost_optical * (x.o_end - x.o_start - 1)
    chi2 = (c - o) ** 2 / (p.sigma2 * c) if c else 0.0
    if p.local:
        return (-p.cost_contig * (x.c_end - x.c_start - 1), optical, -p.a * (chi2 - p.t2))
    return (block_cost(sizes.tolist(), p), optical, 0.0 if x.boundary and c < o else -chi2)


def may_pass(table: Table, i: np.ndarray, j: np.ndarray, c_bounds: np.ndarray, o_bounds: np.ndarray, p: Params) -> np.ndarray:
    """Whether the trails that end in the cells (i, j) pass the acceptance test; all trails are followed at once, a step at a time."""
    last, n = len(c_bounds) - 1, len(i)
    chi2, c_inner, o_inner = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    blocks, hits, c_misses = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at, i, j = np.arange(n), i.astype(np.int64), j.astype(np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        while len(at):
            k, q = table.row[i, j].astype(np.int64), table.col[i, j].astype(np.int64)
            on = (k >= 0) & (q >= 0)
            at, i, j, k, q = at[on], i[on], j[on], k[on], q[on]
            if not len(at):
                break
            solid = j != q
            edge = ((k == 0) | (i == last)) & p.boundaries
            c, o = c_bounds[i] - c_bounds[k], o_bounds[j] - o_bounds[q]
            inner, x = solid & ~edge, at[solid & ~edge]
            chi2[x] += ((o - c)[inner].astype(float) ** 2) / (p.sigma2 * c[inner])
            c_inner[x] += c[inner]
            o_inner[x] += o[inner]
            blocks[x] += 1
            c_misses[at[solid]] += (i - k - 1)[solid]
            hits[at[solid & ~(edge & (k > 0))]] += 1
            begins = (table.row[k, q] < 0) | (table.col[k, q] < 0)
            hits[at[begins & solid & ~edge]] += 1
            i, j = k, q
        ratio = np.minimum(c_inner, o_inner) / np.maximum(c_inner, o_inner)
        few = hits < p.min_hits if p.local else hits <= p.min_hits
        bad = (chi2 / blocks > p.max_avg_chi2) & (blocks > 0) | (ratio < p.min_length_ratio) | few
        return ~(bad | (c_misses > 0) & (c_misses / (hits + c_misses) > p.max_miss_rate))


def matches_of(contig: np.ndarray, optical: np.ndarray, n_chrom: int, sd: float, p: Params) -> list[Match]:
    """Accepted matches, best first: seeds in descending order of (score, row, column), no overlap (global) or no cell used twice (local)."""
    table = fill(contig, optical, n_chrom, sd, p)
    m, n = table.score.shape
    if p.local:
        i, j = np.nonzero(table.score[1:, 1:] > 0)
        i, j = i + 1, j + 1
    else:
        j = np.flatnonzero(table.score[m - 1, 1:] > NONE) + 1
        i = np.full(len(j), m - 1)
    c_sums, o_sums = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (contig, optical))
    good = may_pass(table, i, j, c_sums, o_sums, p)
    i, j = i[good], j[good]
    order = np.lexsort((j, i, table.score[i, j]))[::-1]
    c_bounds, o_bounds = c_sums.tolist(), o_sums.tolist()
    out: list[Match] = []
    used: set[tuple[int, int]] = set()
    for k in order.tolist():
        if p.max_matches >= 0 and len(out) == p.max_matches:
            break
        path = trail(table, int(i[k]), int(j[k]))
        if p.local and not used.isdisjoint(path):
            continue
        chunks = chunks_of(path, c_bounds, o_bounds, p)
        if not chunks:
            continue
        s = statistics(chunks, c_bounds[-1], p)
        if not passes(s, p):
            continue
        first, last = chunks[0].o_start, chunks[-1].o_end - 1
        if p.local:
            used.update(path)
        elif any(not (last <= x.chunks[0].o_start or first >= x.chunks[-1].o_end - 1) for x in out):
            continue
        for x in chunks:
            x.parts = chunk_parts(x, contig, optical, p)
        out.append(Match(float(table.score[i[k], j[k]]), chunks, s))
    return out


def best_score(contig: np.ndarray, optical: np.ndarray, n_chrom: int, sd: float, p: Params) -> float:
    """Best score of the last row, without acceptance test; -inf unless the best trail's last step comes from a row above 0.

    With ``one_to_one`` no score is ever taken from the corner cell, so the result is -inf.
    """
    if p.one_to_one:
        return NONE
    table = fill(contig, optical, n_chrom, sd, p.but(local=False))
    last = table.score[-1, 1:]
    if not len(last):
        return NONE
    j = int(np.argmax(last)) + 1  # the first of equal ones
    if last[j - 1] == NONE:
        return NONE
    return float(last[j - 1]) if table.row[len(contig), j] > 0 else NONE


def align_pair(contig: np.ndarray, optical: np.ndarray, p: Params) -> list[tuple[bool, int, Match]]:
    """(forward, sd, match) of both strands at the first tolerance that gives any match of either."""
    n_chrom = len(optical)
    if p.circular:
        optical = np.concatenate([optical, optical])
    for sd in range(p.sd_min, p.sd_max + 1):
        out = [(True, sd, x) for x in matches_of(contig, optical, n_chrom, sd, p)]
        if p.reverse:
            out += [(False, sd, x) for x in matches_of(contig[::-1].copy(), optical, n_chrom, sd, p)]
        if out:
            return out
    return []
