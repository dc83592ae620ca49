"""Alignment of query maps to reference maps as one distributed operator.

Reference maps are the large side and stay where they are.  Queries go to them in blocks of a bounded number of fragments: the
block table is joined by block number, broadcast while it is small and shuffled beyond.  Both strands and all tolerances of a
(query, map) pair are one kernel call, because they stop together.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..params import Params
from ..scratch import cut
from ..session import ship_package
from .kernel import Match, align_pair, best_score
from .ranges import islands

I, D, B, S = T.IntegerType(), T.DoubleType(), T.BooleanType(), T.StringType()  # noqa: E741
SIDE = T.StructType([T.StructField("start", I), T.StructField("end", I), T.StructField("start_bp", I), T.StructField("end_bp", I), T.StructField("frags", T.ArrayType(I))])
CHUNK = T.StructType([
    T.StructField("contig", SIDE), T.StructField("optical", SIDE), T.StructField("is_contig_gap", B), T.StructField("is_boundary_chunk", B),
    T.StructField("score", T.StructType([T.StructField("contig", D), T.StructField("optical", D), T.StructField("sizing", D)])),
])
PLACED = T.StructType([
    T.StructField("contig_id", S), T.StructField("contig_length", I), T.StructField("num_frags", I), T.StructField("chromosome", S), T.StructField("forward", B), T.StructField("sd", I),
    T.StructField("score", D), T.StructField("alignment", T.ArrayType(CHUNK)),
])


def twins(contigs: DataFrame) -> DataFrame:
    """Both strands of each map: the forward row, and the reversed one, whose ``twin_id`` ends in ``.r``."""
    strands = F.array(F.struct(F.lit(True).alias("forward"), F.col("frags").alias("frags"), F.col("map_id").alias("twin_id")), F.struct(F.lit(False).alias("forward"), F.reverse("frags").alias("frags"), F.concat("map_id", F.lit(".r")).alias("twin_id")))
    others = [c for c in contigs.columns if c != "frags"]
    return contigs.select(*others, F.explode(strands).alias("strand")).select(*others, "strand.*")


def with_queries(maps: DataFrame, contigs: DataFrame, block_frags: int = 20_000, broadcast_mb: int = 32, by: str | None = None, more: tuple[str, ...] = (), task_cells: int = 50_000_000, facts: tuple[str, ...] = ()) -> DataFrame:
    """Each map with each block of queries (``by``: of its own group): map_id, frags, queries (array of q_id, q_frags and ``facts`` columns of the queries) and ``more`` columns of the maps.

    Blocks follow the number of fragments, so none is much larger than ``block_frags``; the queries' total decides on the broadcast.  Pairs are dealt out to as many tasks as the
    cells of their score tables ask for, ``task_cells`` each, and to all cores where they are few, because the kernel's work is far larger than its rows.
    """
    group = [F.col(by).alias("group")] if by else [F.lit(0).alias("group")]
    short = contigs.select(*group, F.col("map_id").alias("q_id"), F.col("frags").alias("q_frags"), *facts)
    sizes = short.groupBy("group").agg(F.sum(F.size("q_frags")).alias("n_q"), F.sum(F.octet_length("q_id") + 16).alias("ids"))
    cells = sizes.join(maps.select(*group, F.size("frags").alias("n_o")).groupBy("group").agg(F.sum("n_o").alias("n_o")), "group")
    total = cells.agg(F.coalesce(F.sum(F.col("n_q").cast("double") * F.col("n_o")), F.lit(0.0)).alias("cells"), F.coalesce(F.sum("n_q"), F.lit(0)).alias("frags"), F.coalesce(F.sum("ids"), F.lit(0)).alias("ids")).first()
    sizes = sizes.select("group", F.greatest(F.lit(1), F.ceil(F.col("n_q") / block_frags)).cast("int").alias("blocks"))
    short = short.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("q_id"), F.col("blocks")).cast("int"))
    tables = short.groupBy("group", "block").agg(F.sort_array(F.collect_list(F.struct("q_id", "q_frags", *facts))).alias("queries"))
    tables = F.broadcast(tables) if total["frags"] * 4 + total["ids"] <= broadcast_mb << 20 else tables
    pairs = maps.select(*group, "map_id", "frags", *more).join(sizes, "group").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = max(8, 4 * maps.sparkSession.sparkContext.defaultParallelism, int(total["cells"] // task_cells))
    return pairs.repartition(min(tasks, 200_000), "map_id", "block", *more).join(tables, ["group", "block"]).select("map_id", "frags", "queries", *more)


def match_row(contig_id: str, contig: np.ndarray, map_id: str, optical: np.ndarray, forward: bool, sd: int, m: Match) -> dict:
    sizes = contig if forward else contig[::-1]
    chunks = []
    for x in m.chunks:
        c = {"start": x.c_start, "end": x.c_end, "start_bp": x.c_start_bp, "end_bp": x.c_end_bp, "frags": sizes[x.c_start : x.c_end].tolist()}
        o = {"start": x.o_start, "end": x.o_end, "start_bp": x.o_start_bp, "end_bp": x.o_end_bp, "frags": optical[x.o_start : x.o_end].tolist()}
        chunks.append({"contig": c, "optical": o, "is_contig_gap": x.gap, "is_boundary_chunk": x.boundary, "score": dict(zip(("contig", "optical", "sizing"), x.parts, strict=True))})
    return {"contig_id": contig_id, "contig_length": int(contig.sum()), "num_frags": len(contig), "chromosome": map_id, "forward": forward, "sd": sd, "score": m.score, "alignment": chunks}


def place(contigs: DataFrame, maps: DataFrame, p: Params, by: str | None = None) -> DataFrame:
    """All accepted matches, as :data:`PLACED`.  Queries of two fragments or fewer are left out unless ``one_to_one``.

    Inputs have map_id and frags; a null or an empty list of fragments gives no match.  ``by`` names a column of both, such as the genome: queries go to maps of
    their own group only.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(maps.sparkSession)
    queries = contigs.filter(F.size("frags") > (0 if p.one_to_one else 2))
    schema = to_arrow_schema(PLACED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for map_id, frags, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not frags:
                    continue
                optical, rows = np.array(frags, dtype=np.int64), []
                shown = np.concatenate([optical, optical]) if p.circular else optical
                for q in block:
                    contig = np.array(q["q_frags"], dtype=np.int64)
                    rows += [match_row(q["q_id"], contig, map_id, shown, f, sd, m) for f, sd, m in align_pair(contig, optical, p)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return with_queries(maps, queries, by=by).mapInArrow(run, PLACED)


def with_statistics(placed: DataFrame, p: Params) -> DataFrame:
    """Coordinates, hits, misses, rates and sizing error of matches, from their chunks.

    A ratio of nothing to nothing is NaN.  The first chunk's left site counts as a hit if it is neither a gap nor a boundary chunk; the right site of each chunk that isn't a gap
    counts, but for a boundary chunk that doesn't begin the query.
    """
    first, last = F.get("alignment", F.lit(0)), F.element_at("alignment", -1)
    solid = F.filter("alignment", lambda x: ~x["is_contig_gap"])
    gaps = F.filter("alignment", lambda x: x["is_contig_gap"])
    inner = F.filter(solid, lambda x: ~x["is_boundary_chunk"])

    def total(chunks: Column, of) -> Column:
        return F.aggregate(chunks, F.lit(0), lambda acc, x: acc + of(x).cast("int"))

    def bases(side: str):
        return lambda x: x[side]["end_bp"] - x[side]["start_bp"]

    def misses(side: str):
        return lambda x: x[side]["end"] - x[side]["start"] - 1

    def deviation(x: Column) -> Column:
        d, c = (bases("optical")(x) - bases("contig")(x)).cast("double"), bases("contig")(x).cast("double")
        return F.when(c > 0, d * d / (c * F.lit(p.sigma2))).otherwise(F.when(d == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf"))))

    ends = F.filter(solid, lambda x: ~(x["is_boundary_chunk"] & (x["contig"]["start"] > 0)))
    left = F.when(first["is_contig_gap"] | first["is_boundary_chunk"], 0).otherwise(1)
    out = placed.withColumns({
        "c_start_index": first["contig"]["start"], "c_end_index": last["contig"]["end"] - 1, "c_start_bp": first["contig"]["start_bp"], "c_end_bp": last["contig"]["end_bp"],
        "c_aligned_bases": total(solid, bases("contig")), "op_start_index": first["optical"]["start"], "op_end_index": last["optical"]["end"] - 1,
        "op_start_bp": first["optical"]["start_bp"], "op_end_bp": last["optical"]["end_bp"], "op_aligned_bases": total(solid, bases("optical")),
        "contig_hits": F.size(ends) + left, "optical_hits": F.size(ends) + left, "contig_misses": total(solid, misses("contig")), "optical_misses": total(solid, misses("optical")),
        "contig_unaligned_bases": total(gaps, bases("contig")), "contig_unaligned_frags": total(gaps, lambda x: x["contig"]["end"] - x["contig"]["start"]),
        "inner_blocks": F.size(inner), "c_inner": total(inner, bases("contig")), "o_inner": total(inner, bases("optical")),
        "chi2": F.aggregate(inner, F.lit(0.0), lambda acc, x: acc + deviation(x)),
    })

    def rate(miss: Column, hit: Column) -> Column:
        return F.when(miss == 0, F.lit(0.0)).otherwise(miss / (hit + miss))

    more, less = F.greatest("c_inner", "o_inner"), F.least("c_inner", "o_inner")
    nan = F.lit(float("nan"))
    hits, c_miss, o_miss = F.col("contig_hits"), F.col("contig_misses"), F.col("optical_misses")
    return out.withColumns({
        "total_hits": 2 * hits, "total_misses": c_miss + o_miss, "total_miss_rate": rate(c_miss + o_miss, 2 * hits), "contig_miss_rate": rate(c_miss, hits), "optical_miss_rate": rate(o_miss, hits),
        "aligned_length_ratio": F.when(more > 0, less / more).otherwise(nan),
        "contig_unaligned_base_ratio": F.when(F.col("contig_length") > 0, F.col("contig_unaligned_bases") / F.col("contig_length")).otherwise(nan),
    })


def accepted(matches: DataFrame, p: Params) -> Column:
    """The acceptance test on statistics; NaN ratios pass it."""
    bad_size = (F.col("inner_blocks") > 0) & (F.col("chi2") / F.greatest("inner_blocks", F.lit(1)) > p.max_avg_chi2)
    short = ~F.isnan("aligned_length_ratio") & (F.col("aligned_length_ratio") < p.min_length_ratio)
    few = F.col("contig_hits") < p.min_hits if p.local else F.col("contig_hits") <= p.min_hits
    return ~(bad_size | short | (F.col("contig_miss_rate") > p.max_miss_rate) | few)


def best_first() -> tuple[Column, ...]:
    """A total order, for equal scores too."""
    return F.col("score").desc(), F.col("chromosome"), F.col("forward").desc(), F.col("op_start_index"), F.col("op_end_index")


def top_matches(matches: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query (all if ``k`` isn't above 0), with their rank from 1."""
    ranked = matches.withColumn("rank", F.row_number().over(Window.partitionBy("contig_id").orderBy(*best_first())))
    return ranked.filter(F.col("rank") <= k) if k > 0 else ranked


def align(contigs: DataFrame, maps: DataFrame, p: Params | None = None, by: str | None = None) -> DataFrame:
    """Placements with statistics, at most ``max_matches`` for each query; ``pval`` is 0 until :mod:`significance` sets it."""
    p = p or Params()
    return top_matches(with_statistics(place(contigs, maps, p, by), p), p.max_matches).withColumn("pval", F.lit(0.0))


#: One map in so many is searched before all are.
FIRST = 64


def null_scores(random_contigs: DataFrame, maps: DataFrame, p: Params, by: str | None = None) -> DataFrame:
    """Per random query (map_id, frags): its best score over all maps and both strands at the largest tolerance, always global; null if there is none.

    ``by`` names an integer column of the maps, such as a trial's number: then a score for each of its values.  Best scores over one map in :data:`FIRST` come first: they are the budgets with which all maps are
    searched (:mod:`bounded`).
    """
    from .bounded import best_over, served
    from .pruned import Index

    ship_package(maps.sparkSession)
    schema = T.StructType([T.StructField("map_id", S), T.StructField("by", I), T.StructField("score", D)])
    # Equal maps give equal scores, and only the best counts.
    maps = maps.withColumn("_by", F.col(by).cast("int") if by else F.lit(0)).groupBy("_by", "frags").agg(F.min("map_id").alias("map_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], float] = {}  # the best of this task so far is the budget of what follows
        for batch in in_slices(batches, 200):
            best: dict[tuple[str, int], float] = {}
            queries: dict[str, np.ndarray] = {}
            asked: dict[tuple[int, tuple[str, ...]], list[tuple[str, np.ndarray]]] = {}
            for map_id, frags, block, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for q in block:
                    if q["q_id"] not in queries:
                        queries[q["q_id"]] = np.array(q["q_frags"], dtype=np.int64)
                    if q["known"] is not None:
                        known.setdefault((q["q_id"], value), q["known"])
                optical = np.array(frags or [], dtype=np.int64)
                asked.setdefault((value, tuple(q["q_id"] for q in block)), []).append((map_id, np.concatenate([optical, optical]) if p.circular else optical))
            for (value, ids), own in asked.items():
                # Few maps at first where nothing is known.
                cuts = [0, len(own)] if all((q, value) in known for q in ids) else [0, 1, 4, 16, 64, len(own)]
                parts = [Index(own[a:b], p.delta) for a, b in zip(cuts, cuts[1:], strict=False) if own[a:b]]
                for q in ids:
                    contig, key = queries[q], (q, value)
                    if served(contig, p):
                        for index in parts:
                            known[key] = best_over(contig, index, p, known.get(key, -np.inf))
                        score = known[key]
                    else:
                        score = max(best_score(x, o, len(o) // 2 if p.circular else len(o), p.sd_max, p) for _, o in own for x in (contig, contig[::-1].copy()))
                    best[key] = max(best.get(key, -np.inf), score)
            scores = [None if x == -np.inf else x for x in best.values()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in best], pa.string()), pa.array([v for _, v in best], pa.int32()), pa.array(scores, pa.float64())], names=schema.names)

    def over(own: DataFrame, queries: DataFrame) -> DataFrame:
        each = with_queries(own, queries, more=("_by",), task_cells=500_000_000, facts=("known",)).mapInArrow(run, schema)
        return each.groupBy("map_id", "by").agg(F.max("score").alias("score"))

    queries = random_contigs.select("map_id", "frags")
    if by is None:
        few = over(maps.filter(F.pmod(F.xxhash64("map_id"), F.lit(FIRST)) == 0), queries.withColumn("known", F.lit(None).cast("double")))
        queries = cut(queries.join(few.select("map_id", F.col("score").alias("known")), "map_id", "left"), "known")
    else:
        queries = queries.withColumn("known", F.lit(None).cast("double"))
    best = over(maps, queries)
    return best.withColumnRenamed("by", by) if by else best.drop("by")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Index intervals overlap; the inclusive ends are taken as exclusive, so sharing one fragment is none."""
    return ~((a_end <= b_start) | (a_start >= b_end))


def greedy_ids(matches: DataFrame, by: list[str], order: list[Column], start: str, end: str) -> DataFrame:
    """(match_id) of the ``matches`` that stay when taken in ``order`` within ``by``: one goes if its interval overlaps that of any that stayed.

    Islands of intervals are found over ranges, so that many tasks share a map.  Each is sorted by the order and read as a stream; what stayed in the island at hand, intervals without
    overlap, is all that is held in memory, and each row is tested against its neighbours there only.
    """
    ship_package(matches.sparkSession)
    kind = matches.schema["match_id"].dataType
    rows = islands(matches.drop("alignment", "island"), by, F.col(start), F.col(end), [F.col("match_id")])
    keys = [F.xxhash64(*by).alias("g_"), *[F.col(c).cast("string").alias(f"b{i}_") for i, c in enumerate(by)], F.col("island")]
    names = ["g_", *[f"b{i}_" for i in range(len(by))], "island"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stayed = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[: len(names) + 2]]
            good = np.zeros(batch.num_rows, dtype=bool)
            for i, (*key, s, e) in enumerate(zip(*columns, strict=True)):
                if key != last:
                    last, stayed = key, []
                k = bisect_right(stayed, (s, e))
                # Intervals that stayed are in order; only those next to this one can overlap it.
                if any(not (e <= x or s >= y) for x, y in stayed[max(0, k - 1) : k + 1]):
                    continue
                good[i] = True
                stayed.insert(k, (s, e))
            yield batch.select([batch.num_columns - 1]).filter(pa.array(good))

    dealt = rows.select("*", *keys[:-1]).repartition(*names).sortWithinPartitions(*names, *order)
    return dealt.select(*names, start, end, "match_id").mapInArrow(run, T.StructType([T.StructField("match_id", kind)]))


def non_overlapping(matches: DataFrame, by: list[str] | None = None, k: int = -1) -> DataFrame:
    """Greedy selection, best score first, within ``by`` (query, map and strand): a match stays unless it overlaps one that stayed; at most ``k`` stay if that isn't negative."""
    by = by or ["contig_id", "chromosome", "forward"]
    order = [F.col("score").desc(), F.col("op_start_index"), F.col("op_end_index"), F.col("match_id")]
    short = matches.select("match_id", "score", "op_start_index", "op_end_index", *[c for c in by if c not in ("score", "op_start_index", "op_end_index")])
    stay = greedy_ids(short, by, order, "op_start_index", "op_end_index")
    if k >= 0:
        best = short.join(stay, "match_id", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        stay = best.filter(F.col("place") <= k).select("match_id")
    return matches.join(stay, "match_id", "left_semi")


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 100) -> Iterator[pa.RecordBatch]:
    """Parts of ``batches`` of a few rows each: whole fragment lists of a full batch as Python numbers would take hundreds of MB."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def best_scores(pairs: DataFrame, p: Params) -> DataFrame:
    """(contig_id, map_id, score, cells) of pairs (contig_id, c_frags, map_id, o_frags): the best score of the last row (local: of any cell), one strand, tolerance ``sd_min``,
    and the number of reachable (local: positive) cells there.  A null score means that no alignment is possible."""
    from .kernel import fill

    ship_package(pairs.sparkSession)
    schema = T.StructType([T.StructField("contig_id", S), T.StructField("map_id", S), T.StructField("score", D), T.StructField("cells", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows = []
            for contig_id, c, map_id, o in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                t = fill(np.array(c, np.int64), np.array(o, np.int64), len(o), p.sd_min, p).score
                cells = t[t > 0] if p.local else t[-1, 1:][t[-1, 1:] > -np.inf]
                rows.append({"contig_id": contig_id, "map_id": map_id, "score": float(cells.max()) if len(cells) else None, "cells": len(cells)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("contig_id", pa.string()), ("map_id", pa.string()), ("score", pa.float64()), ("cells", pa.int64())]))

    return pairs.select("contig_id", "c_frags", "map_id", "o_frags").mapInArrow(run, schema)


def score_cells(pairs: DataFrame, p: Params, by_count: bool = False) -> DataFrame:
    """(contig_id, map_id, i, j, score, from_i, from_j): all reachable cells of the score tables of ``pairs``, for inspection.

    ``by_count`` uses costs by the number of missed sites and blocks of one fragment more.
    """
    from .kernel import fill

    ship_package(pairs.sparkSession)
    schema = T.StructType([T.StructField("contig_id", S), T.StructField("map_id", S), *[T.StructField(c, I) for c in ("i", "j")], T.StructField("score", D), *[T.StructField(c, I) for c in ("from_i", "from_j")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            for contig_id, c, map_id, o in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                t = fill(np.array(c, np.int64), np.array(o, np.int64), len(o), p.sd_min, p, by_count)
                i, j = np.nonzero(t.score > -np.inf)
                n = len(i)
                yield pa.RecordBatch.from_arrays([pa.array([contig_id] * n, pa.string()), pa.array([map_id] * n, pa.string()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(t.score[i, j]), pa.array(t.row[i, j]), pa.array(t.col[i, j])], names=schema.names)

    return pairs.select("contig_id", "c_frags", "map_id", "o_frags").mapInArrow(run, schema)
