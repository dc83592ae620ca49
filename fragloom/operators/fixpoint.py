"""Placement of ambiguous records in turns, as a worklist on connected components.

A record takes up a run of a map's fragments.  In turns, the first query that has one record left is placed; what meets its fragments, or sticks out into a fragment that has
become too short, goes.  A turn changes only records that share a fragment or a query with the one placed, so records that are linked in
neither way are worked off apart from each other: components are found by tables, and each is settled in one task, in time proportional to its records' fragments.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from ..session import ship_package
from .components import components
from .ranges import islands

#: Standard deviations that a fragment may be longer than it was measured.
TOLERANCE = 12
#: Records of one component or of several are settled together from this number on.
BATCH = 50_000
RECORD = ("record", "contig_id", "op_start", "op_end", "c_start", "c_end", "o_first", "o_last")


def _spans(base: np.ndarray, n: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray) -> tuple[array, np.ndarray]:
    """(bounds, fragments): the numbers, within ``codes``, of the fragments from ``start`` to ``end`` - 1 of each record, one record's behind another's."""
    length = np.maximum(end - start, 0)
    bounds = np.concatenate([[0], np.cumsum(length)])
    place = np.repeat(start - bounds[:-1], length) + np.arange(bounds[-1])
    return array("q", bounds.tolist()), np.searchsorted(codes, np.repeat(base, length) + place % np.repeat(np.maximum(n, 1), length)).astype(np.int32)


class Board:
    """The state of some fragments and the records on them, as flat arrays."""

    def __init__(self, fragments: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], records: list[tuple]):
        """fragments: arrays of map's number, place, n (the map's number of fragments), size and sd; records: (map's number, *RECORD, fixed), in the order of (map, record)."""
        of_map, place, around, size, sd = fragments
        order = np.lexsort((place, of_map))
        codes = (of_map.astype(np.int64) << 40)[order] + place[order]
        self.size, self.sd = array("d", size[order].tolist()), array("d", sd[order].tolist())
        self.records, self.n = records, len(records)
        column = lambda k: np.array([r[k] for r in records], np.int64)
        base, start, end, first, last = column(0) << 40, column(3), column(4), column(7), column(8)
        n = around[order][np.minimum(np.searchsorted(codes, base), max(0, len(codes) - 1))] if len(codes) else np.ones(len(records), np.int64)
        self.runs, self.heads, self.tails = (_spans(base, n, x, y, codes) for x, y in ((start, end + 1), (start + 1, first), (last, end)))
        numbers: dict[tuple, int] = {}
        self.query = array("q", [numbers.setdefault((r[0], r[2]), len(numbers)) for r in records])
        self.status = ["rest"] * len(records)
        self.open = bytearray(not r[-1] for r in records)
        # Open records of a query: how many, and the exclusive or of their numbers.
        self.left, self.which = array("q", bytes(8 * len(numbers))), array("q", bytes(8 * len(numbers)))

    @staticmethod
    def of(spans: tuple[array, np.ndarray], r: int) -> list[int]:
        return spans[1][spans[0][r] : spans[0][r + 1]].tolist()

    def index(self, *kinds: tuple[array, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, records): the open records that have each fragment in one of their spans."""
        owner = np.concatenate([np.repeat(np.arange(self.n, dtype=np.int32), np.diff(np.frombuffer(bounds, np.int64))) for bounds, _ in kinds])
        fragment = np.concatenate([f for _, f in kinds])
        good = np.frombuffer(self.open, np.uint8)[owner] > 0
        owner, fragment = owner[good], fragment[good]
        order = np.argsort(fragment, kind="stable")
        return np.searchsorted(fragment[order], np.arange(len(self.size) + 1)), owner[order]

    def hangs(self, r: int) -> tuple[int, int]:
        """Query bp that stick out beyond the fragments next to the outermost matched sites, at both ends, as the map stands now."""
        out = []
        for own, span in ((self.records[r][5], self.of(self.heads, r)), (self.records[r][6], self.of(self.tails, r))):
            room = sum(self.size[f] for f in span) + TOLERANCE * math.sqrt(sum(self.sd[f] ** 2 for f in span))
            out.append(0 if own is None else max(int(own - room), 0))
        return out[0], out[1]

    def clashes(self, r: int) -> bool:
        run = self.of(self.runs, r)
        if any(self.sd[f] == 0 for f in run):
            return True
        return any(self.size[f] + TOLERANCE * self.sd[f] < hang for f, hang in zip((run[0], run[-1]), self.hangs(r), strict=True))

    def occupy(self, r: int) -> tuple[list[int], list[int]]:
        """Take up a record's fragments; gives those that are taken now and weren't before, and those that are shorter now."""
        run, taken, shorter = self.of(self.runs, r), [], []
        for f, hang in zip((run[0], run[-1]), self.hangs(r), strict=True):
            if hang and self.size[f] > 0:
                self.size[f] = max(self.size[f] - hang, 0)
                shorter.append(f)
        for f in run[1:-1]:
            if self.sd[f]:
                self.sd[f] = 0.0
                taken.append(f)
        return taken, shorter

    def close(self, r: int, status: str) -> None:
        self.status[r], self.open[r] = status, 0
        q = self.query[r]
        self.left[q] -= 1
        self.which[q] ^= r

    def settle(self) -> list[str]:
        """The status of each record: fixed ones ``fixed``, others ``placed``, ``conflict`` or ``rest``."""
        for r, record in enumerate(self.records):
            if record[-1]:
                self.occupy(r)
                self.status[r] = "fixed"
        for r, open_ in enumerate(self.open):
            if open_ and self.clashes(r):
                self.status[r], self.open[r] = "conflict", 0
            elif open_:
                self.left[self.query[r]] += 1
                self.which[self.query[r]] ^= r
        on, near = self.index(self.runs), self.index(self.heads, self.tails)
        at = lambda index, f: index[1][index[0][f] : index[0][f + 1]].tolist()
        ready = [r for r, open_ in enumerate(self.open) if open_ and self.left[self.query[r]] == 1]
        while ready:
            r = heapq.heappop(ready)
            if not self.open[r]:
                continue
            self.close(r, "placed")
            taken, shorter = self.occupy(r)
            gone = [x for f in taken for x in at(on, f)]  # a fragment is taken once
            tested = {x for f in shorter for x in (*at(on, f), *at(near, f))} | {x for f in taken for x in at(near, f)}
            for x in (*gone, *(x for x in tested if self.open[x] and self.clashes(x))):
                if self.open[x]:
                    self.close(x, "conflict")
                    if self.left[self.query[x]] == 1:
                        heapq.heappush(ready, self.which[self.query[x]])
        return self.status


def _node(kind: str, *columns: Column) -> Column:
    """Nodes are numbered by hash: two that share a number only make one component of two."""
    return F.xxhash64(F.lit(kind), *columns)


def settled(records: DataFrame, optical: DataFrame) -> DataFrame:
    """(map_id, record, contig_id, status) of ``records`` (map_id, fixed and RECORD), on ``optical`` (map_id, place from 0, size, sd).

    Fixed records are placed first, in their order, whatever they meet; then others in turns: ``placed``, ``conflict`` or, where a query has several left at the end, ``rest``.
    ``c_start`` and ``c_end`` are the query's bp outside its outermost matched sites (null: nothing sticks out), ``o_first`` and ``o_last`` the map's fragments there, so
    the fragments from op_start + 1 to o_first - 1 and from o_last to op_end - 1 give way.  Places are taken modulo the map's number of fragments.  A record on a map
    without fragments is ``rest``.  Repeated records are records each; an empty table gives no rows.
    """
    ship_package(records.sparkSession)
    n = optical.groupBy("map_id").agg(F.count("*").cast("int").alias("n"))
    rows = cut(records.select("map_id", *RECORD, "fixed").join(n, "map_id", "left"), "records")
    low, high = F.least("op_start", F.coalesce("o_last", "op_start")), F.greatest("op_end", F.coalesce("o_first", "op_end") - 1)
    query = _node("query", F.col("map_id"), F.col("contig_id"))
    # A record's run of fragments, or the two that it falls into where it goes past the map's end; runs that share a fragment are an island.
    reached = rows.filter("n > 0").select("map_id", "n", query.alias("q"), F.pmod(low, F.col("n")).alias("low"), F.greatest(high - low, F.lit(0)).alias("more"))
    run = lambda a, b: F.struct(a.cast("bigint").alias("a"), (b + 1).cast("bigint").alias("z"))
    first, n_, end = F.col("low"), F.col("n"), F.col("low") + F.col("more")
    runs = F.when(F.col("more") + 1 >= n_, F.array(run(F.lit(0), n_ - 1))).when(end < n_, F.array(run(first, end))).otherwise(F.array(run(first, n_ - 1), run(F.lit(0), end - n_)))
    pieces = reached.select("map_id", "q", F.explode(runs).alias("x")).select("map_id", "q", "x.a", "x.z").distinct()
    joined = cut(islands(pieces, ["map_id"], F.col("a"), F.col("z"), [F.col("q")]), "islands")
    island = _node("island", F.col("map_id"), F.col("island"))
    labels = components(joined.select(F.col("q").alias("a"), island.alias("b")))

    owned = rows.withColumn("node", query).join(labels, "node", "left").select("label", F.lit(1).alias("kind"), "map_id", "n", *RECORD, "fixed", F.lit(0.0).alias("size"), F.lit(0.0).alias("sd"))
    # Fragments outside all islands are no record's; those between a map's first and last are held against the places that the islands cover.
    covered = joined.groupBy("map_id", "island").agg(F.min("a").alias("a"), F.max("z").alias("z")).withColumn("node", island).join(labels, "node")
    spans = joined.groupBy("map_id").agg(F.min("a").alias("a_"), F.max("z").alias("z_")).join(n, "map_id")
    near = optical.join(spans, "map_id").filter((F.col("place") >= F.col("a_")) & (F.col("place") < F.col("z_"))).drop("a_", "z_")
    state = near.join(covered.select("map_id", "label", F.explode(F.sequence("a", F.col("z") - 1)).alias("place")).hint("merge"), ["map_id", "place"])
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in RECORD[1:]]
    state = state.select("label", F.lit(0).alias("kind"), "map_id", "n", F.col("place").cast(rows.schema["record"].dataType).alias("record"), *nothing, F.lit(False).alias("fixed"), F.col("size").cast("double").alias("size"), F.col("sd").cast("double").alias("sd"))
    kinds = {c: rows.schema[c].dataType for c in ("map_id", "record", "contig_id")}
    schema = ", ".join([*[f"{c} {k.simpleString()}" for c, k in kinds.items()], "status string"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        mine: list[tuple] = []
        numbers: dict = {}
        last = types = None

        def done() -> pa.RecordBatch:
            names = list(numbers)
            placed = sorted((r for r in mine if r[1]), key=lambda r: (r[0], r[2]))
            fragments = tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 5
            status = Board(fragments, [(r[0], *r[2:]) for r in placed]).settle()
            out = [(names[r[0]], r[2], r[3], s) for r, s in zip(placed, status, strict=True) if not r[-1]]
            out += [(names[r[0]], r[2], r[3], "rest") for r in mine if not r[1] and not r[-1]]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=[*kinds, "status"])

        for batch in batches:
            types = types or [batch.schema.field(c).type for c in kinds] + [pa.string()]
            label = batch.column("label").fill_null(0).to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])).tolist()
            for a, b in zip(begins, [*begins[1:], batch.num_rows], strict=True):
                if label[a] != last and len(mine) >= BATCH:
                    yield done()
                    parts, mine, numbers = [], [], {}
                last = label[a]
                own = batch.slice(a, b - a)
                is_record = own.column("kind").to_numpy(zero_copy_only=False) > 0
                number = [numbers.setdefault(m, len(numbers)) for m in own.column("map_id").to_pylist()]
                if not is_record.all():
                    state = own.filter(pa.array(~is_record))
                    parts.append((np.array(number)[~is_record], *[state.column(c).to_numpy(zero_copy_only=False) for c in ("record", "n", "size", "sd")]))
                if is_record.any():
                    rows = own.filter(pa.array(is_record))
                    mine += zip(np.array(number)[is_record].tolist(), *[rows.column(c).to_pylist() for c in ("n", *RECORD, "fixed")], strict=True)
        if mine:
            yield done()

    dealt = owned.unionByName(state).repartition("label").sortWithinPartitions("label", "kind")
    return dealt.mapInArrow(work, schema)
