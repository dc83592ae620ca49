"""Best-two-fit packing of whole documents into sequences of a fixed length.

Packing needs lengths only, and there are at most ``capacity`` of them.  So the plan is made once for the whole corpus from
the number of pieces of each length: at most ``capacity`` counts reach the driver, whatever the corpus holds.  A sequence is
filled greedily (the longest piece that still fits), then its smallest piece is replaced by the two unpacked pieces that fit
the gap so widened most tightly, if they fill more of it.  Equal sequences are planned together, as often as the counts
allow, so the plan has few distinct patterns.  Pieces then get their rank among those of their length, in parallel, and
the rank gives the sequence.  No piece is dropped and no text is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import bound_batches, id_type, keep, lean, only, with_id
from .tokens import Encoder, gather

#: The id's own type replaces the first one.
PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("local_rank", T.LongType()),
])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, with a shorter first one where ``n`` isn't a multiple."""
    head = n % capacity
    starts = ([(0, head)] if head else []) + [(x, capacity) for x in range(head, n, capacity)]
    return starts


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id`` and cut what is longer than ``capacity``.  Null texts count as empty.

    ``part`` and ``local_rank`` number the pieces of each length within a task.
    """
    bound_batches(docs.sparkSession)

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, seen = TaskContext.get().partitionId(), Encoder.of(tokenizer, spaced=True), [0] * (capacity + 1)
        for batch in gather(batches, 3_000_000):
            ends, values = encoder.encode_column(batch.column(1), end_id)
            data, rows = memoryview(values).cast("B"), []
            for doc_id, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                for k, (start, length) in enumerate(cut(b - a, capacity)):
                    crc = zlib.crc32(data[4 * (a + start) : 4 * (a + start + length)])
                    rows.append((doc_id, k, start, length, crc, part, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (id_kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)],
                names=PIECES.names,
            )

    rows = with_id(only(docs, doc_id=id_col, text=text_col))
    kind = id_type(rows, "doc_id")
    id_kind = to_arrow_type(kind)
    return rows.mapInArrow(encode, T.StructType([T.StructField("doc_id", kind), *PIECES.fields[1:]]))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences), from the number of pieces of each length."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    at = np.arange(capacity + 1)
    out: list[tuple[list[int], int]] = []

    def longest_within() -> np.ndarray:
        """For each room, the longest length left that fits, or 0."""
        return np.maximum.accumulate(np.where(left > 0, at, 0))

    fits = longest_within()
    while fits[capacity]:
        room, bin_, used = capacity, [], {}
        while room and (x := int(fits[room])):
            # A length may be used up inside this very sequence: then take the next one down.
            while x and used.get(x, 0) >= left[x]:
                x = int(fits[x - 1])
            if not x:
                break
            bin_.append(x)
            used[x] = used.get(x, 0) + 1
            room -= x
        if room and bin_:
            small = min(bin_)
            gap = room + small
            free = left.copy()
            for x, n in used.items():
                free[x] -= n
            below = np.maximum.accumulate(np.where(free > 0, at, 0))
            first = np.arange(1, gap // 2 + 1)
            first = first[free[first] > 0]
            if len(first):
                second = below[gap - first]
                alone = (second == first) & (free[first] < 2)
                second = np.where(alone, below[np.maximum(first - 1, 0)], second)
                total = np.where(second > 0, first + second, 0)
                best = int(np.argmax(total))
                if total[best] > small:
                    bin_.remove(small)
                    bin_ += [int(first[best]), int(second[best])]
        need: dict[int, int] = {}
        for x in bin_:
            need[x] = need.get(x, 0) + 1
        times = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
        out.append((bin_, times))
        if any(left[x] == 0 for x in need):
            fits = longest_within()
    return out


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): ranks of a length go to consecutive sequences."""
    used: dict[int, int] = {}
    sequence, out = 0, []
    for bin_, times in patterns:
        offset = 0
        for x in bin_:
            rank = used.get(x, 0)
            out.append((x, rank, rank + times, sequence, offset))
            used[x] = rank + times
            offset += x
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is packed, rows with equal or null ids too; a null or empty text is the end id alone.  An empty table
    gives no rows.  Ids may be of any type; other columns are not read.  Pieces are written once to the shared folder, so their ranks hold
    when a task is run again.
    """
    spark = docs.sparkSession
    rows = keep(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    each = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    each = keep(each, "piece-counts")
    counts = {r.length: r.n for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = slots(plan(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = each.select("length", "part", F.coalesce(before, F.lit(0)).alias("rank_before"))
    ranked = rows.join(offsets, ["length", "part"]).withColumn("rank", F.col("rank_before") + F.col("local_rank"))
    # The plan's size depends on the capacity and the counts' spread, not on the corpus: slots of a length are looked up by binary search, not joined.
    columns = np.array(table, dtype=np.int64).reshape(-1, 5)
    columns = columns[np.lexsort((columns[:, 1], columns[:, 0]))]
    lookup = spark.sparkContext.broadcast(columns)
    kind = id_type(rows, "doc_id")

    @lean
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots_ = lookup.value
        span = np.int64(1) << 40
        keys = slots_[:, 0] * span + slots_[:, 1]  # ascending by length, then rank
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            sequence = slots_[at, 3] + rank - slots_[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(slots_[at, 4])], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = T.StructType([T.StructField("doc_id", kind), *PIECES.fields[1:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placed, schema)
