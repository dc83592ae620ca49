"""Near-duplicate documents by SimHash fingerprints of 64 bits: all pairs that differ in a few bits, linked into components.

1. Every whole text gives a fingerprint; rows of equal fingerprints are one point, so copies cost nothing from here on.
2. Points are embedded by their segments' bit counts: 32 segments of two bits, in two halves.  A count changes by one at most for each bit that differs, so the
   Manhattan distance of two embeddings is never larger than the number of differing bits, and in one of the halves it is half of that at most.
3. A grid over each half: a point goes to the cell of its counts and to all cells at distance one (for four bits).  Two points at Manhattan distance two or less in a
   half share a cell, the one between them, so an equal-key join on cells meets every pair in question, without any pair of cells.
4. Cells are read as sorted streams.  A cell of few points is settled at once, all its pairs by counted bits, and only a forest of what is linked goes on.
5. The points of a crowded cell are first held against its least one; what that links forms components, which leave few crowded cells with more than one.
6. In those, points outside a cell's main component are joined with the others, in pairs of blocks of bounded size; counted bits verify each pair.

No pairs are kept but links; the number of cells of a point is a constant, so tables grow with the number of points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, forget, id_type, keep, lean, only, short_rows, with_id
from .components import components

BITS = 64
#: Bits of a segment, and segments of a half.
SEGMENT, HALF = 2, 16
WHITE = re.compile(rb"[\x20\x09-\x0D]")


def pieces_of(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes that end at white space; a word is never parted."""
    at = 0
    while at < len(data):
        gap = WHITE.search(data, at + size)
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def shingle_hashes(text: str | None, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of ``width`` words (A-Z in lower case, parted at ASCII white space, joined by spaces), repeats included, in batches.

    A text of fewer words is one shingle, one without words has none.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    words: list[bytes] = []
    some = False
    for piece in pieces_of(data):
        words = words[len(words) - width + 1 :] if some else words
        words += piece.split()
        n = len(words) - width + 1
        if n > 0:
            some = True
            shingles = map(b" ".join, zip(*[words[k:] for k in range(width)], strict=False))
            yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    if words and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The bits that more than half of the shingles' hashes have set; 0 for a text without words."""
    n, ones = 0, np.zeros(BITS, np.int64)
    for h in shingle_hashes(text, width, seed):
        n += len(h)
        for k in range(0, len(h), 1 << 14):
            bits = np.unpackbits(h[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of rows (doc_id, text); fp is a signed long.  Memory is that of a text and a batch of its words."""
    bound_batches(docs.sparkSession)

    @lean
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            fps = np.array([fingerprint(t, width, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {id_type(docs, 'doc_id').simpleString()}, fp long")


def bits_apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def cells(points: DataFrame, distance: int) -> DataFrame:
    """(cell, fp): for both halves the cell of a point's counts and, unless ``distance`` is below 2, those at Manhattan distance one.

    Of two points within ``distance`` bits, the Manhattan distance of one half is half of that at most; both reach a cell between them if it is two or less, so
    ``distance`` may be 5 at most.  A point has some 50 cells.
    """
    reach = (distance // 2 + 1) // 2
    if not 0 <= reach <= 1:
        raise ValueError("distances of up to 5 bits")
    count = lambda k: F.bit_count(F.shiftrightunsigned("fp", SEGMENT * k).bitwiseAND(F.lit((1 << SEGMENT) - 1)))
    base = SEGMENT + 1
    rows = points.select("fp", *[count(k).alias(f"n{k}") for k in range(2 * HALF)])
    own = lambda h: sum((F.col(f"n{h * HALF + k}") * F.lit(base**k) for k in range(HALF)), F.lit(h * base**HALF)).cast("bigint")
    rows = rows.select("*", own(0).alias("c0"), own(1).alias("c1"))
    steps = []
    for h in range(2):
        cell = F.col(f"c{h}")
        steps.append(cell)
        for k in range(HALF * reach):
            n = F.col(f"n{h * HALF + k}")
            steps += [F.when(n < SEGMENT, cell + base**k), F.when(n > 0, cell - base**k)]
    return rows.select("fp", F.explode(F.array_compact(F.array(*steps))).alias("cell"))


def split_links(mixed: DataFrame, distance: int, block: int) -> DataFrame:
    """(a, b): links between components of ``mixed`` (cell, fp, label), for each cell those of points outside its main component with all its points.

    The points of either side are dealt out to blocks of about ``block``; a row is copied once for each block of the other side, and a pair of blocks is the join's key,
    so no key has more than about ``block`` rows on either side.
    """
    sizes = mixed.groupBy("cell", "label").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"))
    blocks = lambda c: F.ceil(c / block).cast("int")
    sizes = sizes.select("cell", F.col("top.label").alias("main"), blocks(F.col("n") - F.col("top.n")).alias("n_i"), blocks(F.col("n")).alias("n_j")).filter("n_i > 0")
    rows = mixed.join(sizes, "cell")
    own = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = rows.filter("label <> main").select("cell", F.col("fp").alias("a"), F.col("label").alias("a_label"), own("n_i").alias("i"), every("n_j").alias("j"))
    all_ = rows.select("cell", F.col("fp").alias("b"), F.col("label").alias("b_label"), (F.col("label") == F.col("main")).alias("is_main"), own("n_j").alias("j"), every("n_i").alias("i"))
    pairs = few.join(all_, ["cell", "i", "j"]).filter((F.col("a_label") != F.col("b_label")) & (F.col("is_main") | (F.col("a") < F.col("b"))) & (bits_apart("a", "b") <= distance))
    return pairs.select("a", "b").distinct()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it is linked with) for the linked nodes that aren't the least themselves."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            own = label != np.arange(len(nodes))
            return nodes[own], nodes[label[own]]


class Cells:
    """Points (cell, fp) in the order of their cells, as they arrive: connections of cells with up to ``crowd`` points, and the points of the others."""

    def __init__(self, distance: int, crowd: int, hold: int = 1 << 20):
        self.distance, self.crowd, self.hold = distance, crowd, hold
        self.cell = self.fp = np.zeros(0, np.int64)
        self.full: int | None = None  # the crowded cell at hand
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take up more points; gives those of crowded cells, as far as they are known to be in one."""
        self.cell, self.fp = np.concatenate([self.cell, cell]), np.concatenate([self.fp, fp])
        if not len(self.cell):
            return self.cell, self.fp
        last = int(np.searchsorted(self.cell, self.cell[-1], "left"))
        open_ = len(self.cell) - last
        cut = len(self.cell) if open_ > self.crowd or self.cell[-1] == self.full else last
        return self._settle(cut)

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        return self._settle(len(self.cell))

    def _settle(self, cut: int) -> tuple[np.ndarray, np.ndarray]:
        cell, fp = self.cell[:cut], self.fp[:cut]
        self.cell, self.fp = self.cell[cut:], self.fp[cut:]
        if not cut:
            return cell, fp
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        sizes = np.diff(np.append(starts, cut))
        crowded = np.repeat((sizes > self.crowd) | (cell[starts] == self.full if self.full is not None else False), sizes)
        self.full = int(cell[-1]) if crowded[-1] else None
        at, step = np.flatnonzero(~crowded[:-1]), 1
        while len(at):
            at = at[at + step < cut]
            at = at[cell[at + step] == cell[at]]
            near = at[np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64)) <= self.distance]
            if len(near):
                self.links.append((fp[near], fp[near + step]))
                if sum(len(x) for x, _ in self.links) > self.hold:
                    self.links = [forest(*map(np.concatenate, zip(*self.links, strict=True)))]
            step += 1
        return cell[crowded], fp[crowded]

    def connections(self) -> tuple[np.ndarray, np.ndarray]:
        """What has been linked since the last call."""
        out = forest(*map(np.concatenate, zip(*self.links, strict=True))) if self.links else (np.zeros(0, np.int64),) * 2
        self.links = []
        return out


def settled_cells(placed: DataFrame, distance: int, crowd: int) -> DataFrame:
    """(cell, a, b) of ``placed`` (cell, fp): connections a - b, with a null cell, and the points a of crowded cells, with a null b."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells_ = Cells(distance, crowd)

        def table(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            x, y = cells_.connections()
            nothing = lambda n: pa.nulls(n, pa.int64())
            columns = ([nothing(len(x)), pa.array(cell)], [pa.array(x), pa.array(fp)], [pa.array(y), nothing(len(fp))])
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["cell", "a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= 1 << 16:
                yield table(*cells_.add(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2))))
                held = []
        if held:
            yield table(*cells_.add(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2))))
        yield table(*cells_.end())

    return placed.repartition("cell").sortWithinPartitions("cell").select("cell", "fp").mapInArrow(run, "cell long, a long, b long")


def linked_points(points: DataFrame, distance: int, block: int = 1024, crowd: int = 256) -> DataFrame:
    """(fp, label): for each of ``points`` (fp, distinct) that any other is within ``distance`` bits of, the least point that such links reach."""
    with short_rows(points.sparkSession):
        settled = keep(settled_cells(cells(points, distance), distance, crowd), "settled-cells")
    simple = settled.filter("b IS NOT NULL").select("a", "b").distinct()
    crowded = settled.filter("b IS NULL").select("cell", F.col("a").alias("fp"))
    hubs = crowded.groupBy("cell").agg(F.min("fp").alias("hub"))
    star = crowded.join(hubs, "cell").filter((F.col("fp") != F.col("hub")) & (bits_apart("fp", "hub") <= distance)).select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()
    links = keep(simple.union(star), "links")
    labels = components(links)
    if not crowded.limit(1).count():
        forget(settled, links)
        return labels.withColumnRenamed("node", "fp")
    known = crowded.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    known = keep(known.select("cell", "fp", "label"), "known")
    several = known.groupBy("cell").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1").select("cell")
    more = keep(split_links(known.join(several, "cell"), distance, block).unionByName(links), "links")
    out = components(more)
    forget(settled, links, labels, known, more)
    return out.withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, width: int = 5, distance: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", block: int = 1024) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (the fingerprint as a signed long), component_id and kept (whether that is its own id).

    Two documents are linked where their fingerprints differ in at most ``distance`` bits (5 at most); ``component_id`` is the smallest id that links reach, the row's own
    included.  Null texts, empty ones and those without words have the fingerprint 0 and are linked like any other.  Rows of one id are linked if their texts are.
    Null ids are never a component's id if any other is there.  An empty table gives no rows.  Ids may be of any type with an order; other columns are not read.
    """
    docs = with_id(only(docs, doc_id=id_col, text=text_col))
    rows = keep(fingerprints(docs, width, seed), "fingerprints")
    rep = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    points = keep(rows.groupBy("fp").agg(F.min(rep).alias("rep")), "points")
    labels = linked_points(points.select("fp"), distance, block)
    named = points.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ends = named.groupBy("label").agg(F.min("rep").alias("least"))
    named = keep(named.join(ends, "label").select("fp", F.col("least.doc_id").alias("component_id")), "named")
    forget(points, labels)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def simhash_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id."""
    found = near_duplicates(docs, width, distance)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
