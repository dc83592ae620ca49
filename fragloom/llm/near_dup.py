"""Near-duplicate documents by a multi-index Hamming join over b-bit min-hash signatures, confirmed on full shingle sets.

1. Every whole text gives its shingle set's size, a 128-bit hash of the set, and its signature's keys and sketch.  Rows with
   equal sets are one class; from here on only one row of a class counts, so groups of exact copies cost nothing.
2. Classes that share a key meet.  No pairs are made: each key names its least class, and a class joins the least class that
   any of its keys names (its cluster).
3. Each class is held against its cluster's representative, and those not linked with it against a few classes that are; so a family of near
   copies becomes one component by comparisons in proportion to its size.
4. What is still apart is compared with all of its cluster, sketches and parity bitmaps first, in blocks of bounded size; only classes with a possible partner
   go on, and only their texts are read again.  Blocks then confirm links on full sets, and give a spanning forest of them instead of all pairs.
5. Classes that share a key but neither a cluster nor, so far, a component are compared one by one.
6. Components follow from the links.

The blocks are what bounds a task: a large cluster is dealt out as pairs of blocks.  Joins by key or cluster have one hot side at most and are followed by
another distribution or a write, so that a hot key's rows can be split among tasks at run time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, forget, id_type, keep, lean, masked, only, with_id
from .components import components
from .shingles import Signatures, distances, linked, parity, shingle_set

ROWS = "doc_id {}, text_hash long, n_shingles long, h1 long, h2 long, s1 long, s2 long, bits array<long>, keys array<long>"
SIGNED = np.dtype("<i8")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def signed_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, the set's hash, sketch and keys (null without words)."""
    bound_batches(docs.sparkSession)

    @lean
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures(percent)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, width)
                if len(s):
                    h = xxhash.xxh3_128_intdigest(s.tobytes())
                    keys, s1, s2 = signatures.of(s)
                    row = (len(s), _signed(h >> 64), _signed(h & (1 << 64) - 1), s1, s2, parity(s), keys)
                else:
                    row = (0, None, None, None, None, None, None)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, pa.int64()) for c in out[:5]], *[pa.array(c, pa.list_(pa.int64())) for c in out[5:]]], names=["doc_id", "text_hash", "n_shingles", "h1", "h2", "s1", "s2", "bits", "keys"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(sign, ROWS.format(id_type(docs, "doc_id").simpleString()))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) for each run of rows that are equal in their first ``keys`` columns."""
    last, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != last:
                if rows:
                    yield last, rows
                last, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield last, rows


def blocks_of(members: DataFrame, block: int) -> DataFrame:
    """``members`` (cluster, cid, apart and other columns) as rows of pairs of blocks (i, j): about ``block`` classes that are apart, and as many of all.

    ``side`` is 0 for the first and 1 for the others.  Rows are copied once for each block of the other side, never for each row; a cluster
    without classes apart gives none.
    """
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"), F.count_if("apart").alias("n_apart")).filter((F.col("size") > 1) & (F.col("n_apart") > 0))
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    rows = members.join(sizes, "cluster").withColumns({"n_i": blocks("n_apart"), "n_j": blocks("size")})
    own = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    first = F.transform(every("n_j"), lambda j: F.struct(F.lit(0).alias("side"), own("n_i").alias("i"), j.alias("j")))
    second = F.transform(every("n_i"), lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), own("n_j").alias("j")))
    places = F.when(F.col("apart"), F.concat(first, second)).otherwise(second)
    return rows.withColumn("p", F.explode(places)).select(*members.columns, "p.side", "p.i", "p.j")


def _close(rows: list[tuple], far: int, percent: int, side: int = 64, slice_: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Places of pairs of unlike sides whose sizes, sketches and parity bitmaps allow a link.  rows: (side, cid, n, s1, s2, bits, ...)."""
    own = np.array([r[0] for r in rows])
    if own.min() == own.max():
        return
    cid = np.array([r[1] for r in rows])
    n = np.array([r[2] for r in rows], dtype=np.int64)
    s1 = np.array([r[3] for r in rows], dtype=SIGNED).view(np.uint64)
    s2 = np.array([r[4] for r in rows], dtype=SIGNED).view(np.uint64)
    order = np.argsort(n, kind="stable")
    own, cid, n, s1, s2 = own[order], cid[order], n[order], s1[order], s2[order]
    bits = np.array([rows[k][5] for k in order.tolist()], dtype=SIGNED).view(np.uint64)
    first, second = np.flatnonzero(own == 0), np.flatnonzero(own == 1)
    n2 = n[second]
    for a in range(0, len(first), side):
        x = first[a : a + side]
        # Sizes are in order, so partners of these rows lie between those too small for the first and too large for the last of them.
        begin = int(np.searchsorted(n2, -(-n[x[0]] * percent // 100), side="left"))
        end = int(np.searchsorted(n2, n[x[-1]] * 100 // percent, side="right"))
        for b in range(begin, end, 4096):
            y = second[b : min(b + 4096, end)]
            near = distances(s1[x], s2[x], s1[y], s2[y]) <= far
            near &= 100 * np.minimum(n[x, None], n[None, y]) >= percent * np.maximum(n[x, None], n[None, y])
            p, q = np.nonzero(near)
            p, q = x[p], y[q]
            good = cid[p] != cid[q]
            p, q = p[good], q[good]
            for k in range(0, len(p), slice_):  # bounded memory, however many sketches are close
                u, v = p[k : k + slice_], q[k : k + slice_]
                apart = np.bitwise_count(bits[u] ^ bits[v]).sum(axis=1, dtype=np.int64)
                may = (100 + percent) * apart <= (100 - percent) * (n[u] + n[v])
                yield from zip(order[u[may]].tolist(), order[v[may]].tolist(), strict=True)


def close_members(blocks: DataFrame, far: int, percent: int) -> DataFrame:
    """(cluster, cid) of members that have a partner with a close sketch and size in their cluster."""

    @lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters, cids = [], []
        for (cluster, _, _), rows in _runs(batches, 3):
            got = {rows[k][1] for pair in _close(rows, far, percent) for k in pair}
            clusters += [cluster] * len(got)
            cids += list(got)
            if len(cids) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(clusters, pa.int64()), pa.array(cids, pa.int64())], names=["cluster", "cid"])
                clusters, cids = [], []
        yield pa.RecordBatch.from_arrays([pa.array(clusters, pa.int64()), pa.array(cids, pa.int64())], names=["cluster", "cid"])

    rows = blocks.select("cluster", "i", "j", "side", "cid", "n", "s1", "s2", "bits")
    return rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(find, "cluster long, cid long").distinct()


class Forest:
    """Components within a block."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def block_links(blocks: DataFrame, far: int, percent: int, width: int) -> DataFrame:
    """(a, b): links confirmed on full sets, as a spanning forest of each pair of blocks."""

    @lean
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, rows in _runs(batches, 3):
            sets: dict[int, np.ndarray] = {}
            forest = Forest()

            def of(k: int) -> np.ndarray:
                if rows[k][1] not in sets:
                    sets[rows[k][1]] = shingle_set(rows[k][6], width)
                return sets[rows[k][1]]

            for x, y in _close(rows, far, percent):
                p, q = rows[x][1], rows[y][1]
                if forest.root(p) != forest.root(q) and linked(of(x), of(y), percent):
                    forest.join(p, q)
                    a.append(p)
                    b.append(q)
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = blocks.select("cluster", "i", "j", "side", "cid", "n", "s1", "s2", "bits", "text")
    return rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(confirm, "a long, b long")


def pair_links(pairs: DataFrame, texts: DataFrame, percent: int, width: int, salt: int = 500) -> DataFrame:
    """Those of ``pairs`` (a, b) that are links.  Pairs are grouped by ``a``, whose set is made once for each ``salt`` of them."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / salt).cast("int").alias("parts"))
    salted = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    firsts = salted.select("a", "part").distinct().join(texts.select(F.col("cid").alias("a"), "text"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    others = salted.join(texts.select(F.col("cid").alias("b"), "text"), "b").select("a", "part", "b", "text")

    @lean
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: np.ndarray = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for x, y, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if y is None:
                    first = shingle_set(text, width)
                elif linked(first, shingle_set(text, width), percent):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = firsts.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(confirm, "a long, b long")


def texts_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, broadcast_rows: int = 300_000) -> DataFrame:
    """(cid, text) of the classes in ``wanted`` (cid, distinct), one row for each.

    The key that finds a class's row (24 bytes) is broadcast up to ``broadcast_rows`` of them, counted first; beyond, texts are shuffled.
    """
    keys = keep(classes.join(wanted, "cid").select("cid", F.col("rep.doc_id").alias("k1"), F.col("rep.text_hash").alias("k2")), "wanted")
    keys = F.broadcast(keys) if keys.count() <= broadcast_rows else keys
    source = docs.select("doc_id", "text")
    found = source.join(keys, source["doc_id"].eqNullSafe(F.col("k1")) & (F.xxhash64("text") == F.col("k2")))
    return keep(found.groupBy("cid").agg(F.first("text").alias("text")), "texts")


#: Classes of a cluster that others are held against, besides its representative.
PIVOTS = 8


def _may_link(far: int, percent: int) -> Column:
    """Whether the sizes, sketches and bitmaps of (x_n, x_s1, ...) and (n, s1, ...) allow a link."""
    distance = sum(_symbols_apart(F.col(f"x_{c}"), F.col(c)) for c in ("s1", "s2"))
    differ = sum(F.bit_count(F.get("x_bits", F.lit(i)).bitwiseXOR(F.get("bits", F.lit(i)))) for i in range(8))
    sizes = 100 * F.least("x_n", "n") >= percent * F.greatest("x_n", "n")
    return sizes & (distance <= far) & ((100 + percent) * differ <= (100 - percent) * (F.col("x_n") + F.col("n")))


def _allowed(rows: DataFrame, sketches: DataFrame, far: int, percent: int) -> DataFrame:
    """(a, b) of rows' pivot and class, where a link is allowed.  A pivot's sketch is found once, however many rows name it."""
    names = {c: f"x_{c}" for c in ("n", "s1", "s2", "bits")}
    wanted = sketches.join(rows.select(F.col("pivot").alias("cid")).distinct(), "cid").select(F.col("cid").alias("pivot"), *[F.col(c).alias(x) for c, x in names.items()])
    return rows.join(wanted, "pivot").filter(_may_link(far, percent)).select(F.col("pivot").alias("a"), F.col("cid").alias("b"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = 512) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles, component_id, kept and best.

    Two documents are linked where 100 times the size of their sets' intersection is at least ``percent`` times that of the union.
    ``component_id`` is the smallest id that links reach, the row's own included; ``kept`` says that it is the row's own.  ``best`` is
    true for rows of one (id, text) of each component, so it also decides where ids repeat or are null.  Null
    texts and texts without words have an empty set, are linked with nothing and are all kept and best.  Null ids are never a
    component's id if any other is there; a component of null ids only has a null id, and its rows are kept.  Repeated rows are a component.
    An empty table gives no rows.  Ids may be of any type with an order; other columns are not read.
    """
    docs = with_id(only(docs, doc_id=id_col, text=text_col))
    signatures = Signatures(percent)
    far = signatures.far
    rows = keep(signed_rows(docs, width, percent), "signed")
    full = rows.filter(F.col("n_shingles") > 0)
    rep = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    grouped = full.groupBy("h1", "h2").agg(F.min(rep).alias("rep"), F.first("n_shingles").alias("n"), F.first(F.struct("s1", "s2", "bits", "keys")).alias("sig"))
    # Class numbers ascend with ids, so that a key's least class is its earliest document.
    classes = keep(grouped.repartitionByRange("rep").sortWithinPartitions("rep").select(F.monotonically_increasing_id().alias("cid"), "h1", "h2", "rep", "n", "sig.*"), "classes")

    keyed = classes.select("cid", F.explode(F.array_distinct("keys")).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("cid").alias("least"), F.max("cid").alias("most")).filter(F.col("least") < F.col("most")).select("key", "least")
    met = keep(keyed.join(shared, "key"), "met")
    clusters = keep(met.groupBy("cid").agg(F.min("least").alias("cluster")), "clusters")
    sketches = classes.select("cid", "n", "s1", "s2", "bits")
    members = keep(clusters.join(sketches, "cid"), "members")

    # Links with the representative, then of what is left with a few classes that have one.
    star = keep(_allowed(members.filter(F.col("cid") != F.col("cluster")).withColumnRenamed("cluster", "pivot"), sketches, far, percent), "star")
    star_texts = texts_of(docs, classes, _ends(star))
    star_links = keep(pair_links(star, star_texts, percent, width), "star-links")
    with_hub = star_links.select(F.col("b").alias("cid")).distinct()
    left = members.filter(F.col("cid") != F.col("cluster")).join(with_hub, "cid", "left_anti")
    pivots = members.join(with_hub, "cid", "left_semi").groupBy("cluster", F.pmod(F.xxhash64("cid"), F.lit(PIVOTS))).agg(F.min("cid").alias("pivot")).select("cluster", "pivot")
    tried = keep(_allowed(left.join(pivots, "cluster"), sketches, far, percent), "tried")
    tried_texts = texts_of(docs, classes, _ends(tried))
    tried_links = keep(pair_links(tried, tried_texts, percent, width), "tried-links")
    joined = with_hub.union(tried_links.select(F.col("b").alias("cid"))).distinct().withColumn("joined", F.lit(True))
    apart = F.col("joined").isNull() & (F.col("cid") != F.col("cluster"))
    members_ = keep(members.join(joined, "cid", "left").withColumn("apart", apart).drop("joined"), "apart")

    close = keep(close_members(blocks_of(members_, block), far, percent), "close")
    texts = texts_of(docs, classes, close.select("cid").distinct())
    confirmed = close.join(members_, ["cid", "cluster"]).join(texts, "cid")
    links = keep(block_links(blocks_of(confirmed, block), far, percent, width).unionByName(star_links).unionByName(tried_links), "links")

    # What shares a key, but neither a cluster nor a component yet.
    labels = components(links)
    known = clusters.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "cluster", F.coalesce("label", "cid").alias("label"))
    placed = met.select("key", "cid").join(known, "cid")
    mixed = placed.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("cluster").alias("c0"), F.max("cluster").alias("c1"))
    mixed = mixed.filter((F.col("l0") < F.col("l1")) & (F.col("c0") < F.col("c1"))).select("key")
    placed = keep(placed.join(mixed, "key").join(sketches, "cid"), "mixed")
    votes = placed.groupBy("key", "cluster").agg(F.count("*").alias("votes")).groupBy("key").agg(F.max(F.struct("votes", "cluster"))["cluster"].alias("main"))
    sided = keep(placed.join(votes, "key"), "sided")
    few = sided.filter(F.col("cluster") != F.col("main")).select("key", *[F.col(c).alias(f"x_{c}") for c in ("cid", "cluster", "label", "n", "s1", "s2", "bits")])
    may = (
        (F.col("x_cluster") != F.col("cluster"))
        & (F.col("x_label") != F.col("label"))
        & ((F.col("cluster") == F.col("main")) | (F.col("x_cid") < F.col("cid")))
        & _may_link(far, percent)
    )
    pairs = few.join(sided.withColumnRenamed("key", "key_"), (F.col("key") == F.col("key_")) & may)
    pairs = keep(pairs.select(F.least("x_cid", "cid").alias("a"), F.greatest("x_cid", "cid").alias("b")).distinct(), "pairs")
    more = texts_of(docs, classes, _ends(pairs))
    links = keep(links.unionByName(pair_links(pairs, more, percent, width)), "links")
    labels = components(links)

    named = classes.select("cid", "h1", "h2", "rep").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    ends = named.groupBy("label").agg(F.min("rep").alias("best_rep"))
    named = keep(named.join(ends, "label").select("h1", "h2", "best_rep"), "named")
    forget(met, clusters, members, members_, star, star_texts, star_links, tried, tried_texts, tried_links, close, texts, placed, sided, pairs, more, links, labels)
    placed_rows = rows.select("doc_id", "text_hash", "n_shingles", F.col("h1").alias("r1"), F.col("h2").alias("r2"))
    out = placed_rows.join(named, (F.col("r1") == F.col("h1")) & (F.col("r2") == F.col("h2")), "left")
    alone = F.col("best_rep").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("best_rep.doc_id"))
    best = alone | (F.col("doc_id").eqNullSafe(F.col("best_rep.doc_id")) & F.col("text_hash").eqNullSafe(F.col("best_rep.text_hash")))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), best.alias("best"))


def _symbols_apart(x, y):
    """Two-bit symbols in which two 64-bit sketches differ."""
    d = x.bitwiseXOR(y)
    return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs``, all columns and in their order, with one document of each component; rows equal in id and text count as one document.

    Texts that are null or without words all stay; an empty table gives no rows; names of other columns cannot clash.
    Rejects (id and hash of the text) are broadcast up to ``broadcast_rows`` of them, counted first, and shuffled beyond.
    """
    found = keep(near_duplicates(docs, width, percent, id_col, text_col), "near-duplicates")
    bad = keep(found.filter(~F.col("best")).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "rejects")
    held = F.broadcast(bad) if bad.count() <= broadcast_rows else bad
    rows, own_id, own_text = masked(docs), *(f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    key = rows[own_id].cast(id_type(docs, id_col))
    same = lambda i, h: key.eqNullSafe(F.col(i)) & F.xxhash64(rows[own_text]).eqNullSafe(F.col(h))
    left = rows.join(held, same("bad_id", "bad_hash"), "left_anti")
    repeated = found.filter((F.col("n_shingles") > 0) & F.col("best")).groupBy(F.col("doc_id").alias("twice_id"), F.col("text_hash").alias("twice_hash")).count().filter("count > 1").drop("count")
    repeated = keep(repeated, "repeated")
    if repeated.limit(1).count():
        again = same("twice_id", "twice_hash")
        left = left.join(repeated, again, "left_anti").unionByName(left.join(repeated, again, "left_semi").dropDuplicates([own_id, own_text]))
    return left.toDF(*docs.columns)
