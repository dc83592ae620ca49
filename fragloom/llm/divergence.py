"""How far the sources of a language differ in their words: smoothed shares of terms, their chi-squared distances, and the terms that mark a source.

1. Texts give terms; each task adds up its own occurrences and documents of (language, source, term), so only sums are shuffled.
2. Each kept term is a row whose array has a place for every source of its language, and there the share of the term.
3. Arrow batches of these arrays give a contribution for each pair of sources, summed in each task before the shuffle.
   What the places without an occurrence contribute is a constant of a pair, so contributions are emitted only where one of the two has the term.

All arithmetic is in whole numbers and exact: products of counts are decimals, shares are billionths.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, forget, keep, lean, only, short_rows

#: Shares are given in billionths.
UNIT = 1_000_000_000
#: Fixed by the contract: what isn't part of a term parts terms, only A-Z are put in lower case.
PARTING = bytes.maketrans(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]) + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * 76 + b"abcdefghijklmnopqrstuvwxyz")


def terms_of(text: str) -> list[bytes]:
    """The terms of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(PARTING).split()


def term_counts(docs: DataFrame, most_held: int = 1_000_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and documents that hold it, several rows of a kind; rows with a null term count the group's documents.

    Sums are made in each task, of at most about ``most_held`` different terms of groups at a time and those of one text.
    """
    bound_batches(docs.sparkSession)

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        texts: Counter = Counter()
        held = 0

        def tables() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, seen) in groups.items():
                term = pa.concat_arrays([pa.array(list(n), pa.binary()).cast(pa.string()), pa.nulls(1, pa.string())])
                names = [pa.repeat(pa.scalar(x), len(term)) for x in (lang, source)]
                sums = [pa.array([*n.values(), 0], pa.int64()), pa.array([*map(seen.__getitem__, n), texts[lang, source]], pa.int64())]
                yield pa.RecordBatch.from_arrays([*names, term, *sums], names=["lang", "source", "term", "n", "docs"])
            groups.clear()
            texts.clear()

        for batch in batches:
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n, seen = groups.setdefault((lang, source), (Counter(), Counter()))
                terms, held = terms_of(text), held - len(n)
                n.update(terms)
                seen.update(set(terms))
                texts[lang, source] += 1
                held += len(n)
                if held > most_held:
                    yield from tables()
                    held = 0
        yield from tables()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def share_of(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + kept)), exact for all counts that a long holds."""
    wide = (n.cast("decimal(19,0)") + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return (1 + F.call_function("div", wide, (total + kept).cast("decimal(20,0)"))).cast("bigint")


def distance_of(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), in longs: shares are at most UNIT + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def pair_sums(vectors: DataFrame, most_cells: int = 1 << 20) -> DataFrame:
    """(no, a, b, value, n), several rows of a kind: of the terms ``vectors`` (no, p, holders) that at least one of two sources has, the sum of floor((p_a - p_b)^2 / p_b) and their number.

    A term's row gives twice as many contributions as it has sources times holders; they are array items, of at most about ``most_cells`` at a time, and each task adds up its own.  Shares are 1 at least and add up to
    UNIT and the number of terms at most, so no sum of squares leaves a long.
    """

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def tables() -> Iterator[pa.RecordBatch]:
            for no, (value, n) in sums.items():
                a, b = np.nonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((np.full(len(a), no), pa.int32()), (a, pa.int32()), (b, pa.int32()), (value[a, b], pa.int64()), (n[a, b], pa.int64()))], names=["no", "a", "b", "value", "n"])
            sums.clear()

        for batch in batches:
            order = np.argsort(batch.column("no").to_numpy(), kind="stable")
            rows = batch.take(pa.array(order))
            numbers = rows.column("no").to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])).tolist() if len(numbers) else []
            for begin, end in zip(begins, [*begins[1:], len(numbers)], strict=True):
                own = rows.slice(begin, end - begin)
                p = own.column("p").flatten().to_numpy().reshape(own.num_rows, -1)
                row, holder = np.repeat(np.arange(own.num_rows), own.column("holders").value_lengths().to_numpy()), own.column("holders").flatten().to_numpy()
                has = np.zeros(p.shape, bool)
                has[row, holder] = True
                if int(numbers[begin]) not in sums and sum(v.size for v, _ in sums.values()) > most_cells:
                    yield from tables()
                value, n = sums.setdefault(int(numbers[begin]), (np.zeros((p.shape[1],) * 2, np.int64), np.zeros((p.shape[1],) * 2, np.int64)))
                by_holder = np.argsort(holder, kind="stable")
                step = max(1, most_cells // p.shape[1])
                for at in range(0, len(by_holder), step):
                    part = by_holder[at : at + step]
                    r, h = row[part], holder[part]
                    mine, others, lacks = p[r, h][:, None], p[r], ~has[r]
                    square = (mine - others) ** 2
                    firsts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                    which = h[firsts]
                    value[which] += np.add.reduceat(square // others, firsts)
                    n[which] += np.diff(np.append(firsts, len(h)))[:, None]
                    # A source without the term adds to its pairs with those that have it.
                    value[:, which] += np.add.reduceat(square // mine * lacks, firsts).T
                    n[:, which] += np.add.reduceat(lacks.astype(np.int64), firsts).T
        yield from tables()

    return vectors.mapInArrow(add, "no int, a int, b int, value long, n long")


def wide_terms(counts: DataFrame) -> DataFrame:
    """(lang, term, docs, total, at): a row for each term of a language, with a map from the sources that hold it to their counts; for the null term, to 0.

    One shuffle serves the sums of (lang, source, term) and those of (lang, term).
    """
    parts = counts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    each = counts.repartition(int(parts), "lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("at"))


def source_divergence(docs: DataFrame, least_docs: int = 3, most_terms: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs, terms) of the groups (lang, source) of ``docs``.

    A language keeps the terms that at least ``least_docs`` of its documents hold.  The share of a kept term in a group, or in the language, is that of its count plus one,
    in billionths plus one.  ``pairs``: lang, source, item, value for each other source ``item`` of a language: the sum over kept terms of floor((p - q)^2 / q), p being the group's and q the item's share.
    ``terms``: lang, source, item, value, rank of the ``most_terms`` terms with the largest floor((p - q)^2 / q) that a group has more of than its language; ties in the order of their UTF-8.

    Nulls in any of the columns count as ''; rows equal in all columns are documents each; a group without terms has its pairs; a language of one source has no pairs, one without kept
    terms has pairs of value 0; an empty table gives no rows; other columns are not read.  An array has as many places as a language has sources, and
    both results have at least as many rows for a source.
    """
    docs = only(docs, lang=lang_col, source=source_col, text=text_col)
    every = keep(wide_terms(term_counts(docs)).filter(F.col("term").isNull() | (F.col("docs") >= least_docs)), "terms")
    wide = every.filter(F.col("term").isNotNull())
    groups = every.filter(F.col("term").isNull()).select("lang", F.array_sort(F.map_keys("at")).alias("sources"))

    own = wide.select("lang", F.explode("at").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("n_of"))
    whole = wide.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("n_lang"))
    sums = groups.join(own, "lang", "left").join(whole, "lang", "left")
    ns = F.transform("sources", lambda x: F.coalesce(F.element_at("n_of", x), F.lit(0)))
    number = F.row_number().over(Window.orderBy("lang"))  # a row for each language
    langs = keep(sums.select("lang", number.alias("no"), "sources", ns.alias("ns"), F.coalesce("kept", F.lit(0)).alias("kept"), "n_lang"), "languages")

    # ``rest`` is the share of a term that a source doesn't have (of no account where no term is kept), ``p`` has a place for each source.
    rest = F.transform("ns", lambda n: share_of(F.lit(0), n, F.greatest("kept", F.lit(1))))
    vectors = wide.join(langs.filter("kept > 0").withColumn("rest", rest), "lang").withColumn("cs", F.transform("sources", lambda x: F.element_at("at", x)))
    shares = F.transform("cs", lambda c, k: F.when(c.isNull(), F.get("rest", k)).otherwise(share_of(c, F.get("ns", k), F.col("kept"))))
    holders = F.filter(F.transform("cs", lambda c, k: F.when(c.isNotNull(), k)), lambda k: k.isNotNull())
    vectors = vectors.select("no", "term", shares.alias("p"), holders.alias("holders"), share_of(F.col("total"), F.col("n_lang"), F.col("kept")).alias("q"))

    summed = pair_sums(vectors.select("no", "p", "holders")).groupBy("no", "a", "b").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    # Terms that neither of a pair has all add the same.
    base = langs.select("lang", "no", "sources", "kept", rest.alias("rest"), F.posexplode("sources").alias("a", "source")).select("*", F.posexplode("sources").alias("b", "item")).filter("a <> b")
    constant = (F.col("kept") - F.coalesce("n", F.lit(0))) * distance_of(F.get("rest", F.col("a")), F.get("rest", F.col("b")))
    value = constant + F.coalesce("value", F.lit(0))
    with short_rows(docs.sparkSession):
        pairs = keep(base.join(summed, ["no", "a", "b"], "left").select("lang", "source", "item", value.alias("value")), "pairs")

    marks = vectors.select("no", "q", F.explode("holders").alias("place"), "p", "term").select("no", "place", "term", F.get("p", F.col("place")).alias("p"), "q").filter("p > q")
    best = Window.partitionBy("no", "place").orderBy(F.col("value").desc(), "item")
    ranked = marks.select("no", "place", F.col("term").alias("item"), distance_of(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most_terms)
    terms = keep(ranked.join(langs, "no").select("lang", F.get("sources", F.col("place")).alias("source"), "item", "value", "rank"), "marks")
    forget(every, langs)
    return pairs, terms


def divergence_report(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """Both results of :func:`source_divergence` as one table: lang, source, part, item, value, rank (value descending, then item)."""
    pairs, terms = source_divergence(docs, least_docs, most_terms)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
