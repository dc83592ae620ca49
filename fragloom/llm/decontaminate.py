"""Benchmark decontamination with DataFrame functions only.

Items give windows of ``window`` consecutive words (a shorter item is one window).  The distinct windows are a broadcast
hash set of 64-bit hashes while their bytes, computed first, are under a bound, and a shuffled table beyond it.  Each word
position of a document gives the hash of the window of each length that starts there; hash hits are verified by the words themselves.  All of
this is one scan, whatever the lengths: splitting, exploding, hashing and probing stay in generated code, and only a row for each
document and for each verified hit is written.  Which items have a window is a table of its own that only hits are joined with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, masked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed by the contract: whatever is between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """``text`` with A-Z, and only these, in lower case."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), BETWEEN), "")


def windows_of(items: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(w_id, w_n, w_text) of the distinct windows (words joined by spaces), and (w_id, item_id) of the items that have them.

    ``w_id`` is a 128-bit hash of the window in two longs.
    """
    rows = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - n + 1)
    each = rows.select("item_id", n.alias("w_n"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, n), " "))).alias("w_text"))
    id_ = F.struct(F.xxhash64("w_text").alias("a"), F.xxhash64(F.lit("b"), "w_text").alias("b"))
    each = keep(each.select(id_.alias("w_id"), "w_n", "w_text", "item_id").distinct(), "windows")
    distinct = each.select("w_id", "w_n", "w_text").distinct()
    return distinct, each.filter(F.col("item_id").isNotNull()).select("w_id", "item_id").distinct()


def hits(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_mb: int = 64,
    row_col: str | None = None,
) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_words, hit_words (sorted positions of hit words) and hit_items (sorted).

    A null or empty text has no words and no hits; so has every document if ``items`` is empty or has no words.  Rows with equal or
    null ids are judged each for themselves, ids may be of any type.  Null item ids match nothing that could be named, so they add hits but no item.
    Repeated items and windows count once.  Other columns are not read.  ``row_col`` names a column that numbers the rows, which is then given as ``row``.
    """
    table, of_items = windows_of(items, window, item_col, item_text_col)
    facts = table.groupBy("w_n").agg(F.count("*").alias("n"), F.sum(F.octet_length("w_text")).alias("bytes")).collect()  # `window` rows at most
    lengths = sorted((r.w_n for r in facts), reverse=True)
    small = sum(r.bytes + 64 * r.n for r in facts) <= broadcast_mb << 20
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    text = F.col(text_col)
    rows = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("words"))
    rows = rows.withColumn("n_words", F.coalesce(F.size("words"), F.lit(0)))
    each = rows.select("row", "doc_id", "text_hash", "n_words", "words", F.posexplode_outer("words").alias("at", "word")).drop("word")

    def hash_at(words: Column, at: Column, n: int) -> Column:
        return F.xxhash64(F.lit(n), *[F.get(words, at + i) for i in range(n)])

    probe = lambda n: F.when(F.col("at") + n <= F.col("n_words"), hash_at(F.col("words"), F.col("at"), n))
    if len(lengths) > 1:  # a row for each length at each place; the first stays where nothing fits
        probes = [F.struct(F.lit(n).alias("n"), probe(n).alias("hash"), F.lit(k == 0).alias("first")) for k, n in enumerate(lengths)]
        probed = each.withColumn("p", F.explode(F.array(*probes))).select(*each.columns, F.col("p.n").alias("n"), F.col("p.hash").alias("hash"), "p.first")
        shown = F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ")
    else:
        n = lengths[0] if lengths else window
        probed = each.withColumns({"n": F.lit(n), "hash": probe(n), "first": F.lit(True)})
        shown = F.concat_ws(" ", *[F.get("words", F.col("at") + i) for i in range(n)])
    parts = F.split("w_text", " ")
    w_hash = F.coalesce(*[F.when(F.col("w_n") == n, hash_at(parts, F.lit(0), n)) for n in lengths], F.lit(None).cast("long"))
    set_ = table.select("w_id", "w_text", w_hash.alias("w_hash"))
    if small:
        set_ = F.broadcast(set_)
    else:  # rows are shuffled, so they take their own window along instead of all words
        probed = probed.withColumn("shown", F.when(F.col("hash").isNotNull(), shown)).drop("words")
        shown = F.col("shown")
    probed = probed.join(set_, (F.col("hash") == F.col("w_hash")) & (shown == F.col("w_text")), "left")
    leads = F.col("first") & (F.coalesce(F.col("at"), F.lit(0)) == 0)
    found = probed.filter(F.col("w_hash").isNotNull() | leads).select("row", "doc_id", "text_hash", "n_words", leads.alias("leads"), F.when(F.col("w_hash").isNotNull(), F.col("at")).alias("at"), "n", "w_id")
    found = keep(found, "hits")  # rows keep their numbers from here on
    key = ["row", "doc_id", "text_hash"]
    some = found.filter(F.col("at").isNotNull())
    covered = F.flatten(F.transform(F.collect_set(F.struct("at", "n")), lambda h: F.sequence(h["at"], h["at"] + h["n"] - 1)))
    places = some.groupBy("row").agg(F.array_sort(F.array_distinct(covered)).alias("hit_words"))
    named = some.select("row", "w_id").distinct().join(of_items, "w_id").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("hit_items"))
    out = found.filter("leads").select(*key, "n_words").join(places, "row", "left").join(named, "row", "left")
    none = F.array().cast("array<int>")
    kind = items.schema[item_col].dataType.simpleString()
    return out.select(
        *["row"] * bool(row_col), "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), F.coalesce("hit_words", none).alias("hit_words"),
        F.coalesce("hit_items", F.array().cast(f"array<{kind}>")).alias("hit_items"),
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, **names: str) -> DataFrame:
    """Digest of :func:`hits`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, items, window, **names)
    names_ = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    n_hit = F.size("hit_words").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(names_.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs``, all columns and in their order, without the documents that have a hit word.

    Null and empty texts stay; of repeated rows all go or all stay; an empty table gives no rows, empty ``items`` take none away; names of other columns cannot clash.
    The rejects (id and hash of the text) are counted, then broadcast up to ``broadcast_rows`` and shuffled beyond.
    """
    bad = hits(docs, items, window, id_col, text_col).filter(F.size("hit_words") > 0)
    bad = keep(bad.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= broadcast_rows else bad
    rows, at = masked(docs), docs.columns.index
    same = F.col(f"c{at(id_col)}").eqNullSafe(F.col("bad_id")) & (F.xxhash64(f"c{at(text_col)}") == F.col("bad_hash"))
    return rows.join(bad, same, "left_anti").toDF(*docs.columns)


def drop_spans(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with hit words, and what stands between them and the word before, taken out of the text.

    The rows are written to the shared folder with a row number first, so that numbers hold for both reads.  A document
    without hits keeps its text byte for byte, a null text stays null; all other columns stay as they are, whatever their names; repeated rows are each
    cleaned; an empty table gives no rows.
    """
    numbered = keep(masked(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")
    own_id, own_text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    bad = hits(numbered, items, window, own_id, own_text, row_col="row").filter(F.size("hit_words") > 0).select("row", "hit_words")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # A-Z still in upper case here
    pieces = F.regexp_extract_all(own_text, F.lit(r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*" + word + ")"), F.lit(1))
    tail = F.regexp_extract(own_text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)
    of_bad = numbered.select("row", own_text).join(bad, "row").select("row", "hit_words", pieces.alias("pieces"), tail.alias("tail"))
    of_bad = keep(of_bad, "pieces")  # so that each text is cut once, not once for each word
    stay = F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), "hit_words")
    cleaned = of_bad.select("row", F.concat(F.array_join(F.transform(stay, lambda i: F.get("pieces", i)), ""), "tail").alias("cleaned"))
    return numbered.join(cleaned, "row", "left").withColumn(own_text, F.coalesce("cleaned", own_text)).drop("row", "cleaned").toDF(*docs.columns)
