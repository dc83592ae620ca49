"""Fill-in-the-middle examples from documents, by Spark's own functions alone: no Python worker, no shuffle, one pass over the texts.

A text is cut into units, a word with the white space before it each (or the white space at its end).  Digits of a hash of the
document's id choose two cuts between units and the form of the example, so a run repeats on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import masked, only, with_id

#: Fixed by the contract: units, sentinels.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers from 0 to 2**32 - 1: the first groups of eight hex digits of the sha256 of ``seed:id``; a null id is the text ''."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an example was made of, from the example and its form alone.

    What stands between sentinels holds none, and no end of one followed by a sentinel makes another one earlier, so the first of each kind is the one that was put there.
    """
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    first = F.split(body, F.when(form == "psm", SUFFIX).otherwise(PREFIX), 2)
    second = F.split(F.get(first, F.lit(1)), F.lit(MIDDLE), 2)
    one, two, middle = F.get(first, F.lit(0)), F.get(second, F.lit(0)), F.get(second, F.lit(1))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def _arranged(rows: DataFrame, id_col: str, text_col: str, share: int, spm: int, seed: int) -> DataFrame:
    """``rows`` (columns c0, c1, ...) with n, form, prefix, middle and output of the text, null as '', of each."""
    own = rows.columns
    text = F.coalesce(text_col, F.lit(""))
    units = rows.select(*own, text.alias("text"), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("units"), *[h.alias(f"h{k + 1}") for k, h in enumerate(draws(F.col(id_col), seed))])
    places = F.size("units") + 1
    sentinel = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | sentinel | (F.col("h3") % 100 >= share), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    one, two = ((F.col(h) % places).cast("int") for h in ("h1", "h2"))
    formed = units.select(*own, "text", "units", F.size("units").cast("bigint").alias("n"), form.alias("form"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))

    def part(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))

    a, b = F.col("a"), F.col("b")
    cut = formed.select(*own, "text", "n", "form", part(F.lit(1), a).alias("prefix"), part(a + 1, b - a).alias("middle"), part(b + 1, F.size("units") - b).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    suffix_first = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(suffix_first)
    return cut.select(*own, "n", "form", "prefix", "middle", output.alias("output"))


def fill_in_middle(docs: DataFrame, share: int = 50, spm: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n (units), form, prefix_chars, middle_chars and output.

    ``share`` of a hundred texts are rearranged, ``spm`` of a hundred of those with the suffix first.  The prefix ends behind the first, the middle behind the
    second of two cuts drawn from all places between units, the ends included.  The form is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain``: the text as it
    is, for all others, for empty and null texts (both give '', with no units) and for texts that hold a sentinel; lengths are code points, and null where plain.

    Rows of one id and text give one example each; a null id draws as the text ''; an empty table gives no rows; other columns are not read.  Memory
    is that of a text and its units.
    """
    rows = with_id(only(docs, doc_id=id_col, text=text_col)).select(F.col("doc_id").alias("c0"), F.col("text").alias("c1"))
    chars = lambda c: F.length(c).cast("bigint").alias(f"{c}_chars")
    return _arranged(rows, "c0", "c1", share, spm, seed).select(F.col("c0").alias("doc_id"), "n", "form", chars("prefix"), chars("middle"), "output")


def rearranged(docs: DataFrame, share: int = 50, spm: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns and rows in their order, with each text replaced by its example; null texts stay null, other columns stay as they are, whatever their names."""
    own_id, own_text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    rows = masked(docs)
    made = _arranged(rows, own_id, own_text, share, spm, seed)
    text = F.when(F.col(own_text).isNotNull(), F.col("output")).alias(own_text)
    return made.select(*[text if c == own_text else c for c in rows.columns]).toDF(*docs.columns)


def digests(docs: DataFrame) -> DataFrame:
    """:func:`fill_in_middle` with the sha256 of each example and of the text restored from it, instead of the example."""
    made = fill_in_middle(docs)
    both = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", restored(F.col("output"), F.col("form")).alias("restored"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))
