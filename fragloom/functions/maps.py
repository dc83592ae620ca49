"""Column functions on fragment arrays and sequences."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def bounds(frags: Column) -> Column:
    """Prefix sums from 0: one more entry than there are fragments; null stays null.

    Arrow batches and numpy, in time linear in the fragments: a fold in SQL copies the sums so far at each step.
    """

    @F.pandas_udf("array<bigint>")
    def sums(column: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in column], dtype=object)

    return sums(frags)


def start_bp(bounds_: Column, index: Column, forward: Column | bool = True) -> Column:
    """Start of a fragment; for the mirrored frame the index counts from the right."""
    n = F.size(bounds_) - 1
    forward = F.lit(forward) if isinstance(forward, bool) else forward
    return F.when(forward, F.get(bounds_, index)).otherwise(F.get(bounds_, n) - F.get(bounds_, n - index))


def end_bp(bounds_: Column, index: Column, forward: Column | bool = True) -> Column:
    n = F.size(bounds_) - 1
    forward = F.lit(forward) if isinstance(forward, bool) else forward
    return F.when(forward, F.get(bounds_, index + 1)).otherwise(F.get(bounds_, n) - F.get(bounds_, n - index - 1))


def circularised(frags: Column) -> Column:
    return F.concat(frags, frags)


def flags(frags: Column) -> Column:
    """True for the first and the last fragment."""
    return F.transform(frags, lambda _, i: (i == 0) | (i == F.size(frags) - 1))


def sites(dna: Column, motif: Column | str, first: int = 0) -> Column:
    """0-based places of ``motif`` in characters, overlapping ones too, on the forward strand, from place ``first``; an empty motif has none, null stays null.

    A substring search in Arrow batches: linear in the sequence for any number of sites.
    """
    motif = F.lit(motif) if isinstance(motif, str) else motif

    @F.arrow_udf("array<bigint>")
    def find(texts: pa.Array, motifs: pa.Array) -> pa.Array:
        # One text at a time becomes a string; places stay numbers.
        out, ends = array("q"), [0]
        for text, word in zip(texts, motifs, strict=True):
            text, word = text.as_py(), word.as_py()
            if text is not None and word:
                at = text.find(word, first)
                while at >= 0:
                    out.append(at)
                    at = text.find(word, at + 1)
            ends.append(len(out))
        missing = np.array(texts.is_null()) | np.array(motifs.is_null())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(out, np.int64)), mask=pa.array(missing))

    return find(dna, motif)


def fragments(sites_: Column, length: Column) -> Column:
    """Distances between neighbouring sites and the two ends; no sites, no fragments."""
    ends = F.concat(sites_, F.array(length.cast("bigint")))
    starts = F.concat(F.array(F.lit(0).cast("bigint")), sites_)
    cut = F.zip_with(ends, starts, lambda a, b: a - b)  # each side is made once, not once for each site
    return F.when(F.size(sites_) > 0, cut).otherwise(F.array().cast("array<bigint>"))


def digested(dna: Column, motif: str) -> Column:
    """:func:`fragments` of :func:`sites`, without the sites: the lengths of the parts before, between and from the places of ``motif``, overlapping ones too.

    One split before each place, inside the JVM; a place at the very start has an empty part before it, which the split leaves out.
    """
    if not motif:
        return F.when(dna.isNotNull(), F.array().cast("array<bigint>"))
    sizes = F.transform(F.split(dna, f"(?={re.escape(motif)})"), lambda x: F.length(x).cast("bigint"))
    sizes = F.when(F.startswith(dna, F.lit(motif)), F.concat(F.array(F.lit(0).cast("bigint")), sizes)).otherwise(sizes)
    return F.when(F.size(sizes) > 1, sizes).when(dna.isNotNull(), F.array().cast("array<bigint>"))


def replaced(values: Column, positions: Column, replacements: Column) -> Column:
    """``values`` with the k-th of ``replacements`` at the k-th of ``positions``; a later one wins, places outside are ignored."""
    pairs = F.reverse(F.arrays_zip(positions.alias("p"), replacements.alias("r")))
    return F.transform(values, lambda x, i: F.coalesce(F.get(F.filter(pairs, lambda q: q["p"] == i), F.lit(0))["r"], x))


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def size_sd(c: Column) -> Column:
    """Standard deviation that belongs to a fragment of ``c`` kb."""
    return F.lit(0.3) * F.sqrt(F.lit(1000.0)) * F.sqrt(c)


def kb_to_bp(kb: Column, rounded: bool) -> Column:
    """Rounded half up, or truncated, by the convention of the format."""
    return (F.floor(1000 * kb + 0.5) if rounded else F.when(kb < 0, F.ceil(1000 * kb)).otherwise(F.floor(1000 * kb))).cast("int")


def clean_id(map_id: Column) -> Column:
    return F.regexp_replace(map_id, r"\s", "")
