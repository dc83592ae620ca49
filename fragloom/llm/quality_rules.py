"""Line-first cleaning: rules for single lines, then a verdict on what is left of the document."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, id_type, lean, only, with_id

SPACE = b" \t\n\x0b\x0c\r"
UPPERS = bytes(range(0x41, 0x5B))
WIDE = bytes(range(0x80, 0x100))
CONTINUED = bytes(range(0x80, 0xC0))
#: Fixed by the contract.
SYMBOLS = b"#*$%&|<>"
ENDS = (b".", b"!", b"?", b":", b";", b",", b'"', b"'", b")", "…".encode(), "”".encode(), "»".encode())
BOILERPLATE = re.compile(rb"(?i)\b(?:cookie policy|use cookies|terms of (?:use|service)|privacy policy|all rights reserved|click here|read more|sign (?:in|up)|log ?in|subscribe|enable javascript|share this|skip to content|lorem ipsum)\b")


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows that stand twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.array(list(map(number.__getitem__, words)), dtype=np.int64)
    key, most = ids[:n].copy(), len(number)
    size = most
    for k in range(1, window):
        if size > (1 << 62) // most:
            key = np.unique(key, return_inverse=True)[1]
            size = int(key.max()) + 1
        key = key * most + ids[k : k + n]
        size *= most
    _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def capitals(line: bytes) -> bool:
    """Whether more than half of a line's characters are upper case."""
    upper = len(line) - len(line.translate(None, UPPERS))
    if line.isascii():
        return upper * 2 > len(line)
    text = line.decode("utf-8", "surrogatepass")
    # Others are looked at one by one only if they could make the difference.
    others = len(text) - len(line.translate(None, WIDE))
    return (upper + others) * 2 > len(text) and sum(map(str.isupper, text)) * 2 > len(text)


def line_fault(line: bytes, words: list[bytes]) -> str | None:
    """The rule that a line with words breaks, or None."""
    size = len(line) if line.isascii() else len(line.translate(None, CONTINUED))  # characters
    n = len(words)
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if line.count(b"|") >= 3 or line.count(b">") >= 3 or line.count(" » ".encode()) >= 2:
        return "navigation"
    if symbols * 10 > size:
        return "symbols"
    if line.count(b"!!") >= 3 or line.count(b"??") >= 3:
        return "punctuation"
    if n >= 8 and len(set(words)) * 4 < n:
        return "repetition"
    if size >= 20 and capitals(line):
        return "capitals"
    if n <= 20 and BOILERPLATE.search(line):
        return "boilerplate"
    if n < 4 and not line.rstrip(SPACE).endswith(ENDS):
        return "fragment"
    return None


def judge(text: str | None, most_lost: float = 0.5) -> dict:
    """Counts, verdicts and the cleaned text.

    Lines without a word are kept as they are.  A line equal to an earlier one is removed as a repetition.  The document is rejected if it
    has no words left, or if more than ``most_lost`` of its words stood in lines that were removed.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    seen: set[bytes] = set()
    n_dup, lost, left = 0, 0, []
    faults: list[str] = []
    for line in data.split(b"\n"):
        own = line.split()
        if not own:
            left.append(line)
            continue
        if line in seen:
            n_dup += 1
            fault = "repetition"
        else:
            seen.add(line)
            fault = line_fault(line, own)
        if fault:
            lost += len(own)
            faults.append(fault)
        else:
            left.append(line)
    repeat = repeated_words(words)
    spaces = len(data) - len(data.translate(None, SPACE))
    base_failed = n < 10 or 100 * repeat > 20 * n
    return {
        "n_words": n, "word_chars": len(text or "") - spaces, "n_symbols": len(data) - len(data.translate(None, SYMBOLS)), "n_dup_lines": n_dup, "n_repeat_words": repeat,
        "base_failed": base_failed, "kept": not base_failed and lost < n and lost <= most_lost * n, "lost_words": lost, "faults": faults, "cleaned": b"\n".join(left).decode("utf-8", "surrogatepass"),
    }


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: float = 0.5, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_words and, if asked for, cleaned.

    A null or empty text has no words, so it fails the base rules; a null's cleaned text is empty.  Rows with equal or null ids are judged each for themselves; an
    empty table gives no rows.  Other columns are not read.  No shuffle; memory is that of a batch of texts.
    """
    bound_batches(docs.sparkSession)
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.int64()] + [pa.string()] * with_text
    names = [*NAMES, *["cleaned"] * with_text]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [judge(t, most_lost) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[c] for x in got], k) for c, k in zip(names, kinds, strict=True)]], names=["doc_id", *names])

    rows = only(docs, doc_id=id_col, text=text_col)
    kind = id_type(rows, "doc_id").simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_words long" + ", cleaned string" * with_text
    return with_id(rows).select("doc_id", "text").mapInArrow(run, schema)
