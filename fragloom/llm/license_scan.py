"""Licence scans: an Aho-Corasick automaton over words, and a shunting-yard evaluation of licence expressions.

A text's words are found by its bytes (A-Z lower-cased) and joined by single spaces, so the automaton sees every phrase and every
identifier tag (``SPDX-License-Identifier:`` and the like) as one string and a hit is one where it begins and ends at a word's edge.  What follows
a tag and its colon on the line is parsed as an expression of licence ids, ``AND``, ``OR`` (or ``/``), ``WITH`` and brackets; prose gives no label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, id_type, lean, only, with_id

#: Fixed by the contract: phrase, label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Phrases of this method: label, strength of the evidence.
NOTICES = {
    "apache license": ("apache", 0.8), "licensed under the apache license version 2 0": ("apache-2.0", 1.0),
    "mit license": ("mit", 0.9), "permission is hereby granted free of charge": ("mit", 1.0),
    "bsd license": ("bsd", 0.8), "redistribution and use in source and binary forms": ("bsd", 1.0),
    "mozilla public license": ("mpl", 0.9), "eclipse public license": ("epl", 0.9), "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9), "gnu general public license": ("gpl", 1.0), "cc by sa": ("cc-by-sa", 0.8),
    "cc by nc": ("cc-by-nc", 0.8), "cc by nd": ("cc-by-nd", 0.8), "cc0": ("cc0", 0.7), "public domain": ("public-domain", 0.5),
    "creative commons attribution": ("cc-by", 0.9), "proprietary and confidential": ("proprietary", 0.8),
    "cc by nc sa": ("cc-by-nc-sa", 0.8), "cc by nc nd": ("cc-by-nc-nd", 0.8), "creative commons zero": ("cc0", 0.9), "isc license": ("isc", 0.9), "zlib license": ("zlib", 0.9),
    "boost software license": ("bsl", 0.9), "artistic license": ("artistic", 0.8), "sil open font license": ("ofl", 0.9), "server side public license": ("sspl", 0.9),
    "business source license": ("busl", 0.9), "elastic license": ("elastic", 0.9), "european union public licence": ("eupl", 0.9), "microsoft public license": ("ms-pl", 0.9),
    "common development and distribution license": ("cddl", 0.9), "gnu free documentation license": ("gfdl", 1.0), "open database license": ("odbl", 0.9), "unlicense": ("unlicense", 0.6),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 1.0), "this is free and unencumbered software": ("unlicense", 1.0),
    "use of this source code is governed by": ("other", 0.4), "no part of this publication may be reproduced": ("reserved", 0.9),
}
BASE_STRENGTH = {"cc-by": 0.8, "gpl": 0.9, "reserved": 0.7}
#: Words of identifier tags.
TAGS = ("spdx license identifier", "license expression", "packagelicensedeclared", "packagelicenseconcluded", "licenseinfoinfile")
AFTER_TAG = re.compile(rb"""["']?[\x20\t]*:[\x20\t]*["']?([^\r\n]*)""")
WORD = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")
TOKEN = re.compile(r"[()]|(?<=[A-Za-z0-9.+)])/(?=[A-Za-z0-9(])|[A-Za-z0-9][A-Za-z0-9.+:-]*")
ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9.-]*\Z")
#: What may be an id that isn't on the list: a name with a version or another part behind it.
UNKNOWN_ID = re.compile(r"[a-z][a-z0-9]*(?:[.-][a-z0-9]+)*-[a-z0-9]+(?:[.-][a-z0-9]+)*\+?\Z")
OWN_ID = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+\Z")
#: Families of public licence ids and their versions; those of GNU come as they are, ``-only`` and ``-or-later``.
GNU = {"agpl": "1.0 3.0", "gpl": "1.0 2.0 3.0", "lgpl": "2.0 2.1 3.0", "gfdl": "1.1 1.2 1.3"}
FAMILIES = {
    "afl": "1.1 1.2 2.0 2.1 3.0", "apache": "1.0 1.1 2.0", "apsl": "1.0 1.1 1.2 2.0", "artistic": "1.0 2.0", "bsl": "1.0", "busl": "1.1", "bsd": "1-clause 2-clause 2-clause-patent 3-clause 3-clause-clear 4-clause",
    "cc-by": "1.0 2.0 2.5 3.0 4.0", "cc-by-nc": "1.0 2.0 2.5 3.0 4.0", "cc-by-nc-nd": "1.0 2.0 2.5 3.0 4.0", "cc-by-nc-sa": "1.0 2.0 2.5 3.0 4.0", "cc-by-nd": "1.0 2.0 2.5 3.0 4.0",
    "cc-by-sa": "1.0 2.0 2.5 3.0 4.0", "cc0": "1.0", "cddl": "1.0 1.1", "cecill": "1.0 1.1 2.0 2.1 b c", "cpl": "1.0", "ecl": "1.0 2.0", "efl": "1.0 2.0", "elastic": "2.0", "epl": "1.0 2.0",
    "eupl": "1.0 1.1 1.2", "ipl": "1.0", "lppl": "1.0 1.1 1.2 1.3a 1.3c", "mit": "0 cmu modern-variant", "mpl": "1.0 1.1 2.0", "mulanpsl": "1.0 2.0", "npl": "1.0 1.1", "odc-by": "1.0",
    "odbl": "1.0", "ofl": "1.0 1.1", "oldap": "2.8", "osl": "1.0 1.1 2.0 2.1 3.0", "php": "3.0 3.01", "psf": "2.0", "python": "2.0 2.0.1", "qpl": "1.0", "sspl": "1.0", "upl": "1.0", "vsl": "1.0",
    "w3c": "19980720 20150513", "zpl": "1.1 2.0 2.1",
}
SINGLE = "0bsd aal beerware blueoak-1.0.0 curl fsfap fsful ftl gl2ps hpnd icu ijg imagemagick info-zip intel isc jasper-2.0 json libpng libtiff mit miros mirros ms-pl ms-rl naist-2003 ncsa ntp openssl pddl-1.0 postgresql ruby sleepycat tcl unicode-dfs-2016 unlicense vim w3c wtfpl x11 xnet zlib zlib-acknowledgement".split()


def license_ids() -> frozenset[str]:
    ids = {*SINGLE, *(f"{f}-{v}" for f, versions in FAMILIES.items() for v in versions.split())}
    return frozenset(ids | {f"{f}-{v}{end}" for f, versions in GNU.items() for v in versions.split() for end in ("", "-only", "-or-later")})


NAMES = license_ids()
STRENGTH = {"or": 1, "/": 1, "and": 2, "with": 3}
SEPARATE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else (c + 32 if 0x41 <= c <= 0x5A else 0x20) for c in range(256))


def words_text(text: str | None) -> bytes:
    """The words of ``text`` (A-Z lower-cased), joined by single spaces."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(SEPARATE).split())


def strength_of(name: str) -> float:
    """1 for a public id (a final ``+`` allowed), less for one of somebody's own, 0 for what is no licence id."""
    name = name.lower()
    return 1.0 if name.removesuffix("+") in NAMES else 0.6 if OWN_ID.match(name) else 0.0


def postfix(expression: str) -> tuple[list[str], bool] | None:
    """Postfix form by the shunting-yard method and whether the expression was whole; None where it has no licence id.

    ``WITH`` binds more strongly than ``AND``, and that than ``OR``; operators are read in either case.  A well-formed id that isn't on the list is an operand where an
    operator, a bracket or the line's end follows it.  Another word there is an operand without a label (an empty string) and breaks the expression, whichever side it
    stands on.  What follows a complete expression ends it.  Where one breaks off (a missing bracket, an operator without a right side), what was read so far stands.
    """
    out: list[str] = []
    held: list[str] = []
    tokens = TOKEN.findall(expression)
    want_name = whole = True
    for k, token in enumerate(tokens):
        low = token.lower()
        if want_name:
            after = tokens[k + 1].lower() if k + 1 < len(tokens) else ""
            if token == "(":
                held.append(token)
                continue
            if strength_of(low) or held[-1:] == ["with"] and ID.match(token) and low not in STRENGTH:
                out.append(low)
            elif after not in (*STRENGTH, ")", "") or low in STRENGTH or token == ")":
                break
            elif UNKNOWN_ID.match(low):
                out.append(low)
            elif after in STRENGTH or after and "(" in held:
                out.append("")
                whole = False
            else:
                break
            want_name = False
        elif token == ")":
            if "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif low in STRENGTH:
            while held and held[-1] != "(" and STRENGTH[held[-1]] >= STRENGTH[low]:
                out.append(held.pop())
            held.append(low)
            want_name = True
        else:
            break
    if not any(x and x not in STRENGTH for x in out):
        return None
    if want_name:  # the last operator has no right side
        whole = False
        while held.pop() == "(":
            pass
    whole &= "(" not in held
    return out + [x for x in held[::-1] if x != "("], whole


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """(labels, strength) of an expression: ``OR`` takes the stronger side's strength, ``AND`` the weaker's, ``WITH`` the licence's; a broken one counts half.

    An id that isn't on the list has a strength of 0.5.  The name after ``WITH`` is an exception and gives no label.  None where there is no licence id.
    """
    found = postfix(expression)
    if found is None:
        return None
    stack: list[tuple[set[str], float] | None] = []
    for step in found[0]:
        if step not in STRENGTH:
            stack.append(({step}, strength_of(step) or 0.5) if step else None)
            continue
        right, left = stack.pop(), stack.pop()
        if step == "with" or right is None:
            stack.append(left)
        elif left is None:
            stack.append(right)
        else:
            stack.append((left[0] | right[0], (min if step == "and" else max)(left[1], right[1])))
    return (stack[0][0], stack[0][1] * (1.0 if found[1] else 0.5)) if stack[0] else None


def automaton(phrases: dict[str, object]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in phrases:
        # latin-1 keeps each byte one character, so places in the string are places in the bytes
        a.add_word(" " + phrase.encode().decode("latin-1") + " ", phrase)
    a.make_automaton()
    return a


class Scanner:
    """Places of base phrases and the labels of a text.  Every place counts, overlapping ones too."""

    def __init__(self, base: dict[str, str] | None = None, notices: dict[str, tuple[str, float]] | None = None):
        self.base = BASE if base is None else base
        self.notices = NOTICES if notices is None else notices
        # A phrase of both kinds is one word of the automaton.  Hits overlap in the space between them, which the automaton allows.
        self.automaton = automaton({**self.base, **self.notices, **dict.fromkeys(TAGS)})

    def scan(self, text: str | None) -> dict:
        """n_words, places (base phrase, first word), base_labels, labels, score and expressions.  Null and empty texts have none."""
        joined = words_text(text)
        found: list[tuple[str, int]] = []
        labels: dict[str, float] = {}
        base_labels: set[str] = set()
        tags: list[int] = []  # last words of tags
        seen, at = 0, 0  # spaces before place `at` of the string
        string = " " + joined.decode("latin-1") + " "
        for end, phrase in self.automaton.iter(string):
            start = end - len(phrase.encode()) - 1
            seen += string.count(" ", at, start) if start >= at else -string.count(" ", start, at)
            at = start
            if phrase in self.base:
                found.append((phrase, seen))
                label = self.base[phrase]
                base_labels.add(label)
                labels[label] = max(labels.get(label, 0), BASE_STRENGTH.get(label, 0.7))
            if phrase in TAGS:
                tags.append(seen + phrase.count(" "))
            if phrase in self.notices:
                label, strength = self.notices[phrase]
                labels[label] = max(labels.get(label, 0), strength)
        expressions = []
        for shown in self._after(text, tags) if tags else ():
            got = evaluate(shown)
            if got is not None:
                expressions.append(shown)
                for name in got[0]:
                    labels[name] = max(labels.get(name, 0), got[1])
        score = 1.0
        for strength in labels.values():
            score *= 1 - strength
        return {"n_words": joined.count(b" ") + 1 if joined else 0, "places": found, "base_labels": sorted(base_labels), "labels": sorted(labels), "score": 1 - score if labels else 0.0, "expressions": expressions}

    @staticmethod
    def _after(text: str, tags: list[int]) -> Iterator[str]:
        """The rest of the line behind each of the given words that a colon follows."""
        raw, wanted = text.encode("utf-8", "surrogatepass"), set(tags)
        for k, m in enumerate(WORD.finditer(raw)):
            if k in wanted and (x := AFTER_TAG.match(raw, m.end())):
                yield x[1].decode("utf-8", "replace").strip()
            if k >= tags[-1]:
                return


SCHEMA = "doc_id {}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, notices: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (0 to 1) and the tags' expressions.

    Null and empty texts have no words, empty label strings, a score of 0 and null first and last words.  Rows with equal or null ids are scanned
    each for themselves; an empty table gives no rows.  Other columns are not read.  No shuffle; memory is that of a batch of texts.
    """
    bound_batches(docs.sparkSession)

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                x = scanner.scan(text)
                starts = [k for _, k in x["places"]]
                rows.append((x["n_words"], len(starts), min(starts, default=None), max(starts, default=None), ",".join(x["base_labels"]), ",".join(x["labels"]), x["score"], x["expressions"]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions"])

    rows = only(docs, doc_id=id_col, text=text_col)
    return with_id(rows).select("doc_id", "text").mapInArrow(scan, SCHEMA.format(id_type(rows, "doc_id").simpleString()))


