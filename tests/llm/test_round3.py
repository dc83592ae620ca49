"""Operators 11 to 13 against plain versions, and on odd tables."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fragloom.llm import divergence, fill_middle, simhash
from fragloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
HERE = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string"
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\r\n ", "en", "a"), (4, "one", "en", "b"), (5, "one", "en", "b"), (5, "one two\nthree  four five \v", "en", "b"), (None, "one two three", "en", None),
    (6, "Straße İSTANBUL über_ÉCOLE don't x1y 漢字 😀 grin", "de", "a"), (7, "a <P> sentinel", "de", "c"), (8, "ends with <", "de", "c"), (9, "<S", "de", "c"), (10, "M>x <M", "de", "c"),
    (11, " ".join(f"w{k % 911}" for k in range(250_000)), "en", "a"), (12, "x" * 1_500_000, "en", "a"), (13, "é" * 700_000 + " " + "z" * 700_000, "fr", "a"), (14, " lead and   trail  ", "fr", "a"),
]


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def clashing(spark, rows):
    names = ("units", "text_", "h1", "c0", "place", "fp", "cell", "n", "form", "output")
    df = spark.createDataFrame(rows, DOCS)
    return df.select(*[F.lit(k).alias(x) for k, x in enumerate(names)], "*")


@HERE
@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_source_divergence"])
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(SQL[name])
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    at = [want.columns.index(c) for c in order]
    a = sorted(map(repr, (tuple(r[c] for c in order) for r in got.collect())))
    assert a == sorted(map(repr, (tuple(r[k] for k in at) for r in want.fetchall()))) and a


# -- fill in the middle


def plain_example(doc_id, text):
    text = text or ""
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_op12_examples_and_texts_restored(spark):
    rng = random.Random(5)
    more = [(100 + k, "".join(rng.choice(["<", "<S", "S>", ">", "M", " ", "\n", "word", "é", "😀"]) for _ in range(rng.randrange(30))), "en", "a") for k in range(400)]
    docs = clashing(spark, ODD + more)
    made = fill_middle.fill_in_middle(docs)
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(repr(plain_example(*r[:2])) for r in ODD + more)
    assert sorted(r.back for r in got) == sorted(r[1] or "" for r in ODD + more)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_op12_shares_and_whole_rows(spark):
    docs = clashing(spark, ODD)
    every = {r.doc_id: r.form for r in fill_middle.fill_in_middle(docs, share=100, spm=0).collect()}
    assert set(every.values()) == {"plain", "psm"} and every[7] == every[2] == "plain" and every[14] == "psm"
    out = fill_middle.rearranged(docs, share=100, spm=0)
    assert out.schema == docs.schema and out.count() == len(ODD)
    texts = {r.doc_id: (r.text, r.units, r.output) for r in out.collect()}
    assert texts[1][0] is None and texts[2][0] == "" and texts[14][0].startswith("<P>") and texts[14][1:] == (0, 9)
    assert fill_middle.digests(docs.limit(0)).count() == 0


# -- divergence of sources


def plain_divergence(rows, least=3, most=200):
    table = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    count, in_docs, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").encode().translate(table).decode())
        count.update((lang, source, t) for t in terms)
        in_docs.update((lang, t) for t in set(terms))
    out = set()
    for lang in {x for x, _ in groups}:
        kept = sorted(t for x, t in in_docs if x == lang and in_docs[x, t] >= least)
        sources = sorted((s for x, s in groups if x == lang), key=str.encode)
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))  # noqa: B023, E731
        n = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        whole = sum(n.values())
        for s in sources:
            p = {t: share(count[lang, s, t], n[s]) for t in kept}
            pairs = []
            for o in sources:
                q = {t: share(count[lang, o, t], n[o]) for t in kept}
                if o != s:
                    pairs.append((o, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)))
            marks = []
            for t in kept:
                q = share(sum(count[lang, o, t] for o in sources), whole)
                if count[lang, s, t] and p[t] > q:
                    marks.append((t, (p[t] - q) ** 2 // q))
            for part, items, limit in (("pair", pairs, None), ("term", marks, most)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:limit])}
    return out


def test_op13_against_a_plain_version(spark):
    rng = random.Random(9)
    words = ["the", "Be", "é", "Éa", "Zz", "zz", "漢", "x1", "don't", "w" * 300, *[f"t{'abcdefghij'[k]}" for k in range(10)]]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(12))), rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "a", "b", None, "é"])) for k in range(300)]
    rows += [(k, None, "en", "empty") for k in range(3)] + [(9, "lonely terms here", "xx", "one")] + [(10, "12 34", "yy", s) for s in ("p", "q")] + rows[:40]
    docs = clashing(spark, rows)
    got = divergence.divergence_report(docs, most_terms=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    have = [tuple(r) for r in got.collect()]
    assert len(have) == len(set(have)) and set(have) == plain_divergence(rows, most=5)
    assert ("yy", "p", "pair", "q", 0, 1) in set(have) and not any(x[0] == "xx" for x in have)


def test_op13_odd_tables_and_tasks_that_flush(spark):
    docs = clashing(spark, ODD)
    assert {tuple(r) for r in divergence.divergence_report(docs).collect()} == plain_divergence(ODD)
    assert divergence.divergence_report(docs.limit(0)).count() == 0
    rows = docs.select("lang", "source", "text").coalesce(1)
    small, whole = divergence.term_counts(rows, most_held=10), divergence.term_counts(rows)
    assert small.count() > whole.count() and rows_of(divergence.wide_terms(small).drop("at")) == rows_of(divergence.wide_terms(whole).drop("at"))


def test_op13_shares_of_counts_near_the_end_of_longs(spark):
    big = 9_000_000_000_000_000
    df = spark.createDataFrame([(big, big + 7, 12), (0, big, 1)], "n long, total long, kept long").select(divergence.share_of(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    assert [r.p for r in df.collect()] == [1 + 10**9 * (big + 1) // (big + 19), 1 + 10**9 // (big + 1)]


# -- SimHash


def plain_fingerprint(text, width=4):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(width, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]).encode(), 42) for k in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, ids, distance):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    values = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= distance):
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, x in enumerate(ids):
        least[root(i)].append((x is None, x))
    return [min(least[root(i)])[1] for i in range(len(fps))]


def test_op11_fingerprints_of_whole_texts(monkeypatch):
    for _, text, *_ in ODD:
        if text is None or len(text) < 10_000:
            assert simhash.fingerprint(text) == plain_fingerprint(text), text
    rng = random.Random(2)
    pieces = simhash.pieces_of
    for _ in range(60):
        text = "".join(rng.choice(["a", "B", "é", " ", "\n", "\x85", " ", "word"]) for _ in range(rng.randrange(200)))
        want = plain_fingerprint(text)
        for size in (1, 3, 17, 1 << 20):
            monkeypatch.setattr(simhash, "pieces_of", lambda data, size=size: pieces(data, size))
            assert simhash.fingerprint(text) == want


def test_op11_odd_tables(spark):
    docs = clashing(spark, ODD)
    got = simhash.simhash_duplicates(docs).collect()
    short = [r for r in ODD if r[1] is None or len(r[1]) < 10_000]
    fps = [plain_fingerprint(r[1]) for r in short]
    want = sorted(repr((r[0], f"{f:016x}", c)) for r, f, c in zip(short, fps, plain_components(fps, [r[0] for r in short], 4), strict=True))
    assert sorted(repr(tuple(r)) for r in got if r.doc_id not in (11, 12, 13)) == want and len(got) == len(ODD)
    assert simhash.simhash_duplicates(docs.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "same words in this text"), ("a", "same words in this text"), (None, "same words in this text")], "doc_id string, text string")
    assert {tuple(r)[2] for r in simhash.simhash_duplicates(named).collect()} == {"a"}


@pytest.mark.parametrize(("distance", "crowd"), [(0, 256), (1, 3), (3, 1), (4, 256), (4, 5), (5, 20)])
def test_op11_links_of_planted_points(spark, distance, crowd):
    """Points around some centres, chains, a dense family in one cell, and random ones: the components are those of all pairs, whatever the size of a block."""
    rng = random.Random(distance)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    points = {0, 1, (1 << 64) - 1}
    for _ in range(25):
        centre = rng.getrandbits(64)
        points |= {flip(centre, rng.randrange(9)) for _ in range(rng.choice([2, 5, 40]))}
        for _ in range(6):  # a chain
            centre = flip(centre, distance)
            points.add(centre)
    family = rng.getrandbits(64)
    points |= {flip(family, rng.choice([1, 2, 5, 6])) for _ in range(300)}
    points |= {rng.getrandbits(64) for _ in range(300)}
    points = sorted(points)
    signed = [x - (1 << 64) if x >> 63 else x for x in points]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    labels = {r.fp: r.label for r in simhash.linked_points(df, distance, block=16, crowd=crowd).collect()}
    want = plain_components(points, signed, distance)
    assert [labels.get(x, x) for x in signed] == want


def test_op11_blocks_bound_what_a_key_joins(spark):
    rng = random.Random(1)
    rows = [(7, rng.getrandbits(62), k % 2) for k in range(1000)]
    mixed = spark.createDataFrame(rows, "cell long, fp long, label long")
    got = {(r.a, r.b) for r in simhash.split_links(mixed, 24, block=50).collect()}
    want = set()
    for _, a, la in rows:
        for _, b, lb in rows:
            if la == 0 and lb == 1 and (a ^ b).bit_count() <= 24:
                want |= {(a, b), (b, a)}
    assert {tuple(sorted(x)) for x in got} == {tuple(sorted(x)) for x in want} and got


@pytest.mark.parametrize("crowd", [1, 2, 7, 1000])
def test_op11_cells_as_streams(crowd):
    """However the points arrive, crowded cells come out whole and the others' links are those of all pairs."""
    rng = random.Random(crowd)
    rows = sorted((c, rng.getrandbits(5)) for c in range(60) for _ in range(rng.choice([1, 2, 3, 8, 30])))
    cell, fp = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    sizes = Counter(c for c, _ in rows)
    links = [(a, b) for c, a in rows for d, b in rows if c == d and sizes[c] <= crowd and a < b and (a ^ b).bit_count() <= 1]
    x, y = simhash.forest(np.array([a for a, _ in links], np.int64), np.array([b for _, b in links], np.int64)) if links else ((), ())
    want = dict(zip(map(int, x), map(int, y), strict=True))
    for chunk in (1, 3, 50, 10_000):
        cells, crowded, near = simhash.Cells(1, crowd, hold=20), [], []
        for k in range(0, len(rows), chunk):
            crowded.append(cells.add(cell[k : k + chunk], fp[k : k + chunk]))
            near.append(cells.connections())
        crowded.append(cells.end())
        near.append(cells.connections())
        assert [(int(c), int(f)) for part in crowded for c, f in zip(*part, strict=True)] == [r for r in rows if sizes[r[0]] > crowd]
        a, b = (np.concatenate(c) for c in zip(*near, strict=True))
        keep = a != b
        x, y = simhash.forest(a[keep], b[keep]) if keep.any() else ((), ())
        assert dict(zip(map(int, x), map(int, y), strict=True)) == want
