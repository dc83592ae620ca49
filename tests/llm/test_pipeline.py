"""The pipeline's stages against a plain version, and the queries on the smallest tables."""

import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_components, brute_hits

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    import corpus_pipeline as C
    from fragloom.llm import quality_model as Q
    from fragloom.llm.common import keep
    from fragloom.llm.secret_scan import redacted, spans_of

    names = [n for n, _ in C.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "secrets", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [docs]
    for name, stage in C.STAGES:
        kept.append(keep(stage(spark, kept[-1], SF), name))
    columns = docs.columns
    assert all(k.columns == columns for k in kept[:-1])
    rows = [{r.doc_id: r.text for r in k.collect()} for k in kept[:-1]]
    predicted = {r.doc_id: r.predicted for r in Q.quality_scores(docs, labels).collect()}
    assert rows[1] == {k: v for k, v in rows[0].items() if predicted[k]}
    single = {i for i, n, c, best in brute_components(sorted(rows[1].items()), 5, 80) if best or not n}
    assert set(rows[2]) == single
    assert set(rows[3]) == {i for i, t in rows[2].items() if not brute_hits(t, bench, 10)[1]}
    assert rows[4] == {i: redacted(t, spans_of(t)[1]) for i, t in rows[3].items()}
    whole = C.run(spark, SF)
    assert Counter(tuple(r)[:5] for r in whole.collect()) == Counter(tuple(r)[:5] for r in kept[-1].collect())


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, columns with clashing names, and no rows at all."""
    import corpus_pipeline as C

    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = docs.limit(30).collect()
    long = " ".join(f"word{k}" for k in range(150_000))  # above a megabyte
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in own] + [(own[0].doc_id, own[0].text, own[0].lang, own[0].source, own[0].n_chars)] * 2
    rows += [(None, None, None, None, None), (900001, "", None, None, 0), (900002, None, "en", None, None), (None, "some text of no id", "en", "x", 18), (900003, long, "en", "x", len(long)), (900003, long, "en", "x", len(long))]
    extra = {c: F.lit(5) for c in ("row", "stats", "bad_id", "bad_hash", "hit_words", "cid", "c0", "twice_id", "score")}
    odd = spark.createDataFrame(rows, docs.schema).withColumns(extra).repartition(3)
    for table in (odd, odd.limit(0)):
        df = table
        for name, stage in C.STAGES:
            out = keep_(stage(spark, df, str(tmp_path)), name)
            if name != "packing":
                assert out.columns == table.columns and out.filter("score <> 5 or row <> 5 or stats <> 5").count() == 0
                df = out
            if name == "near_dedup" and table is odd:
                texts = [r.text for r in out.collect()]
                assert texts.count(long) <= 1 and max(Counter(t for t in texts if t and t.split()).values()) == 1
        got = [r.length for r in out.collect()]
        assert sum(got) >= len(got) and (bool(got) == (table is odd))


def keep_(df, name):
    from fragloom.llm.common import keep

    return keep(df, name)


@pytest.mark.parametrize("name", ["op4_url_filter", "op5_decontaminate", "op7_quality_rules", "op10_minhash_near_dedup"])
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    from fragloom.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF), con.sql(SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert Counter(repr(tuple(r[c] for c in order)) for r in got.collect()) == Counter(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_entry_registers_all(spark):
    import __spark_entry__ as E

    queries = E.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in queries) == 1
    assert "pipeline" in queries and set(E.oracle_sql()) <= set(queries)


def test_packing_is_tight(spark):
    from fragloom.llm.queries import QUERIES

    out = QUERIES["op8_best_fit_packing"](spark, SF)
    bins = defaultdict(int)
    for r in out.collect():
        bins[r.sequence_id] += r.length
    total = sum(bins.values())
    assert max(bins.values()) <= 2048 and len(bins) <= -(-total // 2048) * 1.02 + 1


@pytest.mark.parametrize("name", ["op4_url_filter", "op5_decontaminate"])
def test_native_plans(spark, name):
    from fragloom.llm.queries import QUERIES

    out = QUERIES[name](spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas")) and out.agg(F.count("*")).first()[0] > 0
