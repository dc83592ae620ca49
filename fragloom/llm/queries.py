"""The queries of this package: thin digests of its operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_orc import token_digests

    return token_digests(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(_table(spark, sf_dir, "documents")).drop("expressions")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_scan

    return secret_scan(_table(spark, sf_dir, "documents"))


#: Fixed by the contract.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Sites whose pages make up the listing, for urls that no rule fits.
LISTED_SITES = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import keep
    from .url_filter import listing, rule_table, url_verdicts

    pages = _table(spark, sf_dir, "pages")
    return url_verdicts(pages, rule_table(spark, URL_RULES), keep(listing(pages, LISTED_SITES), "listing"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_duplicates

    return simhash_duplicates(_table(spark, sf_dir, "documents"), width=4, distance=4)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import digests

    return digests(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence_report

    return divergence_report(_table(spark, sf_dir, "documents"), least_docs=3, most_terms=200)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_orc, op2_license_scan, op3_secret_scan, op4_url_filter, op5_decontaminate, op6_quality_classifier, op7_quality_rules, op8_best_fit_packing,
        op9_language_id, op10_minhash_near_dedup, op11_simhash_near_dedup, op12_fill_in_middle, op13_source_divergence,
    )
}
SQL: dict[str, str] = {
    "op4_url_filter": sql.url_filter(URL_RULES, LISTED_SITES),
    "op5_decontaminate": sql.decontaminate(),
    "op7_quality_rules": sql.quality_rules(),
    "op10_minhash_near_dedup": sql.near_duplicates(),
    "op12_fill_in_middle": sql.fill_in_middle(),
    "op13_source_divergence": sql.source_divergence(),
}
