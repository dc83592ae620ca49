"""A training corpus from ``documents``: quality, near-duplicates, benchmark passages, secrets, packing.

Each stage works on all that the one before it kept; what it decides takes effect.  All but the last return the columns of
``documents``, in their order and whatever else they are named.  A table without rows gives none in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fragloom.llm import common
from fragloom.llm.decontaminate import drop_contaminated
from fragloom.llm.near_dup import drop_near_duplicates
from fragloom.llm.packing import pack
from fragloom.llm.quality_model import drop_low_quality
from fragloom.llm.secret_scan import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects.

    Null and empty texts are judged by their statistics, repeated rows alike; labels that are null teach nothing; without any label all stay.
    """
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that shares four fifths of its five-word shingles.

    Texts that are null or without words all stay; repeated rows are one document; documents without an id go where any with one is like them.
    """
    return drop_near_duplicates(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten words in a row of a benchmark item, or all of a shorter one.

    Null and empty texts stay; repeated rows go or stay together; items without words match nothing.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and ``n_chars`` counted anew; null and empty texts and repeated rows stay as they are."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences; a null or an empty text is one end id, repeated rows are each packed."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]

#: Encoding and min-hash signatures can't be put in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written to the shared folder and read again.

    Once a stage's rows are written, its working tables and its input are deleted; what the last stage reads stays for the caller.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = len(common.KEPT)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.keep(docs, f"stage-{name}")
            common.forget_since(spark, mark, docs)
    return docs
