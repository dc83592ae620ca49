"""Token ids in ORC: stripes of run-length-encoded integers with row indexes and Bloom filters on ids.

Layout of a store: one ORC file for each range of ``doc_id``, in ascending order by file number.  A row is a
document: ``doc_id``, ``part`` (number of its range), ``local_start`` (ids before it in the range), ``n_tokens`` and
``ids`` (array of int: ids up to 2^31 - 1).  ORC writes the integer columns with its run-length encoding, an index for each
``row_stride`` rows and a Bloom filter on ``doc_id``, so that a reader takes stripes in parallel and skips those that
cannot hold an id that is asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bound_batches, id_type, keep, lean, new_path, only, with_id
from .tokens import Encoder, gather


def store_schema(id_kind: T.DataType | None = None) -> T.StructType:
    return T.StructType([
        T.StructField("doc_id", id_kind or T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("local_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ])



def write_token_orc(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_stride: int = 1000,
    stripe_mb: int = 64,
) -> None:
    """Encode every whole text, append ``end_id`` and write the store at ``path`` in ascending id order.

    A null text counts as empty: its only id is ``end_id``.  Rows with a null id come first; rows with equal ids
    stand in the order of their texts' hashes, and equal rows are all written; ids may be of any type with an order.  An empty table gives an empty store.  Other
    columns are not read.  One range shuffle of (id, text) is all that moves; encoding follows it, so that a retried task
    writes the same rows.
    """
    bound_batches(docs.sparkSession)
    rows = with_id(only(docs, doc_id=id_col, text=text_col))
    schema = store_schema(id_type(rows, "doc_id"))
    # Rows with one id, or with none, are dealt out by their texts.
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, start = TaskContext.get().partitionId(), Encoder.of(tokenizer, spaced=False, memory=700_000), 0
        for batch in gather(batches, 8_000_000):
            ends, values = encoder.encode_column(batch.column(1), end_id)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(n, part, dtype=np.int32)),
                    pa.array(start + ends[:-1]),
                    pa.array(np.diff(ends)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32))),
                ],
                names=schema.names,
            )
            start += int(ends[-1])

    (
        ordered.mapInArrow(encode, schema)
        .write.option("compression", "zstd")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", row_stride)
        .option("orc.stripe.size", stripe_mb << 20)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """Rows of a store, none for a store without any; ``doc_ids`` reaches the ORC reader, which skips stripes and row groups without them.

    Rows with a null id are never asked for by ``doc_ids``; of repeated ids all rows are read.
    """
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def with_starts(spark: SparkSession, path: str, rows: DataFrame | None = None) -> DataFrame:
    """Rows of a store with ``start``: the ids of all documents before them.

    Only the ``part`` and ``n_tokens`` columns are read for the sums of the ranges: one row for each range, that is for each task of the writing job; these few
    rows are summed up in one task and broadcast only while they are under a million.
    """
    store = read_token_orc(spark, path)
    sums = store.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    starts = keep(starts, "starts")
    starts = F.broadcast(starts) if starts.count() < 1_000_000 else starts
    return (store if rows is None else rows).join(starts, "part").withColumn("start", F.col("part_start") + F.col("local_start"))


def crc_of_ids(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` (longs) and ``ids_crc32``, the unsigned crc32 of ``ids`` as little-endian unsigned 32-bit integers."""
    bound_batches(rows.sparkSession)
    schema = T.StructType([*[rows.schema[c] for c in columns], T.StructField("ids_crc32", T.LongType())])

    @lean
    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(len(columns))
            ends = ids.offsets.to_numpy()
            values = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            out = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(out, pa.int64())], names=schema.names)

    return rows.select(*columns, "ids").mapInArrow(crc, schema)


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as a store in the shared folder and return (doc_id, start, n_tokens, ids_crc32) from its files."""
    spark = docs.sparkSession
    path = new_path(spark, "token-orc")
    write_token_orc(docs, path, tokenizer, end_id)
    return crc_of_ids(with_starts(spark, path), ["doc_id", "start", "n_tokens"])
