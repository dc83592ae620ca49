"""Alignment of map files as they arrive.  An extension: each micro-batch is aligned as a batch would be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.align import align
from ..params import Params


def stream_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Maps of tab-separated lines (id, length, count, fragments) as a stream; lines whose count is wrong are left out."""
    f = F.split(F.rtrim("value"), "\t")
    frags = F.transform(F.slice(f, 4, F.greatest(F.size(f) - 3, F.lit(0))), lambda x: x.try_cast("int"))
    rows = spark.readStream.text(folder).select(F.get(f, F.lit(0)).alias("map_id"), frags.alias("frags"), F.get(f, F.lit(2)).try_cast("int").alias("num_frags"))
    return rows.filter((F.size("frags") == F.col("num_frags")) & ~F.exists("frags", lambda x: x.isNull()))


def align_stream(queries: DataFrame, maps: DataFrame, path: str, checkpoint: str, p: Params | None = None) -> StreamingQuery:
    """Align each micro-batch of ``queries`` to ``maps`` and append the matches to ``path``, by batch number, so that a batch that is run again replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        align(batch, maps, p).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
