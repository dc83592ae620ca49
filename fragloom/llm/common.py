"""Shared folders, bounded Arrow batches and column helpers for the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import new_path
from ..session import ship_package


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, lost executors cost nothing above it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    KEPT.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


#: Folders written by :func:`keep` and not deleted yet.
KEPT: list[str] = []


def forget_since(spark: SparkSession, mark: int, *but: DataFrame) -> None:
    """Delete what :func:`keep` wrote since there were ``mark`` folders, except the tables named; for callers that have read all results made of the others."""
    spared = {getattr(df, "kept_at", None) for df in but}
    for path in [x for x in KEPT[mark:] if x not in spared]:
        drop_path(spark, path)
        KEPT.remove(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables made by :func:`keep` that no later step reads."""
    for df in tables:
        path = getattr(df, "kept_at", None)
        if path:
            drop_path(df.sparkSession, path)
            if path in KEPT:
                KEPT.remove(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bound_batches(spark: SparkSession, rows: int = 256, megabytes: int = 16) -> None:
    """Whole texts pass to Python in Arrow batches of few rows and bytes, so that long ones do not add up; the workers get this package.

    Both bounds are settings of the session and stay, because results are worked out later; smaller ones that are set already are left.  A batch has one row at least.
    """
    ship_package(spark)
    conf = spark.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= rows:
        conf.set(name, rows)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name, "64m").rstrip("b").replace("m", "0" * 6)) > megabytes << 20:
        conf.set(name, megabytes << 20)


@contextlib.contextmanager
def short_rows(spark: SparkSession, rows: int = 1 << 14):
    """Larger Arrow batches for what is written within: rows of a few numbers each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy() -> None:
    """Give memory that a Python worker no longer uses back to the machine: workers live on from stage to stage."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run):
    """A function from batches to batches that tidies up now and then, and at its end."""

    @functools.wraps(run)
    def kept_small(batches):
        try:
            for i, out in enumerate(run(batches)):
                yield out
                if i % 16 == 15:
                    tidy()
        finally:
            tidy()

    return kept_small


def only(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with just the named columns, so extra columns with clashing names cannot get in the way."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def id_type(df: DataFrame, id_col: str) -> T.DataType:
    """Type of an id column in results: long for any integer, else the column's own."""
    kind = df.schema[id_col].dataType
    return T.LongType() if isinstance(kind, T.IntegralType) else kind


def with_id(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``df`` with its id column in the type that results have."""
    return df.withColumn(id_col, F.col(id_col).cast(id_type(df, id_col)))


def masked(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ..., so that no name of an operator's own can clash; ``toDF`` with the old names undoes it."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id's text is divisible by ``folds``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def tree_sum(partials: DataFrame, most: int = 64) -> DataFrame:
    """Sum of the ``value`` column (binary, float64 vectors of one length), in at most ``most`` rows; each level adds up about ``most`` rows a task."""
    import pyarrow as pa

    @lean
    def add(batches):
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                v = np.frombuffer(x, dtype="<f8")
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["value"])

    n = partials.rdd.getNumPartitions()
    while n > most:
        n = -(-n // most)
        partials = partials.repartition(n).mapInArrow(add, "value binary")
    return partials


def collect_sum(partials: DataFrame) -> np.ndarray | None:
    """The sum of all ``value`` vectors on the driver, or None without rows.  Equal rows in any order give equal bits."""
    rows = sorted(r.value for r in tree_sum(partials).collect())
    return sum((np.frombuffer(x, dtype="<f8") for x in rows[1:]), np.frombuffer(rows[0], dtype="<f8").copy()) if rows else None
