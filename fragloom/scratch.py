"""Tables in the folder that the driver and all executors share: lineage ends there, so a lost executor costs nothing above it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local sessions without the setting, by application.
FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where it is unset and the master is local (tests), a temporary folder of the application takes its place."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
    app = spark.sparkContext.applicationId
    if app not in FOLDERS:
        FOLDERS[app] = f"file://{tempfile.mkdtemp(prefix='fragloom-')}"
    return FOLDERS[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing will read any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.cut_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
