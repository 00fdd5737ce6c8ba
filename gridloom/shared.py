"""The folder that the driver and all executors share, and tables written to it to cut lineage.

The folder is the one the session names in `spark.checkpoint.dir`, or the one set by `setCheckpointDir`. Only a session
in one process (master `local`) gets a folder of its own; on a cluster without a named folder there is an error.
Tables written here are removed when the application ends, if `discard` hasn't removed them before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.split("[")[0] == "local":
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="gridloom-"))
    return f"file://{_own[0]}"


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def named(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder that goes when the application ends."""
    path = f"{folder(spark)}/{kind}-{uuid.uuid4().hex}"
    at, fs = _path(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table of its own in the shared folder, read again: computed once, and not again when an
    executor is lost. Rows without columns or with names that differ in case only can't be stored."""
    path = named(df.sparkSession, "stored")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trimmed(spark: SparkSession) -> None:
    """Collects the driver's garbage: its heap shrinks towards what lives, and shuffles and broadcasts that nothing reads any more go."""
    spark.sparkContext._jvm.java.lang.System.gc()


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing will read any more."""
    for df in tables:
        root = folder(df.sparkSession)
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/stored-" in path and path.split(":")[-1].lstrip("/").startswith(root.split(":")[-1].lstrip("/")):
                at, fs = _path(df.sparkSession, path)
                fs.delete(at, True)
