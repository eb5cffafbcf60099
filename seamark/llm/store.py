"""Written tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Words of a text: everything but blank, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where that is unset and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="seamark-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: With it, Spark deletes an execution's shuffle files as soon as the execution ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_to(df: DataFrame, path: str, partition_by: list[str] | None = None, codec: str = "zstd") -> DataFrame:
    """The same rows, written to path and read back; the shuffles that made them go at once."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        out = df.write.option("compression", codec)
        (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._seamark_path = path
    return back


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str = "zstd") -> DataFrame:
    """The same rows, written once and read back: it cuts lineage, and lost executors cost no recomputation of it."""
    return write_to(df, new_path(df.sparkSession, name), partition_by, codec)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    delete(df.sparkSession, df._seamark_path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
