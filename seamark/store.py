"""Tables in shared storage: frames written once and read back, and the engine's named tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from seamark import schemas


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


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table written in the shared folder: lineage ends here, whatever executors are lost later."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Warehouse:
    """Named tables under one folder. A table is a series of snapshots, `name/v=N`; readers take the last whole one.

    A snapshot counts once Spark's _SUCCESS mark is there, so a run that dies leaves the one before it in force.
    There is one writer at a time. Logs grow by `append`, which adds files to the snapshot in force.
    """

    KEPT = 2

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def versions(self, table: str) -> list[int]:
        """Whole snapshots, ascending."""
        if not self.fs.exists(self._path(table)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(table))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and self.fs.exists(self._path(table, n, "_SUCCESS")))

    def read(self, table: str) -> DataFrame:
        schema, versions = schemas.schema(table), self.versions(table)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/v={versions[-1]}") if versions else self.spark.createDataFrame([], schema)

    def conformed(self, table: str, rows: DataFrame) -> DataFrame:
        """rows with the table's columns and types; columns that rows lack are null."""
        from pyspark.sql import functions as F

        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.schema(table)])

    def write(self, table: str, rows: DataFrame) -> None:
        """A new snapshot; older ones than the last KEPT go."""
        old = self.versions(table)
        self.conformed(table, rows).write.mode("overwrite").parquet(f"{self.root}/{table}/v={(old or [0])[-1] + 1}")
        for v in old[: 1 - self.KEPT]:
            self.fs.delete(self._path(table, f"v={v}"), True)

    def append(self, table: str, rows: DataFrame) -> None:
        self.conformed(table, rows).write.mode("append").parquet(f"{self.root}/{table}/v={(self.versions(table) or [1])[-1]}")

    def truncate(self, tables: tuple[str, ...] = ("provenance", "crawl_log", "images", "crawl_runs", "domains"), confirm: bool = False) -> list[str]:
        """Deletes tables, those that refer to others first; nothing without confirm. Returns what went."""
        gone = [t for t in tables if self.versions(t)] if confirm else []
        for t in gone:
            self.fs.delete(self._path(t), True)
        return gone
