"""Streaming forms: throughput by minute, seen urls, keyed counters, and batches into a store."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.operators import images
from seamark.store import Warehouse, written


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def per_minute(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    timed = log.withColumn("crawled_at", F.col("crawled_at").cast("timestamp")).withWatermark("crawled_at", late)
    return timed.groupBy(F.window("crawled_at", "1 minute")).agg(F.count("*").alias("pages"), F.sum("images_found").alias("images")).select(F.col("window.start").alias("minute"), "pages", "images")


def unseen(urls: DataFrame, key: str = "url", at: str | None = None, within: str = "1 day") -> DataFrame:
    """Without `at` the state grows with all keys; with it, a key is forgotten after `within`."""
    return urls.withWatermark(at, within).dropDuplicatesWithinWatermark([key]) if at else urls.dropDuplicates([key])


def domain_counters(log: DataFrame) -> DataFrame:
    return log.groupBy("domain").agg(F.count("*").alias("pages"), F.sum("images_found").alias("images"), F.count_if(F.col("status") >= 400).alias("errors"))


def into(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs each batch through `write` (to be idempotent by batch id) and stops when the input is used up."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What a keyed state emits: totals since the last flush, why it was flushed, and how many pages the key has had in all.
FLUSHED = "domain string, pages long, images long, errors long, total_pages long, reason string"


def flushes(log: DataFrame, every: int, idle_seconds: int = 600) -> DataFrame:
    """Per-domain counters as keyed state. A domain is flushed once it has `every` pages that are not, and by a processing-time
    timer when it has been idle for idle_seconds with some left (every = 0: by the timer alone)."""
    state = "pages long, images long, errors long, total long"

    def step(key, batches, kept):
        pages, images, errors, total = kept.get if kept.exists else (0, 0, 0, 0)
        out = []
        if kept.hasTimedOut:
            if pages:
                out.append((key[0], pages, images, errors, total, "idle"))
            kept.update((0, 0, 0, total))
        else:
            for rows in batches:
                pages, total = pages + len(rows), total + len(rows)
                images, errors = images + int(rows["images_found"].fillna(0).sum()), errors + int((rows["status"].fillna(0) >= 400).sum())
            if every > 0 and pages >= every:
                out.append((key[0], pages, images, errors, total, "full"))
                pages = images = errors = 0
            kept.update((pages, images, errors, total))
            kept.setTimeoutDuration(idle_seconds * 1000)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in FLUSHED.split(", ")])

    return log.select("domain", "status", "images_found").groupBy("domain").applyInPandasWithState(step, FLUSHED, state, "append", "ProcessingTimeTimeout")


def store_images(spark: SparkSession, store: Warehouse, arrivals: DataFrame, checkpoint: str):
    """Image arrivals (seq, url, sha256 and columns of images) into the store's images, batch by batch, in order of seq.

    A batch that is run again finds its images stored, and stores them as they are.
    """

    def write(batch: DataFrame, number: int) -> None:
        held = store.read("images").withColumnRenamed("sha256_hash", "sha256")
        found = written(images.store(held, batch), "outcomes")
        store.write("images", images.stored_images(held, batch, found, F.current_timestamp()).withColumnRenamed("sha256", "sha256_hash"))

    return into(arrivals, write, checkpoint)
