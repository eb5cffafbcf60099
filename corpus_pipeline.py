"""The corpus pipeline: quality rules, near duplicates, secrets, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamark.llm import bpe, jaccard, mixing, quality, secrets
from seamark.llm.store import drop, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.retain(docs, quality.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, the one of the least id."""
    return jaccard.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret gives way to its kind in brackets."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return bpe.encode(docs)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("secret scans", secret_scan), ("source mix", source_mix), ("tokens", tokens)]

#: The line model and the merges have no SQL form; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if name != STAGES[0][0]:  # what the stage before wrote has been read
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
