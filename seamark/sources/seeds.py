"""Seed files and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamark.functions import exprs, udfs

#: Where the named seed lists lie unless a file is given.
SEED_LISTS = {"tranco": "config/tranco_top1m.csv", "majestic": "config/majestic_million.csv"}


def seed_path(source: str, file: str | None = None) -> str:
    """The file of a named list, or the given one for `custom`."""
    if source == "custom":
        if not file:
            raise ValueError("a custom source needs a file")
        return file
    if source not in SEED_LISTS:
        raise ValueError(f"unknown source {source!r}")
    return SEED_LISTS[source]


def seed_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(exprs.seed_url(F.col("value")).alias("url")).filter("url is not null")


def domain_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct netlocs of an allow- or block-list."""
    url = exprs.seed_url(F.col("value"))
    return spark.read.text(path).select(exprs.netloc(url).alias("domain")).filter("domain is not null").distinct()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1, over the files in order of name) and value. Lines are numbered within the pieces that Spark reads; the
    pieces' own counts, a row each, are summed up first, so no line leaves its task for its number."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("place"), "value")
    counts = lines.groupBy("file", "piece").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a piece
    starts = counts.select("file", "piece", (before - F.col("first") + 1).alias("shift"))
    return lines.join(F.broadcast(starts), ["file", "piece"]).select((F.col("place") + F.col("shift")).alias("line"), "value")


def csv_rows(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    """line, rank, domain, failed of `rank,domain[,...]` or `domain` lines after the first `offset`. A single field has its line
    as rank; a rank that is no whole number makes the row fail; blank lines and blank domains are left out."""
    parts = F.split("value", ",")
    several = F.size(parts) > 1
    rank = F.when(several, F.trim(parts[0]).try_cast("long")).otherwise(F.col("line"))
    domain = F.trim(F.regexp_replace(F.when(several, parts[1]).otherwise(parts[0]), '^"|"$', ""))
    rows = numbered_lines(spark, path).filter((F.col("line") > offset) & (F.trim("value") != "")).select("line", rank.alias("rank"), domain.alias("domain"))
    return rows.withColumn("failed", F.col("rank").isNull()).filter("failed or domain <> ''")


def ranked_csv(spark: SparkSession, path: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """rank, domain, line: the first row of each domain after `offset` lines, and of these the first `limit` (none or 0: all)."""
    rows = csv_rows(spark, path, offset).filter(~F.col("failed")).withColumn("domain", exprs.seed_key(F.col("domain")))
    first = rows.groupBy("domain").agg(F.min(F.struct("line", "rank")).alias("r")).select(F.col("r.rank").alias("rank"), "domain", F.col("r.line").alias("line"))
    return first.orderBy("line").limit(limit) if limit else first


def ingest(spark: SparkSession, path: str, seen: DataFrame, limit: int = 10_000, offset: int = 0, source: str = "custom") -> tuple[DataFrame, dict[str, int]]:
    """Rows of start_urls for domains not in `seen` (domain_key), at most `limit` (0: all), and what was counted up to the row at which the limit was reached."""
    rows = csv_rows(spark, path, offset)
    url = F.when(F.col("domain").rlike("^https?://"), F.col("domain")).otherwise(F.concat(F.lit("https://"), "domain"))
    keyed = rows.filter(~F.col("failed")).select("line", "rank", url.alias("url"), exprs.seed_key(F.col("domain")).alias("domain_key"))
    first = keyed.groupBy("domain_key").agg(F.min_by(F.struct("line", "rank", "url"), "line").alias("r")).select("domain_key", "r.*").join(seen.select("domain_key"), "domain_key", "left_anti")
    taken = first.orderBy("line").limit(limit) if limit else first
    out = taken.select("url", "domain_key", "rank", (-F.col("rank")).alias("priority"), F.lit(source).alias("source"))
    ingested, last = taken.agg(F.count("*"), F.max("line")).first()
    until = F.lit(True) if not limit or ingested < limit else F.col("line") <= last
    read = numbered_lines(spark, path).filter(F.lit(True) if not limit or ingested < limit else F.col("line") <= last + 1).count()
    good, bad = rows.filter(until).agg(F.count_if(~F.col("failed")), F.count_if("failed")).first()
    return out, {"rows_read": read, "seeds_ingested": ingested, "duplicates_skipped": good - ingested, "errors": bad}


def start_order(start_urls: DataFrame, order: str = "intended") -> DataFrame:
    """Seeds as they are sent: best rank first, or, as the reference does it, by ascending priority, which puts the worst rank first."""
    if order not in ("intended", "reference"):
        raise ValueError("order is `intended` or `reference`")
    return start_urls.orderBy(F.col("priority").desc() if order == "intended" else F.col("priority").asc(), "url")


def seed_domains(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Rows of domains for a seed file: canonical name, source, seed_rank (place among the valid lines), pending. The first of repeated names counts."""
    lines = numbered_lines(spark, path).withColumn("url", exprs.seed_url(F.col("value"))).filter("url is not null")
    valid = lines.select("line", udfs.canonical_domain(F.col("url")).alias("domain")).filter("domain is not null")
    spans = valid.withColumn("span", F.floor(F.col("line") / 100_000))
    before = spans.groupBy("span").agg(F.count("*").alias("n")).select("span", F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for 100,000 lines
    ranked = spans.withColumn("own", F.row_number().over(Window.partitionBy("span").orderBy("line"))).join(F.broadcast(before), "span")
    return ranked.groupBy("domain").agg(F.min(F.col("own") + F.col("before")).cast("int").alias("seed_rank")).select("domain", F.lit(source).alias("source"), "seed_rank", F.lit("pending").alias("status"))


def filtered(urls: DataFrame, allow: DataFrame | None, block: DataFrame | None, column: str = "domain") -> DataFrame:
    """urls of allowed domains (all, if the list is empty) that are not blocked."""
    out = urls
    if allow is not None and not allow.isEmpty():
        out = out.join(allow.select(F.col("domain").alias(column)), column, "left_semi")
    return out.join(block.select(F.col("domain").alias(column)), column, "left_anti") if block is not None else out
