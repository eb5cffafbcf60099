"""Runs and what happens at their end: page log, totals, remainders since the last flush, release of claims, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.functions import exprs, udfs
from seamark.operators import domains as dom
from seamark.operators import frontier

COUNTERS = ("pages", "images_found", "errors", "links_discovered")
STALE = "Marked stale: no activity timeout"


def opened_run(spark: SparkSession, run_id: str, mode: str, as_of: Column, seed_source: str | None = None) -> DataFrame:
    """A row of crawl_runs that has just begun."""
    row = spark.createDataFrame([(run_id, mode, 0, 0, 0, seed_source, "running")], "id string, mode string, pages_crawled int, images_found int, images_downloaded int, seed_source string, status string")
    return row.withColumn("started_at", as_of)


def page_log(outcomes: DataFrame, run_id: str, as_of: Column, crawl_type: str = "discovery") -> DataFrame:
    """Rows of crawl_log. outcomes: url, domain, status (null: no response), images_found, error_message; blocked, skipped and login pages are not logged."""
    logged = outcomes.filter(F.col("outcome").isin("parsed", "failed")) if "outcome" in outcomes.columns else outcomes
    return logged.select(F.expr("uuid()").alias("id"), F.col("url").alias("page_url"), "domain", as_of.alias("crawled_at"), "status", F.coalesce("images_found", F.lit(0)).alias("images_found"), F.lit(0).alias("images_downloaded"), "error_message", F.lit(crawl_type).alias("crawl_type"), F.lit(run_id).alias("crawl_run_id"))


def bumped_runs(runs: DataFrame, deltas: DataFrame) -> DataFrame:
    """deltas: id, pages_crawled, images_found, added to the runs in the middle of a crawl."""
    names = [c for c in deltas.columns if c != "id"]
    d = deltas.groupBy("id").agg(*[F.sum(c).alias(f"__{c}") for c in names])
    return runs.join(d, "id", "left").withColumns({c: (F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0))).cast(runs.schema[c].dataType) for c in names}).select(runs.columns)


def closed_runs(runs: DataFrame, totals: DataFrame, log: DataFrame, as_of: Column) -> DataFrame:
    """totals: id, reason, pages_crawled, images_found of runs that end. A run is completed if its reason is `finished`, else failed; downloads come from the log."""
    downloaded = log.groupBy(F.col("crawl_run_id").alias("id")).agg(F.coalesce(F.sum("images_downloaded"), F.lit(0)).alias("images_downloaded"))
    ends = totals.join(downloaded, "id", "left").select("id", F.when(F.col("reason") == "finished", "completed").otherwise("failed").alias("status"), "pages_crawled", "images_found", F.coalesce("images_downloaded", F.lit(0)).alias("images_downloaded"), as_of.alias("completed_at"))
    return dom.replaced(runs, ends, key="id")


def failed_stale(runs: DataFrame, stale: DataFrame, as_of: Column, key: str = "id") -> DataFrame:
    """runs with those of `stale` marked as failed."""
    ends = stale.select(F.col("crawl_run_id").alias(key)).withColumns({"status": F.lit("failed"), "completed_at": as_of, "error_message": F.lit(STALE)})
    return dom.replaced(runs, ends, key=key)


def images_stored_of_run(log: DataFrame, run_id: str) -> DataFrame:
    """domain (canonical), images_stored: what the run's log says was downloaded. Raw names are summed up first."""
    raw = log.filter((F.col("crawl_run_id") == run_id) & F.col("domain").isNotNull()).groupBy("domain").agg(F.coalesce(F.sum("images_downloaded"), F.lit(0)).alias("n"))
    return raw.groupBy(udfs.canonical_domain(F.col("domain")).alias("domain")).agg(F.sum("n").alias("images_stored")).filter("domain is not null")


def remainders(stats: DataFrame, flushed: DataFrame) -> DataFrame:
    """stats and flushed: domain and COUNTERS. What is not flushed yet, none of it below zero; pages and errors in all are kept as all_pages, all_errors."""
    f = flushed.select("domain", *[F.col(c).alias(f"__{c}") for c in COUNTERS])
    left = {c: F.greatest(F.col(c) - F.coalesce(F.col(f"__{c}"), F.lit(0)), F.lit(0)) for c in COUNTERS}
    return stats.join(f, "domain", "left").withColumns({"all_pages": F.col("pages"), "all_errors": F.col("errors")}).withColumns(left).select("domain", "all_pages", "all_errors", *COUNTERS)


def flush_due(stats: DataFrame, flushed: DataFrame, every: int) -> DataFrame:
    """Remainders of domains with at least `every` pages that are not flushed; none if every is 0."""
    left = remainders(stats, flushed)
    return left.filter(F.col("pages") >= every) if every > 0 else left.filter("false")


def release_requests(claims: DataFrame, stats: DataFrame, flushed: DataFrame, stored: DataFrame, queues: DataFrame, blocked: DataFrame, run_id: str, worker: str, attempts: int = 3) -> DataFrame:
    """What a worker asks of release() at close. claims: id, domain, version (as claimed), now (the version in the store).

    A version that went up by fewer than `attempts` since the claim is met by a retry, as each one counts up by one.
    """
    left = remainders(stats, flushed)
    rows = claims.join(left, "domain", "left").join(stored, "domain", "left").join(queues.select("domain", "size"), "domain", "left").join(blocked.select("domain", F.lit(True).alias("is_blocked")).distinct(), "domain", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    pending = n("size") > 0
    status = F.when(F.col("is_blocked"), "blocked").when(pending, "active").otherwise("exhausted")
    ahead = F.col("now") - F.col("version")
    active = ~F.coalesce("is_blocked", F.lit(False)) & pending
    return rows.select(
        "id", F.lit(worker).alias("worker"), F.when(ahead.between(0, attempts - 1), F.col("now")).otherwise(F.col("version")).alias("expected_version"), status.alias("new_status"),
        n("pages").alias("pages_crawled_delta"), (n("pages") + n("links_discovered")).alias("pages_discovered_delta"), n("images_found").alias("images_found_delta"), n("images_stored").alias("images_stored_delta"),
        n("errors").alias("total_error_count_delta"), F.when(n("pages") > 0, 0).otherwise(n("errors")).alias("consecutive_error_count"), F.lit(run_id).alias("last_crawl_run_id"),
        F.when(active, exprs.checkpoint_id(F.col("domain"), F.lit(run_id))).alias("__checkpoint"), F.when(active, n("size")).alias("__size"))


def release_all(domains: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """domains after the requests of release_requests(), with `applied`. Checkpoints are set where a released domain has pending urls."""
    marks = requests.select("id", F.col("__checkpoint").alias("mark"), F.col("__size").alias("mark_size"))
    out = dom.release(domains, requests.drop("__checkpoint", "__size"), as_of).join(marks, "id", "left")
    hit = F.col("applied") & F.col("mark").isNotNull()
    return out.withColumns({"frontier_checkpoint_id": F.when(hit, F.col("mark")).otherwise(F.col("frontier_checkpoint_id")), "frontier_size": F.when(hit, F.col("mark_size")).otherwise(F.col("frontier_size")).cast("int")}).select(*domains.columns, "applied")


def unreleased_updates(stats: DataFrame, flushed: DataFrame, stored: DataFrame, released: DataFrame, blocked: DataFrame) -> DataFrame:
    """Per domain that was not released: the deltas and the state that its stats ask for. Released ones have had theirs."""
    rows = remainders(stats, flushed).join(released.select("domain").distinct(), "domain", "left_anti").join(stored, "domain", "left").join(blocked.select("domain", F.lit(True).alias("is_blocked")).distinct(), "domain", "left")
    status = exprs.final_status(F.col("all_pages"), F.col("all_errors"), F.coalesce("is_blocked", F.lit(False)))
    return rows.select("domain", F.col("pages").alias("pages_crawled"), (F.col("pages") + F.col("links_discovered")).alias("pages_discovered"), "images_found", F.coalesce("images_stored", F.lit(0)).alias("images_stored"), F.col("errors").alias("total_error_count"), F.when(F.col("pages") > 0, 0).otherwise(F.col("errors")).alias("consecutive_error_count"), status.alias("status"))


def unreleased(stats: DataFrame, released: DataFrame) -> DataFrame:
    """domains with stats that were not released."""
    return stats.select("domain").distinct().join(released.select("domain"), "domain", "left_anti")


def close_checkpoints(queues: DataFrame, crawled: DataFrame, run_id: str, as_of: Column, budget: int, seconds: int = 2_592_000) -> tuple[DataFrame, DataFrame]:
    """queues: domain, url, depth, seq; crawled: domain, pages. Frontier rows, and the marks for set_checkpoints(), of domains that are at their budget and have urls left; none without a budget."""
    at_budget = crawled.filter((F.col("pages") >= budget) & F.lit(budget > 0)).select("domain")
    rows = queues.join(at_budget, "domain", "left_semi").withColumn("checkpoint_id", exprs.checkpoint_id(F.col("domain"), F.lit(run_id)))
    saved = frontier.checkpoint(rows.select("checkpoint_id", "url", "depth", "seq"), as_of, seconds)
    marks = rows.groupBy("domain").agg(F.max("checkpoint_id").alias("frontier_checkpoint_id"), F.count("*").cast("int").alias("frontier_size"))
    return saved, marks
