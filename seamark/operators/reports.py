"""Corpus and operations reports; each takes the frames it reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamark.functions import exprs


def totals(images: DataFrame, provenance: DataFrame, log: DataFrame) -> DataFrame:
    """One row from one aggregate a table; the three rows are joined."""
    a = images.agg(F.count("*").alias("total_images"), F.countDistinct("url").alias("unique_urls"))
    b = provenance.agg(F.count("*").alias("total_provenance"), F.countDistinct("source_domain").alias("unique_domains"))
    c = log.agg(F.count("*").alias("pages"), F.sum("images_found").alias("images_found"), F.sum("images_downloaded").alias("images_downloaded"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def top(rows: DataFrame, key: str, name: str, n: int = 10) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.col(name).desc(), key).limit(n)


def share(rows: DataFrame, key: str, shown: Column, name: str) -> DataFrame:
    """Counts by the raw key with their percentage of all; the window is over one row a key."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counted.select(shown.alias(name), "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2).cast("double").alias("percentage"))


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("avg", F.avg), ("max", F.max), ("min", F.min))])


def status_buckets(log: DataFrame) -> DataFrame:
    return log.filter(F.col("status").isNotNull()).groupBy(exprs.status_bucket(F.col("status")).alias("bucket")).agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, column: str) -> DataFrame:
    n = F.count("*")
    return rows.agg(n.alias("total"), F.count(column).alias("filled"), F.coalesce(F.round(F.try_divide(100.0 * F.count(column), n.cast("double")), 2), F.lit(0.0)).alias("percentage"))


def recent_images(images: DataFrame, provenance: DataFrame, n: int = 10) -> DataFrame:
    joined = images.join(provenance.select(F.col("image_id").alias("id"), "source_page_url", "discovered_at"), "id", "left")
    return joined.orderBy(F.col("discovered_at").desc_nulls_last(), "id", "source_page_url").select("id", "format", "source_page_url", "discovered_at").limit(n)


def overlap(log: DataFrame) -> DataFrame:
    return log.groupBy("domain").agg(F.countDistinct("crawl_run_id").alias("runs"), F.count("*").alias("pages")).filter("runs > 1")


def last_activity(runs: DataFrame, log: DataFrame) -> DataFrame:
    seen = log.groupBy("crawl_run_id").agg(F.max("crawled_at").alias("last_activity"))
    return runs.join(seen, "crawl_run_id", "left")


def stale_runs(runs: DataFrame, log: DataFrame, as_of: Column, minutes: int = 60) -> DataFrame:
    """Running runs without activity since as_of - minutes."""
    active = last_activity(runs.filter("status = 'running'"), log).withColumn("last_activity", F.coalesce("last_activity", "started_at"))
    idle = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_activity").cast("timestamp"))) / F.lit(60_000_000.0)
    return active.filter(F.col("last_activity") < as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))).select("crawl_run_id", "started_at", "last_activity", idle.alias("minutes_idle"))


def per_minute(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_trunc("minute", F.col("crawled_at").cast("timestamp")).cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("pages"), F.sum("images_found").alias("images"))


def repeated_pages(log: DataFrame) -> DataFrame:
    return log.groupBy("domain", "page_url").agg(F.count("*").alias("n")).filter("n > 1")


def priority_stats(domains: DataFrame) -> DataFrame:
    s = F.col("priority_score")
    return domains.agg(F.count("*").alias("total"), F.round(F.avg(s)).cast("int").alias("average"), F.min(s).alias("least"), F.max(s).alias("most"), F.percentile(s, F.lit(0.5)).alias("median"))


def priority_tiers(domains: DataFrame) -> DataFrame:
    return domains.groupBy(exprs.tier(F.col("priority_score")).alias("tier")).agg(F.count("*").alias("n"), F.min("priority_score").alias("least"))


def summary(domains: DataFrame) -> DataFrame:
    return domains.groupBy("status").agg(F.count("*").alias("domains"), F.round(F.avg("pages_crawled")).cast("int").alias("avg_pages"), F.sum("images_stored").alias("total_images"))


def claims_by_worker(domains: DataFrame, as_of: Column) -> DataFrame:
    live = domains.filter(F.col("claim_expires_at") > as_of)
    return live.groupBy("claimed_by").agg(F.count("*").alias("claims"), F.min("claim_expires_at").alias("first_expiry"), F.max("claim_expires_at").alias("last_expiry"))


def claimable(domains: DataFrame, as_of: Column) -> DataFrame:
    return domains.groupBy("status").agg(F.count_if(F.col("claim_expires_at") < as_of).alias("expired"), F.count_if((F.col("claimed_by").isNull()) | (F.col("claim_expires_at") < as_of)).alias("claimable"))


def canonical_duplicates(log: DataFrame) -> DataFrame:
    """Canonical names with several raw variants, the variants by first sight."""
    raw = log.groupBy("domain").agg(F.min("crawled_at").alias("seen"))
    return raw.groupBy(exprs.fallback_canonical(F.col("domain")).alias("canonical")).agg(F.count("*").alias("variants"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seen", "domain"))), lambda x: x["domain"]), ",").alias("names")).filter("variants > 1")


def run_totals(log: DataFrame) -> DataFrame:
    return log.groupBy("crawl_run_id").agg(F.count("*").alias("pages"), F.sum("images_found").alias("found"), F.coalesce(F.sum("images_downloaded"), F.lit(0)).alias("downloaded"))


def counters(outcomes: DataFrame, reasons: DataFrame, column: str = "reason") -> DataFrame:
    """Counts by reason, zero where none occurred."""
    return reasons.join(outcomes.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def hash_coverage(images: DataFrame) -> DataFrame:
    """One row: images, those with each perceptual hash, and their percentages (0 without images)."""
    n = F.count("*")
    part = lambda c, name: [F.count(c).alias(f"{name}_count"), F.coalesce(F.try_divide(100.0 * F.count(c), n.cast("double")), F.lit(0.0)).alias(f"{name}_pct")]
    return images.agg(n.alias("total"), *part("phash_hash", "phash"), *part("dhash_hash", "dhash"))


def summary_totals(domains: DataFrame) -> DataFrame:
    """summary() with a row TOTAL of all states, from the same counts."""
    rows = summary(domains)
    total = rows.agg(F.lit("TOTAL").alias("status"), F.coalesce(F.sum("domains"), F.lit(0)).alias("domains"), F.lit(None).cast("int").alias("avg_pages"), F.coalesce(F.sum("total_images"), F.lit(0)).alias("total_images"))
    return rows.unionByName(total)


def recent_progress(domains: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    """Claimed domains that were crawled lately."""
    since = as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return domains.filter(F.col("claimed_by").isNotNull() & (F.col("last_crawled_at") >= since))


def backfill_coverage(log: DataFrame, domains: DataFrame) -> DataFrame:
    """One row: domains in the log, backfilled ones, all."""
    a = log.agg(F.count_distinct("domain").alias("crawl_log_domains"))
    return a.crossJoin(domains.agg(F.count_if(F.col("source").startswith("backfill")).alias("backfilled_domains"), F.count("*").alias("total_domains")))  # one row each


def yield_by_status(domains: DataFrame) -> DataFrame:
    """Backfilled domains by state."""
    return domains.filter(F.col("source").startswith("backfill")).groupBy("status").agg(F.count("*").alias("domain_count"), F.avg("image_yield_rate").alias("avg_yield"), F.avg("pages_crawled").alias("avg_pages"))


def crawl_statistics(pages: DataFrame, items: DataFrame) -> DataFrame:
    """One row for a crawl. pages: crawled_at, status, images_found, error_message; items: outcome, file_size. A page failed if it has an error message."""
    failed = F.col("error_message").isNotNull()
    seconds = (F.unix_micros(F.max("crawled_at").cast("timestamp")) - F.unix_micros(F.min("crawled_at").cast("timestamp"))) / F.lit(1e6)
    a = pages.agg(F.round(seconds, 2).alias("duration_seconds"), F.count_if(~failed).alias("pages_crawled"), F.count_if(failed).alias("pages_failed"), F.coalesce(F.sum(F.when(~failed, F.col("images_found"))), F.lit(0)).alias("images_discovered"))
    new = F.col("outcome").isin("inserted", "overwritten")
    b = items.agg(F.count_if(new).alias("images_downloaded"), F.count_if(F.col("outcome") == "skipped").alias("images_skipped"), F.count_if(F.col("outcome") == "failed").alias("images_failed"), F.count_if(F.col("outcome") == "deduplicated").alias("images_deduplicated"), F.coalesce(F.sum(F.when(new, F.col("file_size"))), F.lit(0)).alias("total_bytes"))
    return a.crossJoin(b).withColumn("error_count", F.col("pages_failed") + F.col("images_failed"))  # one row each


def runs_listed(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc_nulls_first(), "id").limit(n)


def analysis(images: DataFrame, provenance: DataFrame, log: DataFrame, runs: DataFrame) -> dict:
    """What the written report shows, as small collected rows: every frame here has one row, ten, or one for each kind of value."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    shown = images.withColumnRenamed("file_size_bytes", "size")
    both = shown.filter("width is not null and height is not null")
    joined = images.join(provenance.select(F.col("image_id").alias("id"), "source_domain", F.col("discovered_at").alias("found_at")), "id", "left")
    return {
        "totals": rows(totals(images, provenance, log))[0], "top_domains": rows(top(provenance, "source_domain", "n")), "top_pages": rows(top(provenance, "source_page_url", "n")),
        "formats": sorted(rows(share(images, "format", F.coalesce("format", F.lit("unknown")), "format_name")), key=lambda r: (-r["n"], r["format_name"])), "dimensions": rows(spread(both, "width", "height"))[0], "sizes": rows(spread(shown, "size"))[0],
        "success": rows(share(images, "download_success", F.col("download_success"), "success")), "hashes": rows(hash_coverage(images))[0], "statuses": sorted(rows(status_buckets(log)), key=lambda r: r["bucket"]),
        "samples": rows(joined.orderBy(F.col("found_at").desc_nulls_last(), "id").select("source_domain", "url", "format", "width", "height", "file_size_bytes").limit(10)), "latest_run": (rows(runs_listed(runs, 1)) or [None])[0],
    }


def markdown(data: dict, title: str) -> str:
    """The report of analysis() as Markdown."""
    t, d, z, h = data["totals"], data["dimensions"], data["sizes"], data["hashes"]
    images, statuses = t["total_images"], sum(r["n"] for r in data["statuses"])
    pct = lambda n, of: f"{100 * n / of if of else 0:.1f}%"
    out = [f"# {title}", "", "## Crawl Configuration"]
    if run := data["latest_run"]:
        out += [f"- **Crawl Run ID**: `{run['id']}`", f"- **Started**: {run['started_at']}", *([f"- **Completed**: {run['completed_at']}"] if run["completed_at"] else []), f"- **Mode**: {run['mode']}"]
    success = next((r["percentage"] for r in data["success"] if r["success"]), 0)
    out += ["", "## Key Findings", "", f"- **{images} unique images** indexed", f"- **{t['pages']} pages** crawled across **{t['unique_domains']} unique domains**", f"- **{t['images_found'] or 0} images found** in total ({t['images_downloaded'] or 0} passed validation)", f"- **{success}% download success rate**"]
    out += ["", "### Top Domains", *[f"{i}. **{r['source_domain']}** - {r['n']} images ({pct(r['n'], images)} of total)" for i, r in enumerate(data["top_domains"][:5], 1)]]
    out += ["", "### Formats", *[f"- **{r['format_name'].upper()}**: {r['percentage']}% ({r['n']} images)" for r in data["formats"]]]
    if d["avg_width"] is not None:
        out += ["", "### Dimensions", f"- **Average**: {int(d['avg_width'])}×{int(d['avg_height'])} pixels", f"- **Largest**: {d['max_width']}×{d['max_height']} pixels", f"- **Smallest**: {d['min_width']}×{d['min_height']} pixels"]
    if z["avg_size"] is not None:
        out += ["", "### File Sizes", f"- **Average**: {int(z['avg_size'] / 1024)} KB per image", f"- **Largest**: {z['max_size'] / 1048576:.1f} MB", f"- **Smallest**: {z['min_size'] / 1024:.1f} KB"]
    out += ["", "### Hash Coverage", "- **SHA-256**: 100% (all images)", *[f"- **{n}**: {h[n.lower() + '_pct']:.1f}% ({h[n.lower() + '_count']}/{images} images)" for n in ("pHash", "dHash")]]
    out += ["", "### Crawl Health", *[f"- **{r['bucket']}**: {r['n']} pages ({pct(r['n'], statuses)})" for r in data["statuses"]]]
    out += ["", "## Top Pages by Image Count", *[f"{i}. [{r['source_page_url']}]({r['source_page_url']}) - {r['n']} images" for i, r in enumerate(data["top_pages"], 1)]]
    out += ["", "## Sample Images"]
    for i, r in enumerate(data["samples"][:5], 1):
        out += [f"### {i}. {r['source_domain']}", f"- **URL**: {r['url']}", f"- **Format**: {r['format']}", f"- **Dimensions**: {r['width']}×{r['height']} pixels", f"- **Size**: {(r['file_size_bytes'] or 0) / 1024:.1f} KB"]
    return "\n".join(out) + "\n"
