"""Crawl-shaped views over the driver's tables, as frames and (SQL) as common table expressions for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.functions import exprs

AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i, kind = table(spark, sf_dir, "events"), F.col("event_id"), F.col("event_type")
    host = F.concat(F.lit("d"), F.col("user_id"), F.lit(".example.com"))
    status = F.when(kind == "error", F.when(i % 3 == 0, 403).when(i % 3 == 1, 503)).when(kind == "signup", 301).when((kind == "purchase") & (i % 4 == 0), 404).otherwise(200)
    return e.select(
        i.alias("id"), F.concat(F.lit("https://"), host, F.lit("/p/"), i % 997).alias("page_url"), F.concat(F.when(i % 3 == 0, "www.").when(i % 7 == 0, "WWW.").otherwise(""), host).alias("domain"), F.col("ts").alias("crawled_at"), status.alias("status"),
        F.floor("value").cast("int").alias("images_found"), F.floor(F.col("value") / 2).cast("int").alias("images_downloaded"), F.when(i % 10 == 0, "refresh").otherwise("discovery").alias("crawl_type"), F.concat(F.lit("run-"), F.date_format("ts", "yyyy-MM-dd")).alias("crawl_run_id"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("https://"), "source", F.lit(".example.com/i/"), "doc_id").alias("url"), F.sha2("text", 256).alias("sha256"), (256 + F.col("n_chars") % 1777).cast("int").alias("width"), (F.when(F.col("n_chars") % 9 != 0, 256 + F.col("n_chars") % 777)).cast("int").alias("height"),
        F.when(F.col("lang") == "en", "JPEG").when(F.col("lang") == "fr", "PNG").when(F.col("lang") == "de", "WEBP").alias("format"), F.col("n_chars").alias("file_size"), F.concat("source", F.lit(".example.com")).alias("source_domain"), (F.col("doc_id") % 7 != 0).alias("download_success"))


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl_log(spark, sf_dir).select("id", (F.col("id") % 200).alias("image_id"), F.col("page_url").alias("source_page_url"), F.col("domain").alias("source_domain"), F.col("crawled_at").alias("discovered_at"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = crawl_log(spark, sf_dir).groupBy("crawl_run_id").agg(F.min("crawled_at").alias("started_at"), F.count("*").alias("pages"))
    return r.withColumn("status", F.when(F.col("crawl_run_id") >= "run-2024-01-29", "running").otherwise("completed"))


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per canonical domain, with claims, ranks and states set by its number."""
    log = crawl_log(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("pages"), F.count_if(F.col("status") < 400).alias("ok"), F.count_if(F.col("status") >= 400).alias("errors"), F.sum("images_found").alias("found"), F.min("crawled_at").alias("first"), F.max("crawled_at").alias("last"))
    # raw variants first, then canonical names: the second level sees distinct domains only
    by = log.groupBy(exprs.fallback_canonical(F.col("domain")).alias("domain")).agg(
        F.sum("pages").alias("pages_discovered"), F.sum("ok").alias("pages_crawled"), F.sum("found").alias("images_found"), F.sum("errors").cast("int").alias("total_error_count"), F.min("first").alias("first_seen_at"), F.max("last").alias("last_crawled_at"))
    n = F.regexp_extract("domain", r"^d(\d+)\.", 1).cast("long")
    state = F.element_at(F.array(*map(F.lit, ("pending", "active", "exhausted", "blocked", "unreachable", "pending"))), (n % 6 + 1).cast("int"))
    return by.select(
        n.alias("id"), "*", state.alias("status"), F.floor(F.col("images_found") / 2).cast("long").alias("images_stored"), F.when(n % 4 != 0, (n % 50).cast("int")).alias("seed_rank"), F.when(n % 5 == 0, F.concat(F.lit("worker-"), (n % 3).cast("string"))).alias("claimed_by"),
        F.when(n % 5 == 0, as_of() + F.make_dt_interval(F.lit(0), F.lit(0), (n % 40 - 15).cast("int"))).alias("claim_expires_at"), (n % 11).cast("int").alias("version"), F.lit(None).cast("timestamp_ntz").alias("next_crawl_after"))


SQL = r"""
v_crawl_log AS (
  SELECT event_id AS id, 'https://d' || user_id || '.example.com/p/' || (event_id % 997) AS page_url,
    (CASE WHEN event_id % 3 = 0 THEN 'www.' WHEN event_id % 7 = 0 THEN 'WWW.' ELSE '' END) || 'd' || user_id || '.example.com' AS domain, ts AS crawled_at,
    CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 403 WHEN 1 THEN 503 END WHEN event_type = 'signup' THEN 301 WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 404 ELSE 200 END AS status,
    floor(value)::INTEGER AS images_found, floor(value / 2)::INTEGER AS images_downloaded, CASE WHEN event_id % 10 = 0 THEN 'refresh' ELSE 'discovery' END AS crawl_type, 'run-' || strftime(ts, '%Y-%m-%d') AS crawl_run_id
  FROM events),
v_images AS (
  SELECT doc_id AS id, 'https://' || source || '.example.com/i/' || doc_id AS url, sha256(text) AS sha256, (256 + n_chars % 1777)::INTEGER AS width, CASE WHEN n_chars % 9 <> 0 THEN (256 + n_chars % 777)::INTEGER END AS height,
    CASE lang WHEN 'en' THEN 'JPEG' WHEN 'fr' THEN 'PNG' WHEN 'de' THEN 'WEBP' END AS format, n_chars AS file_size, source || '.example.com' AS source_domain, doc_id % 7 <> 0 AS download_success
  FROM documents),
v_provenance AS (SELECT id, id % 200 AS image_id, page_url AS source_page_url, domain AS source_domain, crawled_at AS discovered_at FROM v_crawl_log),
v_runs AS (SELECT crawl_run_id, min(crawled_at) AS started_at, count(*) AS pages, CASE WHEN crawl_run_id >= 'run-2024-01-29' THEN 'running' ELSE 'completed' END AS status FROM v_crawl_log GROUP BY crawl_run_id),
v_raw AS (
  SELECT regexp_replace(lower(domain), '^www\.', '') AS domain, count(*)::BIGINT AS pages_discovered, count(*) FILTER (status < 400)::BIGINT AS pages_crawled, sum(images_found)::BIGINT AS images_found,
    count(*) FILTER (status >= 400)::INTEGER AS total_error_count, min(crawled_at) AS first_seen_at, max(crawled_at) AS last_crawled_at
  FROM v_crawl_log GROUP BY 1),
v_domains AS (
  SELECT n AS id, r.*, ['pending', 'active', 'exhausted', 'blocked', 'unreachable', 'pending'][(n % 6 + 1)::INTEGER] AS status, (images_found // 2)::BIGINT AS images_stored, CASE WHEN n % 4 <> 0 THEN (n % 50)::INTEGER END AS seed_rank,
    CASE WHEN n % 5 = 0 THEN 'worker-' || (n % 3) END AS claimed_by, CASE WHEN n % 5 = 0 THEN TIMESTAMP '2024-02-01' + to_minutes(n % 40 - 15) END AS claim_expires_at, (n % 11)::INTEGER AS version, NULL::TIMESTAMP AS next_crawl_after
  FROM (SELECT *, regexp_extract(domain, '^d(\d+)\.', 1)::BIGINT AS n FROM v_raw) r0 JOIN v_raw r USING (domain)),
"""
SQL = SQL.replace("SELECT n AS id, r.*,", "SELECT n AS id, domain, pages_discovered, pages_crawled, images_found, total_error_count, first_seen_at, last_crawled_at,").replace(" r0 JOIN v_raw r USING (domain)", " r0")


def with_views(sql: str) -> str:
    head, own = ("WITH RECURSIVE ", sql.replace("WITH RECURSIVE ", "WITH ", 1)) if sql.upper().startswith("WITH RECURSIVE ") else ("WITH ", sql)
    return head + SQL.strip().rstrip(",") + (", " + own[5:] if own.upper().startswith("WITH ") else "\n" + own)



def full_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """domains with the store's further columns."""
    n, status = F.col("id"), F.col("status")
    days = lambda x: F.make_dt_interval(x.cast("int"))
    return domains(spark, sf_dir).select(
        "*", (n % 4).cast("int").alias("consecutive_error_count"), F.when(n % 3 == 0, F.concat("domain", F.lit(":run-0"))).alias("frontier_checkpoint_id"), F.when(n % 3 == 0, n % 9 + 1).otherwise(0).cast("int").alias("frontier_size"),
        F.when(status == "blocked", "Login page").alias("block_reason"), F.when(status == "blocked", F.element_at(F.array(*map(F.lit, ("login_required", "rate_limited", "forbidden"))), (n % 3 + 1).cast("int"))).alias("block_reason_code"),
        F.when(n % 2 == 0, "backfill_crawl_log").otherwise("seeds").alias("source"), exprs.rate(F.col("images_stored"), F.col("pages_crawled")).alias("image_yield_rate"), F.when(n % 5 != 1, F.concat(F.lit("run-"), n % 2)).alias("last_crawl_run_id"),
        (F.col("last_crawled_at") + days(n % 30)).alias("due_at"), F.lit(None).cast("timestamp_ntz").alias("frontier_updated_at"), ((n * 37) % 101).cast("int").alias("priority_score"))


def close_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawler counted for each domain: the log of every canonical name, links by its number."""
    return domains(spark, sf_dir).select("domain", F.col("pages_crawled").alias("pages"), "images_found", F.col("total_error_count").cast("long").alias("errors"), (F.col("id") % 23).alias("links_discovered"))


def close_flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of it was flushed before the close, for two domains of three."""
    s = domains(spark, sf_dir).filter("id % 3 <> 0")
    return s.select("domain", F.floor(F.col("pages_crawled") / 2).cast("long").alias("pages"), F.floor(F.col("images_found") / 2).cast("long").alias("images_found"), F.floor(F.col("total_error_count") / 2).cast("long").alias("errors"), (F.col("id") % 23).alias("links_discovered"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image items as the pipeline ends with them: an outcome by the document's number, and a message where it failed."""
    n = F.col("doc_id")
    said = F.element_at(F.array(*[F.lit(x) for x in MESSAGES]), (n % len(MESSAGES) + 1).cast("int"))
    outcome = F.element_at(F.array(*map(F.lit, ("inserted", "failed", "overwritten", "deduplicated", "skipped"))), (n % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(n.alias("id"), outcome.alias("outcome"), F.when(outcome == "failed", said).alias("error_message"), F.col("n_chars").alias("file_size"))
    return rows


#: Messages of failed items: known prefixes, words inside, and none of these.
MESSAGES = (
    "unsupported_content_type: image/svg+xml", "missing_content_type", "file_too_small: 500 bytes", "file_too_large: 99999999 bytes", "image_dimensions_too_small: 128x128", "invalid_image_payload", "http_error: 404", "missing_response",
    "Bad Content-Type seen", "dimension is too small", "way too small", "TOO LARGE", "bad status 500", "some HTTP trouble", "fetch_exception: x", "Some random error message", "",
)

SQL += r"""
v_full AS (
  SELECT *, (id % 4)::INTEGER AS consecutive_error_count, CASE WHEN id % 3 = 0 THEN domain || ':run-0' END AS frontier_checkpoint_id, (CASE WHEN id % 3 = 0 THEN id % 9 + 1 ELSE 0 END)::INTEGER AS frontier_size,
    CASE WHEN status = 'blocked' THEN 'Login page' END AS block_reason, CASE WHEN status = 'blocked' THEN ['login_required', 'rate_limited', 'forbidden'][(id % 3 + 1)::INTEGER] END AS block_reason_code,
    CASE WHEN id % 2 = 0 THEN 'backfill_crawl_log' ELSE 'seeds' END AS source, images_stored::DOUBLE / nullif(pages_crawled, 0) AS image_yield_rate, CASE WHEN id % 5 <> 1 THEN 'run-' || (id % 2) END AS last_crawl_run_id,
    last_crawled_at + to_days((id % 30)::INTEGER) AS due_at, NULL::TIMESTAMP AS frontier_updated_at, ((id * 37) % 101)::INTEGER AS priority_score
  FROM v_domains),
v_stats AS (SELECT domain, pages_crawled AS pages, images_found, total_error_count::BIGINT AS errors, id % 23 AS links_discovered FROM v_domains),
v_flushed AS (SELECT domain, pages_crawled // 2 AS pages, images_found // 2 AS images_found, (total_error_count // 2)::BIGINT AS errors, id % 23 AS links_discovered FROM v_domains WHERE id % 3 <> 0),
v_left AS (
  SELECT s.domain, s.pages AS all_pages, s.errors AS all_errors, greatest(s.pages - coalesce(f.pages, 0), 0) AS pages, greatest(s.images_found - coalesce(f.images_found, 0), 0) AS images_found,
    greatest(s.errors - coalesce(f.errors, 0), 0) AS errors, greatest(s.links_discovered - coalesce(f.links_discovered, 0), 0) AS links_discovered
  FROM v_stats s LEFT JOIN v_flushed f USING (domain)),
v_items AS (
  SELECT id, outcome, CASE WHEN outcome = 'failed' THEN said END AS error_message, file_size
  FROM (SELECT doc_id AS id, ['inserted', 'failed', 'overwritten', 'deduplicated', 'skipped'][(doc_id % 5 + 1)::INTEGER] AS outcome, n_chars AS file_size, [MESSAGES][(doc_id % N_MESSAGES + 1)::INTEGER] AS said FROM documents)),
""".replace("N_MESSAGES", str(len(MESSAGES))).replace("MESSAGES", ", ".join(f"'{m}'" for m in MESSAGES))
