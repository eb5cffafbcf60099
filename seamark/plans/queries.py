"""The engine's queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.conf import EngineConf
from seamark.functions import exprs
from seamark.operators import domains as dom
from seamark.operators import frontier, images, pages, reports
from seamark.plans import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = v.with_views(sql.strip())
        return f

    return add


RATES = "images_stored::DOUBLE / nullif(pages_crawled, 0) AS image_yield_rate, total_error_count::DOUBLE / nullif(pages_crawled, 0) AS error_rate"
SCORED = f"""WITH rated AS (SELECT *, {RATES} FROM v_domains WHERE status NOT IN ('blocked', 'unreachable')),
scored AS (SELECT *, (coalesce(-seed_rank, 0) + round_even(coalesce(image_yield_rate, 0) * 1000, 0)::INTEGER + (least(greatest(pages_discovered - pages_crawled, 0), 500) * 2)::INTEGER - round_even(coalesce(error_rate, 0) * 500, 0)::INTEGER
  + round_even((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(coalesce(last_crawled_at, TIMESTAMP '2000-01-01'))) / 86400000000.0::DOUBLE * 5, 0)::INTEGER)::INTEGER AS priority_score FROM rated) """
ASOF = "TIMESTAMP '2024-02-01'"


def scored(s: SparkSession, d: str) -> DataFrame:
    return dom.scored(v.domains(s, d), v.as_of())


@query("s7_crawl_log_scan", "SELECT id, domain, status FROM v_crawl_log WHERE status >= 400")
def _(s, d):
    return v.crawl_log(s, d).filter("status >= 400").select("id", "domain", "status")


@query("a1_totals", "SELECT (SELECT count(*) FROM v_images) AS total_images, (SELECT count(DISTINCT url) FROM v_images) AS unique_urls, (SELECT count(*) FROM v_provenance) AS total_provenance, (SELECT count(DISTINCT source_domain) FROM v_provenance) AS unique_domains, count(*) AS pages, sum(images_found)::BIGINT AS images_found, sum(images_downloaded)::BIGINT AS images_downloaded FROM v_crawl_log")
def _(s, d):
    return reports.totals(v.images(s, d), v.provenance(s, d), v.crawl_log(s, d))


@query("a2_top_domains", "SELECT source_domain, count(*) AS images FROM v_provenance GROUP BY 1 ORDER BY images DESC, source_domain LIMIT 10")
def _(s, d):
    return reports.top(v.provenance(s, d), "source_domain", "images")


@query("a3_top_pages", "SELECT source_page_url, count(*) AS images FROM v_provenance GROUP BY 1 ORDER BY images DESC, source_page_url LIMIT 10")
def _(s, d):
    return reports.top(v.provenance(s, d), "source_page_url", "images")


@query("a4_dimensions", "SELECT avg(width) AS avg_width, max(width) AS max_width, min(width) AS min_width, avg(height) AS avg_height, max(height) AS max_height, min(height) AS min_height FROM v_images WHERE width IS NOT NULL AND height IS NOT NULL")
def _(s, d):
    return reports.spread(v.images(s, d).filter("width is not null and height is not null"), "width", "height")


@query("a5_format_distribution", "SELECT coalesce(format, 'unknown') AS format, n, round(100.0 * n / sum(n) OVER (), 2)::DOUBLE AS percentage FROM (SELECT format, count(*) AS n FROM v_images GROUP BY format)")
def _(s, d):
    return reports.share(v.images(s, d), "format", F.coalesce("format", F.lit("unknown")), "format")


@query("a6_file_sizes", "SELECT avg(file_size) AS avg_file_size, max(file_size) AS max_file_size, min(file_size) AS min_file_size FROM v_images")
def _(s, d):
    return reports.spread(v.images(s, d), "file_size")


@query("a7_download_success", "SELECT download_success, n, round(100.0 * n / sum(n) OVER (), 2)::DOUBLE AS percentage FROM (SELECT download_success, count(*) AS n FROM v_images GROUP BY 1)")
def _(s, d):
    return reports.share(v.images(s, d), "download_success", F.col("download_success"), "download_success")


BUCKET = "CASE WHEN status BETWEEN 200 AND 299 THEN '2xx Success' WHEN status BETWEEN 300 AND 399 THEN '3xx Redirect' WHEN status BETWEEN 400 AND 499 THEN '4xx Client Error' WHEN status BETWEEN 500 AND 599 THEN '5xx Server Error' ELSE 'Other' END"


@query("a8_status_buckets", f"SELECT {BUCKET} AS bucket, count(*) AS n FROM v_crawl_log WHERE status IS NOT NULL GROUP BY 1")
def _(s, d):
    return reports.status_buckets(v.crawl_log(s, d))


BACKFILL = "SELECT domain, pages_discovered, pages_crawled, images_found, total_error_count::BIGINT AS errors, first_seen_at, last_crawled_at, CASE WHEN total_error_count > 0.5 * pages_discovered THEN 'blocked' ELSE 'exhausted' END AS status FROM v_raw"


@query("a10_raw_domains", "SELECT domain, count(*) AS total, count(*) FILTER (status < 400) AS ok, count(*) FILTER (status >= 400) AS errors FROM v_crawl_log GROUP BY 1")
def _(s, d):
    return v.crawl_log(s, d).groupBy("domain").agg(F.count("*").alias("total"), F.count_if(F.col("status") < 400).alias("ok"), F.count_if(F.col("status") >= 400).alias("errors"))


@query("a11_backfill", BACKFILL)
def a11(s, d):
    return dom.backfill(v.crawl_log(s, d))


CANON = r"regexp_replace(lower(source_domain), '^www\.', '')"


@query("a12_images_stored", f"SELECT domain, images_stored, distinct_images FROM (SELECT {CANON} AS domain, sum(n)::BIGINT AS images_stored FROM (SELECT source_domain, count(DISTINCT image_id) AS n FROM v_provenance GROUP BY 1) GROUP BY 1) JOIN (SELECT {CANON} AS domain, count(DISTINCT image_id) AS distinct_images FROM v_provenance GROUP BY 1) USING (domain)")
def _(s, d):
    return dom.images_stored(v.provenance(s, d))


@query("a13_summary", "SELECT status, count(*) AS domains, round(avg(pages_crawled))::INTEGER AS avg_pages, sum(images_stored)::BIGINT AS total_images FROM v_domains GROUP BY 1")
def _(s, d):
    return reports.summary(v.domains(s, d))


@query("a14_claims_by_worker", f"SELECT claimed_by, count(*) AS claims, min(claim_expires_at) AS first_expiry, max(claim_expires_at) AS last_expiry FROM v_domains WHERE claim_expires_at > {ASOF} GROUP BY 1")
def _(s, d):
    return reports.claims_by_worker(v.domains(s, d), v.as_of())


@query("a15_overlap", "SELECT domain, count(DISTINCT crawl_run_id) AS runs, count(*) AS pages FROM v_crawl_log GROUP BY 1 HAVING count(DISTINCT crawl_run_id) > 1")
def _(s, d):
    return reports.overlap(v.crawl_log(s, d))


@query("a16_stale_runs", "SELECT r.crawl_run_id, started_at, coalesce(last, started_at) AS last_activity, (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(coalesce(last, started_at))) / 60000000.0::DOUBLE AS minutes_idle FROM v_runs r LEFT JOIN (SELECT crawl_run_id, max(crawled_at) AS last FROM v_crawl_log GROUP BY 1) l USING (crawl_run_id) WHERE status = 'running' AND coalesce(last, started_at) < TIMESTAMP '2024-01-30 11:00:00'")
def _(s, d):
    return reports.stale_runs(v.runs(s, d), v.crawl_log(s, d), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


@query("a17_per_minute", "SELECT date_trunc('minute', crawled_at)::TIMESTAMP AS minute, count(*) AS pages, sum(images_found)::BIGINT AS images FROM v_crawl_log GROUP BY 1")
def _(s, d):
    return reports.per_minute(v.crawl_log(s, d))


@query("a18_repeated_pages", "SELECT domain, page_url, count(*) AS n FROM v_crawl_log GROUP BY 1, 2 HAVING count(*) > 1")
def _(s, d):
    return reports.repeated_pages(v.crawl_log(s, d))


@query("a19_priority_stats", SCORED + "SELECT count(*) AS total, round(avg(priority_score))::INTEGER AS average, min(priority_score) AS least, max(priority_score) AS most, quantile_cont(priority_score, 0.5)::DOUBLE AS median FROM scored")
def _(s, d):
    return reports.priority_stats(scored(s, d))


@query("a20_priority_tiers", SCORED + "SELECT CASE WHEN priority_score >= 1000 THEN 'high' WHEN priority_score >= 500 THEN 'medium' WHEN priority_score >= 0 THEN 'normal' ELSE 'low' END AS tier, count(*) AS n, min(priority_score) AS least FROM scored GROUP BY 1")
def _(s, d):
    return reports.priority_tiers(scored(s, d))


@query("a22_run_totals", "SELECT crawl_run_id, count(*) AS pages, sum(images_found)::BIGINT AS found, coalesce(sum(images_downloaded), 0)::BIGINT AS downloaded FROM v_crawl_log GROUP BY 1")
def _(s, d):
    return reports.run_totals(v.crawl_log(s, d))


@query("a24_domain_counters", "SELECT domain, count(*) AS pages, sum(images_found)::BIGINT AS images, count(*) FILTER (status >= 400) AS errors FROM v_crawl_log GROUP BY 1")
def _(s, d):
    from seamark.streaming.throughput import domain_counters

    return domain_counters(v.crawl_log(s, d))


@query("a28_claimable", f"SELECT status, count(*) FILTER (claim_expires_at < {ASOF}) AS expired, count(*) FILTER (claimed_by IS NULL OR claim_expires_at < {ASOF}) AS claimable FROM v_domains GROUP BY 1")
def _(s, d):
    return reports.claimable(v.domains(s, d), v.as_of())


@query("a29_canonical_duplicates", r"WITH raw AS (SELECT domain, min(crawled_at) AS seen FROM v_crawl_log GROUP BY 1) SELECT regexp_replace(lower(domain), '^www\.', '') AS canonical, count(*) AS variants, string_agg(domain, ',' ORDER BY seen, domain) AS names FROM raw GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return reports.canonical_duplicates(v.crawl_log(s, d))


@query("j1_recent_images", "SELECT i.id, format, source_page_url, discovered_at FROM v_images i LEFT JOIN (SELECT image_id, source_page_url, discovered_at FROM v_provenance) p ON p.image_id = i.id ORDER BY discovered_at DESC NULLS LAST, i.id, source_page_url LIMIT 10")
def _(s, d):
    return reports.recent_images(v.images(s, d), v.provenance(s, d))


@query("j2_last_activity", "SELECT r.*, last_activity FROM v_runs r LEFT JOIN (SELECT crawl_run_id, max(crawled_at) AS last_activity FROM v_crawl_log GROUP BY 1) USING (crawl_run_id)")
def _(s, d):
    return reports.last_activity(v.runs(s, d), v.crawl_log(s, d))


@query("c9_priorities", SCORED + "SELECT domain, status, image_yield_rate, error_rate, priority_score FROM scored")
def _(s, d):
    return scored(s, d).select("domain", "status", "image_yield_rate", "error_rate", "priority_score")


ORDER = "(status = 'active') DESC, priority_score DESC, last_crawled_at ASC NULLS FIRST, domain"
CANDIDATES = f"status IN ('pending', 'active') AND (next_crawl_after IS NULL OR next_crawl_after < {ASOF}) AND (claimed_by IS NULL OR claim_expires_at < {ASOF})"


@query("c1_claim", SCORED + f"SELECT domain, 'w' || (1 + (row_number() OVER (ORDER BY {ORDER}) - 1) // 10) AS claimed_by, {ASOF} + INTERVAL 30 MINUTE AS claim_expires_at, version + 1 AS version FROM scored WHERE {CANDIDATES} ORDER BY {ORDER} LIMIT 30")
def _(s, d):
    return dom.claim(scored(s, d), ["w1", "w2", "w3"], 10, v.as_of()).select("domain", "claimed_by", "claim_expires_at", "version")


@query("o3_top_priority", SCORED + "SELECT domain, priority_score FROM scored ORDER BY priority_score DESC NULLS FIRST, domain LIMIT 20")
def _(s, d):
    return scored(s, d).select("domain", "priority_score").orderBy(F.col("priority_score").desc_nulls_first(), "domain").limit(20)


@query("o5_recent_runs", "SELECT crawl_run_id, started_at, status FROM v_runs ORDER BY started_at DESC LIMIT 10")
def _(s, d):
    return v.runs(s, d).select("crawl_run_id", "started_at", "status").orderBy(F.col("started_at").desc_nulls_first()).limit(10)


MINE = f"coalesce(claimed_by = 'worker-1' AND claim_expires_at > {ASOF}, FALSE)"


@query("c2_renew", f"SELECT domain, CASE WHEN {MINE} THEN {ASOF} + INTERVAL 30 MINUTE ELSE claim_expires_at END AS claim_expires_at, version + {MINE}::INTEGER AS version, {MINE} AS renewed FROM v_domains")
def _(s, d):
    return dom.renew(v.domains(s, d), "worker-1", v.as_of()).select("domain", "claim_expires_at", "version", "renewed")


MOVES = ", ".join(f"'{a}>{b}'" for a, bs in exprs.MOVES.items() for b in bs)


@query("c4_transitions", f"SELECT a.status AS old_status, b.status AS new_status, a.status || '>' || b.status IN ({MOVES}) AS allowed FROM (SELECT DISTINCT status FROM v_domains) a, (SELECT DISTINCT status FROM v_domains) b")
def _(s, d):
    states = v.domains(s, d).select("status").distinct()
    pairs = states.select(F.col("status").alias("old_status")).crossJoin(states.select(F.col("status").alias("new_status")))  # five states
    return pairs.withColumn("allowed", dom.may_move(F.col("old_status"), F.col("new_status")))


@query("c5_expire", f"SELECT domain, coalesce(claim_expires_at < {ASOF}, FALSE) AND claimed_by IS NOT NULL AS released FROM v_domains")
def _(s, d):
    return dom.expire(v.domains(s, d), v.as_of()).select("domain", "released")


@query("c11_final_status", "SELECT domain, CASE WHEN total_error_count > pages_crawled THEN 'blocked' WHEN pages_crawled = 0 AND total_error_count > 0 THEN 'unreachable' WHEN pages_crawled = 0 AND total_error_count = 0 THEN 'pending' ELSE 'active' END AS final_status FROM v_domains")
def _(s, d):
    return v.domains(s, d).select("domain", exprs.final_status(F.col("pages_crawled"), F.col("total_error_count"), F.col("total_error_count") > F.col("pages_crawled")).alias("final_status"))


@query("w1_insert_new", "SELECT domain, 'old' AS source FROM v_domains WHERE id % 2 = 0 UNION ALL SELECT domain, 'new' FROM v_domains WHERE id % 2 = 1")
def _(s, d):
    rows = v.domains(s, d)
    return dom.insert_new(rows.filter("id % 2 = 0").select("domain", F.lit("old").alias("source")), rows.select("domain", F.lit("new").alias("source")), "domain")


@query("w2_upsert", "SELECT domain, CASE WHEN id % 2 = 0 THEN pages_crawled ELSE 7 END AS pages_crawled, CASE WHEN id % 2 = 0 THEN 'kept' ELSE 'new' END AS status FROM (SELECT domain, id, pages_crawled + 1 AS pages_crawled FROM v_domains)")
def _(s, d):
    rows = v.domains(s, d)
    old = rows.filter("id % 2 = 0").select("domain", "pages_crawled", F.lit("kept").alias("status"))
    new = rows.select("domain", F.when(F.col("id") % 2 == 0, F.col("pages_crawled") + 1).otherwise(7).alias("pages_crawled"), F.lit("new").alias("status"))
    return dom.upsert(old, new, "domain", ["pages_crawled"])


@query("w3_latest_provenance", "SELECT image_id, source_page_url, discovered_at, id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, source_page_url ORDER BY discovered_at DESC, id DESC) AS k FROM v_provenance) WHERE k = 1")
def _(s, d):
    return dom.latest(v.provenance(s, d).select("image_id", "source_page_url", "discovered_at", "id"), ["image_id", "source_page_url"], "discovered_at")


@query("w4_deltas", "SELECT d.domain, pages_crawled + coalesce(p, 0)::BIGINT AS pages_crawled, images_stored + coalesce(i, 0)::BIGINT AS images_stored, (images_stored + coalesce(i, 0))::DOUBLE / nullif(pages_crawled + coalesce(p, 0), 0) AS image_yield_rate FROM v_domains d LEFT JOIN (SELECT domain, count(*) AS p, sum(images_downloaded) AS i FROM v_crawl_log WHERE crawl_type = 'refresh' GROUP BY 1) x USING (domain)")
def _(s, d):
    state = v.domains(s, d).select("domain", "pages_crawled", "images_stored")
    return dom.apply_deltas(state, v.crawl_log(s, d).filter("crawl_type = 'refresh'").select("domain", F.lit(1).alias("pages_crawled"), F.col("images_downloaded").alias("images_stored")))


@query("w11_guarded_deltas", "SELECT domain, pages_crawled + CASE WHEN claimed_by = 'worker-1' THEN 5 ELSE 0 END AS pages_crawled FROM v_domains")
def _(s, d):
    state = v.domains(s, d).select("domain", "claimed_by", "pages_crawled")
    return dom.apply_deltas(state, state.select("domain", F.lit(5).alias("pages_crawled")), guard=F.col("claimed_by") == "worker-1").select("domain", "pages_crawled")


@query("w5_store_outcomes", "WITH old AS (SELECT url, sha256 FROM v_images WHERE id % 2 = 0), a AS (SELECT id AS seq, CASE WHEN id % 5 = 0 THEN url || '?v=2' ELSE url END AS url, sha256 FROM v_images) SELECT seq, a.url, a.sha256, CASE WHEN o.sha256 = a.sha256 THEN 'deduplicated' WHEN o.sha256 IS NOT NULL THEN 'overwritten' WHEN a.sha256 IN (SELECT sha256 FROM old) OR row_number() OVER (PARTITION BY a.sha256 ORDER BY seq) > 1 THEN 'deduplicated' ELSE 'inserted' END AS outcome FROM a LEFT JOIN old o ON o.url = a.url")
def _(s, d):
    rows = v.images(s, d)
    arrivals = rows.select(F.col("id").alias("seq"), F.when(F.col("id") % 5 == 0, F.concat("url", F.lit("?v=2"))).otherwise(F.col("url")).alias("url"), "sha256")
    return images.store(rows.filter("id % 2 = 0"), arrivals).drop("image_url")


@query("x_exact_duplicates", "SELECT sha256, count(*) AS n, min(id) AS first_id FROM v_images GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return images.exact_duplicates(v.images(s, d))


PHASH = "WITH h AS (SELECT vec_id, list_reduce(list_prepend(0::BIGINT, list_transform(embedding[1:32], lambda x: (x > 0)::BIGINT)), lambda a, x: a * 2 + x) AS high, list_reduce(list_prepend(0::BIGINT, list_transform(embedding[33:64], lambda x: (x > 0)::BIGINT)), lambda a, x: a * 2 + x) AS low FROM embeddings) "


@query("f2_page_domains", "SELECT nullif(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '') AS domain, count(*) AS pages FROM pages GROUP BY 1")
def _(s, d):
    return frontier.domain_pages(v.table(s, d, "pages"))


@query("wn3_budget", "SELECT id, domain, row_number() OVER (PARTITION BY domain ORDER BY crawled_at, id) <= 5 AS follows FROM v_crawl_log")
def _(s, d):
    return frontier.budgeted(v.crawl_log(s, d), "domain", ["crawled_at", "id"], 5).select("id", "domain", "follows")


@query("wn2_capped_queue_1000", "SELECT id, domain FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY crawled_at, id) AS k FROM v_crawl_log) WHERE k <= 1000")
def _(s, d):
    """With the reference's cap."""
    return frontier.capped(v.crawl_log(s, d), "domain", ["crawled_at", "id"], EngineConf().frontier_cap).select("id", "domain")


@query("wn5_blocked_after", "SELECT id, errors_so_far::BIGINT AS errors_so_far, errors_so_far >= 3 AS blocked FROM (SELECT id, sum(coalesce(status IN (403, 429, 503), FALSE)::INTEGER) OVER (PARTITION BY domain ORDER BY crawled_at, id ROWS UNBOUNDED PRECEDING) AS errors_so_far FROM v_crawl_log)")
def _(s, d):
    return frontier.blocked_after(v.crawl_log(s, d), "domain", ["crawled_at", "id"]).select("id", "errors_so_far", "blocked")


@query("wn6_flush_batches", "SELECT id, (row_number() OVER (PARTITION BY domain ORDER BY crawled_at, id) - 1) // 4 AS batch FROM v_crawl_log")
def _(s, d):
    return frontier.flush_batches(v.crawl_log(s, d), "domain", ["crawled_at", "id"], 4).select("id", "batch")


@query("q1_checkpoint", "SELECT crawl_run_id AS checkpoint_id, page_url AS url, arg_max(id % 5, id)::INTEGER AS depth, TIMESTAMP '2024-03-02' AS expires_at FROM v_crawl_log GROUP BY 1, 2")
def _(s, d):
    return frontier.checkpoint(v.crawl_log(s, d).select(F.col("crawl_run_id").alias("checkpoint_id"), F.col("page_url").alias("url"), (F.col("id") % 5).cast("int").alias("depth"), F.col("id").alias("seq")), v.as_of())


@query("q4_queue_sizes", "SELECT domain, sum(CASE WHEN id % 3 = 0 THEN -1 ELSE 1 END)::BIGINT AS size FROM v_crawl_log GROUP BY 1")
def _(s, d):
    return frontier.queue_sizes(v.crawl_log(s, d).select("domain", F.when(F.col("id") % 3 == 0, -1).otherwise(1).alias("delta")), "domain")


@query("q6_first_seen", "SELECT page_url, arg_min(id, id) AS id FROM v_crawl_log GROUP BY 1")
def _(s, d):
    return frontier.first_seen(v.crawl_log(s, d).select("page_url", "id"), "page_url", "id")




EVERY_LINK = "l AS (SELECT DISTINCT regexp_replace(lower(domain), '^www\\.', '') AS src, 'd' || (id % 150) || '.example.com' AS dst FROM v_crawl_log)"


@query("q9_expand_all", f"WITH {EVERY_LINK}, z AS (SELECT DISTINCT domain AS url FROM v_domains WHERE seed_rank IS NOT NULL), o AS (SELECT DISTINCT dst AS url FROM z JOIN l ON src = url), t AS (SELECT DISTINCT dst AS url FROM o JOIN l ON src = url) SELECT url, min(depth) AS depth FROM (SELECT url, 0 AS depth FROM z UNION ALL SELECT url, 1 FROM o UNION ALL SELECT url, 2 FROM t) GROUP BY 1")
def _(s, d):
    """From every seed, by the links of every row."""
    links = v.crawl_log(s, d).select(exprs.fallback_canonical(F.col("domain")).alias("src"), F.concat(F.lit("d"), F.col("id") % 150, F.lit(".example.com")).alias("dst")).distinct()
    return frontier.expand(v.domains(s, d).filter("seed_rank is not null").select(F.col("domain").alias("url")), links, 2)


@query("f17_content_paths", "SELECT id, substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || sha256 AS path FROM v_images")
def _(s, d):
    return v.images(s, d).select("id", exprs.content_path(F.col("sha256")).alias("path"))
