"""Queries of the store's writers, claims, closing, queue, counters and pages; with those of queries.py they are all of the crawl half."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamark.functions import exprs, udfs
from seamark.operators import closing, frontier, images, pages, reports
from seamark.operators import domains as dom
from seamark.plans import views as v
from seamark.plans.queries import ASOF, MOVES, ORACLE_SQL, QUERIES, SCORED, query

__all__ = ["ORACLE_SQL", "QUERIES"]
RUN, WORKER = "run-2024-01-31", "worker-1"


# --- domains: release, reset, checkpoints, statistics

RELEASE_OK = f"coalesce(claimed_by = 'worker-' || (id % 2) AND version = expected AND status || '>' || new_status IN ({MOVES}), FALSE)"


@query("c3_release", f"SELECT domain, CASE WHEN ok THEN new_status ELSE status END AS status, CASE WHEN NOT ok THEN claimed_by END AS claimed_by, CASE WHEN NOT ok THEN claim_expires_at END AS claim_expires_at, version + ok::INTEGER AS version, CASE WHEN ok THEN {ASOF} ELSE last_crawled_at END AS last_crawled_at, pages_crawled + CASE WHEN ok THEN 10 ELSE 0 END AS pages_crawled, CASE WHEN ok THEN 0 ELSE consecutive_error_count END AS consecutive_error_count, ok AS applied FROM (SELECT *, {RELEASE_OK} AS ok FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 'active' ELSE 'exhausted' END AS new_status, version + (id % 7 = 0)::INTEGER AS expected FROM v_full))")
def _(s, d):
    domains = v.full_domains(s, d)
    n = F.col("id")
    asked = domains.select("id", F.concat(F.lit("worker-"), n % 2).alias("worker"), (F.col("version") + (n % 7 == 0).cast("int")).alias("expected_version"), F.when(n % 2 == 0, "active").otherwise("exhausted").alias("new_status"), F.lit(10).alias("pages_crawled_delta"), F.lit(0).alias("consecutive_error_count"))
    return dom.release(domains, asked, v.as_of()).select("domain", "status", "claimed_by", "claim_expires_at", "version", "last_crawled_at", "pages_crawled", "consecutive_error_count", "applied")


_ZERO = ", ".join(f"CASE WHEN id % 3 = 0 THEN 0 ELSE {c} END AS {c}" for c in dom.RESET_ZERO)
_NULL = ", ".join(f"CASE WHEN id % 3 <> 0 THEN {c} END AS {c}" for c in dom.RESET_NULL)


@query("w13_reset", f"SELECT domain, {_ZERO}, {_NULL}, CASE WHEN id % 3 = 0 THEN 'pending' ELSE status END AS status, version + (id % 3 = 0)::INTEGER AS version, due_at FROM v_full")
def _(s, d):
    return dom.reset(v.full_domains(s, d), F.col("id") % 3 == 0).select("domain", *dom.RESET_ZERO, *dom.RESET_NULL, "status", "version", "due_at")


@query("w4_update_stats", f"SELECT domain, pages_crawled + p AS pages_crawled, images_stored + i AS images_stored, (images_stored + i)::DOUBLE / nullif(pages_crawled + p, 0) AS image_yield_rate, CASE WHEN hit THEN {ASOF} ELSE last_crawled_at END AS last_crawled_at, CASE WHEN id % 2 = 0 THEN 'active' ELSE status END AS status, CASE WHEN id % 2 = 0 THEN 0 ELSE consecutive_error_count END AS consecutive_error_count, CASE WHEN id % 2 = 0 THEN 'run-9' ELSE last_crawl_run_id END AS last_crawl_run_id FROM (SELECT f.*, coalesce(x.p, 0) AS p, coalesce(x.i, 0) AS i, x.domain IS NOT NULL AS hit FROM v_full f LEFT JOIN (SELECT domain, count(*) AS p, sum(images_downloaded)::BIGINT AS i FROM v_crawl_log WHERE crawl_type = 'refresh' GROUP BY 1) x ON x.domain = f.domain)")
def _(s, d):
    domains = v.full_domains(s, d)
    deltas = v.crawl_log(s, d).filter("crawl_type = 'refresh'").select("domain", F.lit(1).alias("pages_crawled"), F.col("images_downloaded").alias("images_stored"))
    sets = domains.filter("id % 2 = 0").select("domain", F.lit("active").alias("status"), F.lit(0).alias("consecutive_error_count"), F.lit("run-9").alias("last_crawl_run_id"))
    return dom.update_stats(domains, deltas, v.as_of(), sets).select("domain", "pages_crawled", "images_stored", "image_yield_rate", "last_crawled_at", "status", "consecutive_error_count", "last_crawl_run_id")


@query("w11_increment_claimed", f"SELECT domain, pages_crawled + CASE WHEN ok THEN 5 ELSE 0 END AS pages_crawled, images_found + CASE WHEN ok THEN id ELSE 0 END AS images_found, CASE WHEN ok THEN {ASOF} ELSE last_crawled_at END AS last_crawled_at, CASE WHEN ok AND id % 2 = 0 THEN 'run-9' ELSE last_crawl_run_id END AS last_crawl_run_id, version, ok AS applied FROM (SELECT *, coalesce(claimed_by = 'worker-1', FALSE) AS ok FROM v_full)")
def _(s, d):
    domains = v.full_domains(s, d)
    deltas = domains.select("id", F.lit(WORKER).alias("worker"), F.when(F.col("id") % 2 == 0, "run-9").alias("crawl_run_id"), F.lit(5).alias("pages_crawled"), F.col("id").alias("images_found"))
    return dom.increment_claimed(domains, deltas, v.as_of()).select("domain", "pages_crawled", "images_found", "last_crawled_at", "last_crawl_run_id", "version", "applied")


@query("w12_checkpoint_marks", f"SELECT domain, CASE WHEN id % 4 = 0 THEN domain || ':{RUN}' WHEN id % 4 <> 1 THEN frontier_checkpoint_id END AS frontier_checkpoint_id, CASE id % 4 WHEN 0 THEN 7 WHEN 1 THEN 0 ELSE frontier_size END AS frontier_size, CASE WHEN id % 4 < 2 THEN {ASOF} END AS frontier_updated_at, CASE WHEN id % 4 = 0 THEN 'active' ELSE status END AS status FROM v_full")
def _(s, d):
    domains = v.full_domains(s, d)
    saved = domains.filter("id % 4 = 0").select("domain", exprs.checkpoint_id(F.col("domain"), F.lit(RUN)).alias("frontier_checkpoint_id"), F.lit(7).alias("frontier_size"))
    out = dom.clear_checkpoints(dom.set_checkpoints(domains, saved, v.as_of()), domains.filter("id % 4 = 1"), v.as_of())
    return out.select("domain", "frontier_checkpoint_id", "frontier_size", "frontier_updated_at", "status")


@query("w16_touched", f"SELECT domain, pages_crawled + (id % 4)::BIGINT AS pages_crawled, CASE WHEN id % 4 <> 0 THEN {ASOF} ELSE first_seen_at END AS updated_at FROM v_domains")
def _(s, d):
    old = v.domains(s, d).select("id", "domain", "pages_crawled", F.col("first_seen_at").alias("updated_at"))
    new = old.withColumn("pages_crawled", F.col("pages_crawled") + F.col("id") % 4)
    return dom.touched(old.drop("id"), new.drop("id"), "domain", v.as_of())


@query("j4_images_stored", r"SELECT d.domain, coalesce(n, images_stored)::BIGINT AS images_stored FROM v_domains d LEFT JOIN (SELECT regexp_replace(lower(source_domain), '^www\.', '') AS domain, sum(n) AS n FROM (SELECT source_domain, count(DISTINCT image_id) AS n FROM v_provenance WHERE image_id < 100 GROUP BY 1) GROUP BY 1) p ON p.domain = d.domain")
def _(s, d):
    return dom.with_images_stored(v.domains(s, d), v.provenance(s, d).filter("image_id < 100")).select("domain", "images_stored")


@query("o2_by_status", "SELECT domain, priority_score, pages_crawled, images_stored, claimed_by FROM v_full WHERE status = 'pending' ORDER BY priority_score DESC NULLS FIRST, last_crawled_at ASC NULLS FIRST, domain LIMIT 50")
def _(s, d):
    return dom.by_status(v.full_domains(s, d), "pending").select("domain", "priority_score", "pages_crawled", "images_stored", "claimed_by")


@query("o4_refresh_ext", f"SELECT domain, image_yield_rate FROM v_full WHERE status = 'exhausted' AND due_at < {ASOF} ORDER BY image_yield_rate DESC NULLS LAST, last_crawled_at ASC NULLS LAST, domain LIMIT 20")
def _(s, d):
    return dom.refresh_candidates(v.full_domains(s, d).withColumn("next_crawl_after", F.col("due_at")), v.as_of(), 20).select("domain", "image_yield_rate")


@query("o6_claims_of_worker", "SELECT id, domain, status, pages_crawled, claim_expires_at FROM v_full WHERE claimed_by = 'worker-1'")
def _(s, d):
    return dom.claims_of(v.full_domains(s, d), WORKER)


@query("o9_top_yield_ext", "SELECT domain, image_yield_rate FROM v_full ORDER BY image_yield_rate DESC NULLS LAST, domain LIMIT 20")
def _(s, d):
    return dom.top_by_yield(v.full_domains(s, d)).select("domain", "image_yield_rate")


@query("c6_force_release", "SELECT domain, CASE WHEN claimed_by <> 'worker-1' THEN claimed_by END AS claimed_by, CASE WHEN claimed_by <> 'worker-1' THEN claim_expires_at END AS claim_expires_at, version, coalesce(claimed_by = 'worker-1', FALSE) AS released FROM v_full")
def _(s, d):
    return dom.force_release(v.full_domains(s, d), F.coalesce(F.col("claimed_by") == WORKER, F.lit(False))).select("domain", "claimed_by", "claim_expires_at", "version", "released")


@query("c7_release_all", "SELECT domain, NULL::VARCHAR AS claimed_by, version, claimed_by IS NOT NULL AS released FROM v_full")
def _(s, d):
    return dom.force_release(v.full_domains(s, d), F.lit(True)).select("domain", "claimed_by", "version", "released")


@query("c9_updated_by_status", SCORED + "SELECT status, count(*) AS n FROM scored GROUP BY 1")
def _(s, d):
    return dom.scored(v.domains(s, d), v.as_of()).groupBy("status").agg(F.count("*").alias("n"))


@query("c9_recalculated", SCORED + f", r AS (SELECT domain, image_yield_rate, priority_score FROM scored) SELECT f.domain, CASE WHEN r.domain IS NULL THEN f.image_yield_rate ELSE r.image_yield_rate END AS image_yield_rate, coalesce(r.priority_score, f.priority_score) AS priority_score, CASE WHEN r.domain IS NOT NULL THEN {ASOF} END AS priority_computed_at FROM v_full f LEFT JOIN r ON r.domain = f.domain")
def _(s, d):
    domains = v.full_domains(s, d).withColumns({"error_rate": F.lit(None).cast("double"), "priority_computed_at": F.lit(None).cast("timestamp_ntz")})
    return dom.recalculated(domains, v.as_of()).select("domain", "image_yield_rate", "priority_score", "priority_computed_at")


@query("c12_cooldown_ext", f"SELECT domain, {ASOF} + to_days(CASE status WHEN 'unreachable' THEN 7 WHEN 'exhausted' THEN 14 WHEN 'blocked' THEN CASE block_reason_code WHEN 'login_required' THEN 30 WHEN 'rate_limited' THEN 7 WHEN 'forbidden' THEN 14 END END) AS next_crawl_after FROM v_full")
def _(s, d):
    return v.full_domains(s, d).select("domain", exprs.next_crawl_after(F.col("status"), F.col("block_reason_code"), v.as_of()).alias("next_crawl_after"))


@query("p15_workable", "SELECT domain, status FROM v_full WHERE status NOT IN ('blocked', 'unreachable') AND domain LIKE 'd1%'")
def _(s, d):
    return v.full_domains(s, d).filter(~F.col("status").isin("blocked", "unreachable") & F.col("domain").startswith("d1")).select("domain", "status")


@query("p16_recent_progress", "SELECT domain, claimed_by, last_crawled_at FROM v_full WHERE claimed_by IS NOT NULL AND last_crawled_at >= TIMESTAMP '2024-02-01' - INTERVAL 4000 MINUTE")
def _(s, d):
    return reports.recent_progress(v.full_domains(s, d), v.as_of(), 4000).select("domain", "claimed_by", "last_crawled_at")


# --- runs and their end


@query("c8_cleanup_stale", f"WITH a AS (SELECT crawl_run_id, max(crawled_at) AS last_at FROM v_crawl_log GROUP BY 1), x AS (SELECT r.*, r.status = 'running' AND coalesce(last_at, started_at) < {ASOF} - INTERVAL 60 MINUTE AS stale FROM v_runs r LEFT JOIN a USING (crawl_run_id)) SELECT crawl_run_id AS id, CASE WHEN stale THEN 'failed' ELSE status END AS status, CASE WHEN stale THEN {ASOF} END AS completed_at, CASE WHEN stale THEN '{closing.STALE}' END AS error_message FROM x")
def _(s, d):
    runs = v.runs(s, d)
    stale = reports.stale_runs(runs, v.crawl_log(s, d), v.as_of())
    state = runs.select(F.col("crawl_run_id").alias("id"), "status", F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.lit(None).cast("string").alias("error_message"))
    return closing.failed_stale(state, stale, v.as_of())


@query("w9_closed_runs", f"SELECT r.crawl_run_id AS id, CASE WHEN r.status <> 'running' THEN 'running' WHEN r.pages % 2 = 0 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN r.status = 'running' THEN r.pages ELSE 0 END AS pages_crawled, CASE WHEN r.status = 'running' THEN n ELSE 0 END AS images_downloaded, CASE WHEN r.status = 'running' THEN {ASOF} END AS completed_at FROM v_runs r JOIN (SELECT crawl_run_id, coalesce(sum(images_downloaded), 0)::BIGINT AS n FROM v_crawl_log GROUP BY 1) USING (crawl_run_id)")
def _(s, d):
    runs = v.runs(s, d)
    zero = F.lit(0).cast("long")
    opened = runs.select(F.col("crawl_run_id").alias("id"), F.lit("running").alias("status"), zero.alias("pages_crawled"), zero.alias("images_found"), zero.alias("images_downloaded"), F.lit(None).cast("timestamp_ntz").alias("completed_at"))
    ends = runs.filter("status = 'running'").select(F.col("crawl_run_id").alias("id"), F.when(F.col("pages") % 2 == 0, "finished").otherwise("shutdown").alias("reason"), F.col("pages").alias("pages_crawled"), zero.alias("images_found"))
    return closing.closed_runs(opened, ends, v.crawl_log(s, d), v.as_of()).select("id", "status", "pages_crawled", "images_downloaded", "completed_at")


@query("w10_bumped_runs", "SELECT crawl_run_id AS id, (pages + n)::BIGINT AS pages_crawled, f::BIGINT AS images_found FROM v_runs JOIN (SELECT crawl_run_id, count(*) FILTER (status < 400) AS n, sum(images_found) FILTER (status < 400) AS f FROM v_crawl_log GROUP BY 1) USING (crawl_run_id)")
def _(s, d):
    runs = v.runs(s, d).select(F.col("crawl_run_id").alias("id"), F.col("pages").alias("pages_crawled"), F.lit(0).cast("long").alias("images_found"))
    return closing.bumped_runs(runs, v.crawl_log(s, d).filter("status < 400").select(F.col("crawl_run_id").alias("id"), F.lit(1).alias("pages_crawled"), "images_found"))


@query("w8_page_log", f"SELECT page_url, domain, {ASOF} AS crawled_at, status, images_found, 0 AS images_downloaded, CASE WHEN status >= 400 THEN 'HTTP ' || status END AS error_message, 'discovery' AS crawl_type, '{RUN}' AS crawl_run_id FROM v_crawl_log WHERE status IS NOT NULL")
def _(s, d):
    log = v.crawl_log(s, d)
    done = log.select(F.col("page_url").alias("url"), "domain", "status", "images_found", F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), "status")).alias("error_message"), F.when(F.col("status").isNull(), "not_html").when(F.col("status") >= 400, "failed").otherwise("parsed").alias("outcome"))
    return closing.page_log(done, RUN, v.as_of()).drop("id")


@query("a21_stored_of_run", rf"SELECT regexp_replace(lower(domain), '^www\.', '') AS domain, coalesce(sum(images_downloaded), 0)::BIGINT AS images_stored FROM v_crawl_log WHERE crawl_run_id = 'run-2024-01-15' GROUP BY 1")
def _(s, d):
    return closing.images_stored_of_run(v.crawl_log(s, d), "run-2024-01-15")


@query("j8_remainders", "SELECT domain, all_pages, all_errors, pages, images_found, errors, links_discovered FROM v_left")
def _(s, d):
    return closing.remainders(v.close_stats(s, d), v.close_flushed(s, d))


_CLAIM = "SELECT f.*, l.pages AS p, l.images_found AS fi, l.errors AS er, l.links_discovered AS ln, CASE WHEN f.id % 8 = 0 THEN 0 ELSE f.id % 5 END AS size, f.id % 10 = 5 AS is_blocked, f.version - f.id % 4 AS claimed_version FROM v_full f JOIN v_left l USING (domain) WHERE claimed_by = 'worker-1'"


@query("c10_release_all", f"WITH c AS ({_CLAIM}), x AS (SELECT *, CASE WHEN is_blocked THEN 'blocked' WHEN size > 0 THEN 'active' ELSE 'exhausted' END AS new_status, version - claimed_version < 3 AS met FROM c), y AS (SELECT *, met AND status || '>' || new_status IN ({MOVES}) AS ok FROM x) SELECT domain, CASE WHEN ok THEN new_status ELSE status END AS status, CASE WHEN NOT ok THEN claimed_by END AS claimed_by, version + ok::INTEGER AS version, pages_crawled + CASE WHEN ok THEN p ELSE 0 END AS pages_crawled, pages_discovered + CASE WHEN ok THEN p + ln ELSE 0 END AS pages_discovered, CASE WHEN NOT ok THEN consecutive_error_count WHEN p > 0 THEN 0 ELSE er END::INTEGER AS consecutive_error_count, CASE WHEN ok AND new_status = 'active' THEN domain || ':{RUN}' ELSE frontier_checkpoint_id END AS frontier_checkpoint_id, (CASE WHEN ok AND new_status = 'active' THEN size ELSE frontier_size END)::INTEGER AS frontier_size, ok AS applied FROM y")
def _(s, d):
    domains = v.full_domains(s, d)
    mine = domains.filter(F.col("claimed_by") == WORKER)
    n = F.col("id")
    claims = mine.select("id", "domain", (F.col("version") - n % 4).alias("version"), F.col("version").alias("now"))
    queues = mine.select("domain", F.when(n % 8 == 0, 0).otherwise(n % 5).alias("size"))
    stored = mine.select("domain", F.lit(0).cast("long").alias("images_stored"))
    asked = closing.release_requests(claims, v.close_stats(s, d), v.close_flushed(s, d), stored, queues, mine.filter(n % 10 == 5), RUN, WORKER)
    out = closing.release_all(mine, asked, v.as_of())
    return out.select("domain", "status", "claimed_by", "version", "pages_crawled", "pages_discovered", "consecutive_error_count", "frontier_checkpoint_id", "frontier_size", "applied")


@query("c11_unreleased_updates", "SELECT l.domain, l.pages AS pages_crawled, l.pages + l.links_discovered AS pages_discovered, l.images_found, 0::BIGINT AS images_stored, l.errors AS total_error_count, CASE WHEN l.pages > 0 THEN 0 ELSE l.errors END AS consecutive_error_count, CASE WHEN f.id % 7 = 0 THEN 'blocked' WHEN all_pages = 0 AND all_errors > 0 THEN 'unreachable' WHEN all_pages = 0 THEN 'pending' ELSE 'active' END AS status FROM v_left l JOIN v_full f USING (domain) WHERE claimed_by IS DISTINCT FROM 'worker-1'")
def _(s, d):
    domains = v.full_domains(s, d)
    stored = domains.select("domain", F.lit(0).cast("long").alias("images_stored"))
    return closing.unreleased_updates(v.close_stats(s, d), v.close_flushed(s, d), stored, domains.filter(F.col("claimed_by") == WORKER), domains.filter("id % 7 = 0"))


@query("x2_unreleased", "SELECT domain FROM v_full WHERE claimed_by IS DISTINCT FROM 'worker-1'")
def _(s, d):
    return closing.unreleased(v.close_stats(s, d), v.full_domains(s, d).filter(F.col("claimed_by") == WORKER))


@query("wn6_flush_due", "SELECT domain, pages, images_found FROM v_left WHERE pages >= 20")
def _(s, d):
    return closing.flush_due(v.close_stats(s, d), v.close_flushed(s, d), 20).select("domain", "pages", "images_found")


_QUEUE = r"q AS (SELECT regexp_replace(lower(domain), '^www\.', '') AS domain, page_url AS url, (id % 5)::INTEGER AS depth, id AS seq FROM v_crawl_log WHERE status >= 400)"


def _queue(s, d):
    return v.crawl_log(s, d).filter("status >= 400").select(exprs.fallback_canonical(F.col("domain")).alias("domain"), F.col("page_url").alias("url"), (F.col("id") % 5).cast("int").alias("depth"), F.col("id").alias("seq"))


@query("q10_close_checkpoints", f"WITH {_QUEUE} SELECT domain || ':{RUN}' AS checkpoint_id, url, arg_max(depth, seq) AS depth, TIMESTAMP '2024-03-02' AS expires_at FROM q WHERE domain IN (SELECT domain FROM v_domains WHERE pages_crawled >= 60) GROUP BY 1, 2")
def _(s, d):
    return closing.close_checkpoints(_queue(s, d), v.domains(s, d).select("domain", F.col("pages_crawled").alias("pages")), RUN, v.as_of(), 60)[0]


@query("q10_close_marks", f"WITH {_QUEUE} SELECT domain, domain || ':{RUN}' AS frontier_checkpoint_id, count(*)::INTEGER AS frontier_size FROM q WHERE domain IN (SELECT domain FROM v_domains WHERE pages_crawled >= 60) GROUP BY 1")
def _(s, d):
    return closing.close_checkpoints(_queue(s, d), v.domains(s, d).select("domain", F.col("pages_crawled").alias("pages")), RUN, v.as_of(), 60)[1]


# --- queues


_SAVED = "f AS (SELECT crawl_run_id AS checkpoint_id, page_url AS url, arg_max(id % 5, id)::INTEGER AS depth FROM v_crawl_log GROUP BY 1, 2)"


def _saved(s, d):
    return frontier.checkpoint(v.crawl_log(s, d).select(F.col("crawl_run_id").alias("checkpoint_id"), F.col("page_url").alias("url"), (F.col("id") % 5).cast("int").alias("depth"), F.col("id").alias("seq")), v.as_of())


@query("q2_checkpoint_load", f"WITH {_SAVED} SELECT url, depth FROM f WHERE checkpoint_id = 'run-2024-01-15'")
def _(s, d):
    return frontier.loaded(_saved(s, d), "run-2024-01-15", v.as_of())


@query("q2_checkpoint_sizes", f"WITH {_SAVED} SELECT checkpoint_id, count(*) AS size FROM f WHERE checkpoint_id <> 'run-2024-01-15' GROUP BY 1")
def _(s, d):
    gone = s.createDataFrame([("run-2024-01-15",)], "checkpoint_id string")
    return frontier.checkpoint_sizes(frontier.without_checkpoints(_saved(s, d), gone), v.as_of())


@query("q3_dequeued", f"WITH {_QUEUE} SELECT domain, url, depth, seq FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seq) AS k FROM q) WHERE k <= 3")
def _(s, d):
    return frontier.dequeued(_queue(s, d), "domain", ["seq"], 3)[0]


@query("q3_queue_left", f"WITH {_QUEUE} SELECT v.domain, count(k) AS size, CASE WHEN count(k) > 0 THEN 'active' ELSE 'exhausted' END AS queue FROM v_domains v LEFT JOIN (SELECT domain, k FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seq) AS k FROM q) WHERE k > 3) q2 ON q2.domain = v.domain GROUP BY 1")
def _(s, d):
    return frontier.queue_status(frontier.dequeued(_queue(s, d), "domain", ["seq"], 3)[1], v.domains(s, d))


_ASKED = "a AS (SELECT id AS seq, page_url AS url, (id % 4)::INTEGER AS priority, id % 50 = 0 AS free, crawl_type, regexp_extract(page_url, '://([^/]*)', 1) AS domain FROM v_crawl_log), s AS (SELECT DISTINCT url FROM a WHERE seq % 11 = 0), k AS (SELECT * FROM a WHERE free OR seq IN (SELECT min(seq) FROM a WHERE NOT free AND url NOT IN (SELECT url FROM s) GROUP BY url))"


def _scheduled(s, d):
    log = v.crawl_log(s, d)
    asked = log.select(F.col("id").alias("seq"), F.col("page_url").alias("url"), (F.col("id") % 4).cast("int").alias("priority"), (F.col("id") % 50 == 0).alias("dont_filter"), "crawl_type")
    seen = log.filter("id % 11 = 0").select(exprs.fingerprint(F.col("page_url")).alias("fingerprint")).distinct()
    return frontier.scheduled(asked, seen)


@query("q5_scheduled", f"WITH {_ASKED} SELECT seq, url, domain, priority - CASE WHEN crawl_type = 'refresh' THEN 10 ELSE 0 END AS priority FROM k")
def _(s, d):
    return _scheduled(s, d).select("seq", "url", "domain", "priority")


@query("q4_popped", f"WITH {_ASKED} SELECT seq, url FROM k ORDER BY priority - CASE WHEN crawl_type = 'refresh' THEN 10 ELSE 0 END DESC, seq LIMIT 100")
def _(s, d):
    return frontier.popped(_scheduled(s, d), 100)[0].select("seq", "url")


@query("q7_fingerprints", f"WITH {_ASKED} SELECT count(*) AS fingerprints FROM (SELECT url FROM s UNION SELECT url FROM k WHERE NOT free)")
def _(s, d):
    seen = v.crawl_log(s, d).filter("id % 11 = 0").select(exprs.fingerprint(F.col("page_url")).alias("fingerprint")).distinct()
    return frontier.remembered(seen, _scheduled(s, d)).agg(F.count("*").alias("fingerprints"))


@query("a26_queue_status", f"WITH {_ASKED}, u AS (SELECT DISTINCT domain FROM v_domains WHERE seed_rank IS NOT NULL) SELECT (SELECT count(*) FROM u) AS start_urls, (SELECT count(*) FROM k) AS requests, (SELECT count(*) FROM u) AS domains_seen, (SELECT count(DISTINCT domain) FROM k) AS pending_domains")
def _(s, d):
    urls = v.domains(s, d).filter("seed_rank is not null").select(F.concat(F.lit("https://"), "domain").alias("url"), F.col("domain").alias("domain_key"))
    return frontier.queue_report(urls, _scheduled(s, d), urls)


@query("s6_start_order", "SELECT 'https://' || domain AS url, (-seed_rank)::BIGINT AS priority FROM v_domains WHERE seed_rank IS NOT NULL")
def _(s, d):
    from seamark.sources.seeds import start_order

    return start_order(v.domains(s, d).filter("seed_rank is not null").select(F.concat(F.lit("https://"), "domain").alias("url"), (-F.col("seed_rank")).cast("long").alias("priority")))


@query("wn3_global_budget", "SELECT id, row_number() OVER (ORDER BY crawled_at, id) < 500 AS follows FROM v_crawl_log")
def _(s, d):
    return frontier.globally_budgeted(v.crawl_log(s, d), "id", ["crawled_at", "id"], 500).select("id", "follows")


@query("p1_allowed", "SELECT id, netloc AS domain FROM (SELECT id, regexp_extract(lower(page_url), '://([^/]*)', 1) AS netloc FROM v_crawl_log) WHERE netloc IN (SELECT domain FROM v_domains WHERE id % 2 = 0) AND netloc NOT IN (SELECT domain FROM v_domains WHERE id % 3 = 0)")
def _(s, d):
    from seamark.sources.seeds import filtered

    urls = v.crawl_log(s, d).select("id", exprs.netloc(F.col("page_url")).alias("domain"))
    names = v.domains(s, d).select("id", "domain")
    return filtered(urls, names.filter("id % 2 = 0"), names.filter("id % 3 = 0")).select("id", "domain")


# --- images and counters


_SLOTS = "u AS (SELECT doc_id AS id, doc_id // 8 AS g, (doc_id * 5 % 3)::INTEGER AS slot, 'h' || (doc_id // 8) || '-' || (doc_id * 7 % 4) AS sha, doc_id % 8 AS k FROM documents WHERE doc_id >= 0), i AS (SELECT g, [max(CASE WHEN id % 16 = 1 AND slot = 0 THEN sha END), max(CASE WHEN id % 16 = 1 AND slot = 1 THEN sha END), max(CASE WHEN id % 16 = 1 AND slot = 2 THEN sha END)] AS st FROM u GROUP BY g)"
_STEP = "CASE WHEN f.st[u.slot + 1] = u.sha THEN 'deduplicated' WHEN f.st[u.slot + 1] IS NOT NULL THEN 'overwritten' WHEN list_contains(f.st, u.sha) THEN 'deduplicated' ELSE 'inserted' END"


@query("w5_store_repeats", f"WITH RECURSIVE {_SLOTS}, f AS (SELECT g, -1 AS k, st, NULL::BIGINT AS id, NULL::VARCHAR AS outcome, NULL::VARCHAR AS sha FROM i UNION ALL SELECT f.g, f.k + 1, CASE WHEN u.id IS NOT NULL AND {_STEP} IN ('overwritten', 'inserted') THEN list_transform([1, 2, 3], lambda j: CASE WHEN j = u.slot + 1 THEN u.sha ELSE f.st[j] END) ELSE f.st END, u.id, CASE WHEN u.id IS NOT NULL THEN {_STEP} END, u.sha FROM f LEFT JOIN u ON u.g = f.g AND u.k = f.k + 1 WHERE f.k < 7) SELECT id AS seq, outcome, sha AS sha256 FROM f WHERE id IS NOT NULL")
def _(s, d):
    """Arrivals that come back to urls and hashes, eight to a group."""
    n = F.col("doc_id")
    group = F.floor(n / 8)
    rows = v.table(s, d, "documents").filter("doc_id >= 0").select(n.alias("seq"), F.concat_ws("-", F.lit("u"), group, n * 5 % 3).alias("url"), F.concat(F.lit("h"), group, F.lit("-"), n * 7 % 4).alias("sha256"))
    held = rows.filter("seq % 16 = 1").groupBy("url").agg(F.max("sha256").alias("sha256"))
    return images.store(held, rows).select("seq", "outcome", "sha256")


@query("w6_ensured_provenance", f"WITH n AS (SELECT DISTINCT image_id, source_page_url, source_domain FROM v_provenance WHERE id % 3 = 0 AND image_id < 150), o AS (SELECT image_id, source_page_url, min(source_domain) AS source_domain, max(discovered_at) AS discovered_at FROM v_provenance WHERE id % 2 = 0 GROUP BY 1, 2) SELECT coalesce(o.image_id, n.image_id) AS image_id, coalesce(o.source_page_url, n.source_page_url) AS source_page_url, CASE WHEN n.image_id IS NOT NULL THEN {ASOF} ELSE discovered_at END AS discovered_at, CASE WHEN n.image_id IS NOT NULL THEN 'refresh' ELSE 'discovery' END AS discovery_type FROM o FULL JOIN (SELECT DISTINCT image_id, source_page_url FROM n) n ON n.image_id = o.image_id AND n.source_page_url = o.source_page_url")
def _(s, d):
    p = v.provenance(s, d)
    held = p.filter("id % 2 = 0").groupBy("image_id", "source_page_url").agg(F.min("source_domain").alias("source_domain"), F.max("discovered_at").alias("discovered_at")).withColumn("discovery_type", F.lit("discovery"))
    links = p.filter("id % 3 = 0").select("image_id", "source_page_url", "source_domain", F.lit("refresh").alias("discovery_type"))
    return images.ensured(held, s.range(150), links, v.as_of()).select("image_id", "source_page_url", "discovered_at", "discovery_type")


@query("w7_bumped_log", "SELECT l.id, images_downloaded + coalesce(n, 0)::INTEGER AS images_downloaded FROM v_crawl_log l LEFT JOIN (SELECT page_url, crawl_run_id, count(*) AS n FROM v_crawl_log WHERE id % 3 = 0 GROUP BY 1, 2) USING (page_url, crawl_run_id)")
def _(s, d):
    log = v.crawl_log(s, d)
    return images.bumped_log(log, log.filter("id % 3 = 0").select("page_url", "crawl_run_id")).select("id", "images_downloaded")


@query("p14_skipped", "SELECT id, id % 4 <> 0 AND id % 3 = 0 AND id % 5 <> 0 AS skipped FROM v_images")
def _(s, d):
    rows = v.images(s, d).select("id", "url", F.when(F.col("id") % 4 == 0, "refresh").otherwise("discovery").alias("crawl_type"))
    held = rows.filter("id % 3 = 0").select("url", F.when(F.col("id") % 5 == 0, v.as_of() - F.make_dt_interval(F.lit(40))).otherwise(v.as_of()).alias("last_seen_at"))
    return images.skipped(rows, held, v.as_of(), 30).select("id", "skipped")


@query("p13_due", "SELECT id, id % 3 = 0 AND id % 5 = 0 AS due FROM v_images")
def _(s, d):
    seen = F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 5 == 0, v.as_of() - F.make_dt_interval(F.lit(40))).otherwise(v.as_of()))
    rows = v.images(s, d).select("id", seen.alias("last_seen_at"))
    return rows.select("id", images.due(rows, v.as_of(), 30).alias("due"))


REJECTED = "CASE WHEN error_message IS NULL THEN 'unknown' WHEN lower(trim(split_part(error_message, ':', 1))) IN (REASONS) THEN lower(trim(split_part(error_message, ':', 1))) WHEN lower(error_message) LIKE '%content type%' OR lower(error_message) LIKE '%content-type%' THEN 'unsupported_content_type' WHEN lower(error_message) LIKE '%too small%' AND lower(error_message) LIKE '%dimension%' THEN 'image_dimensions_too_small' WHEN lower(error_message) LIKE '%too small%' THEN 'file_too_small' WHEN lower(error_message) LIKE '%too large%' THEN 'file_too_large' WHEN lower(error_message) LIKE '%http%' OR lower(error_message) LIKE '%status%' THEN 'http_error' ELSE 'unknown' END".replace("REASONS", ", ".join(f"'{r}'" for r in exprs.REASONS))
_COUNTERS = ", ".join(f"('{c}')" for c in (*exprs.REASONS, "unknown"))


@query("a23_counters", f"WITH t AS (SELECT count(*) AS a, count(*) FILTER (outcome IN ('inserted', 'overwritten')) AS b, count(*) FILTER (outcome = 'deduplicated') AS c, count(*) FILTER (outcome = 'skipped') AS e, count(*) FILTER (outcome = 'failed') AS f, coalesce(sum(file_size) FILTER (outcome IN ('inserted', 'overwritten')), 0)::BIGINT AS g FROM v_items) SELECT 'images_received' AS counter, a AS n FROM t UNION ALL SELECT 'images_downloaded', b FROM t UNION ALL SELECT 'images_deduplicated', c FROM t UNION ALL SELECT 'images_skipped', e FROM t UNION ALL SELECT 'images_failed', f FROM t UNION ALL SELECT 'total_bytes_downloaded', g FROM t UNION ALL SELECT r, coalesce(n, 0) FROM (VALUES {_COUNTERS}) x(r) LEFT JOIN (SELECT {REJECTED} AS why, count(*) AS n FROM v_items WHERE outcome = 'failed' GROUP BY 1) y ON why = r")
def _(s, d):
    return images.pipeline_counters(v.items(s, d))


@query("f9_rejections", f"SELECT id, {REJECTED} AS counter FROM v_items WHERE outcome = 'failed'")
def _(s, d):
    return v.items(s, d).filter("outcome = 'failed'").select("id", exprs.rejection_class(F.col("error_message")).alias("counter"))


@query("a25_statistics", "WITH p AS (SELECT *, CASE WHEN status >= 400 OR status IS NULL THEN 'failed' END AS message FROM v_crawl_log), a AS (SELECT round((epoch_us(max(crawled_at)) - epoch_us(min(crawled_at))) / 1e6, 2) AS duration_seconds, count(*) FILTER (message IS NULL) AS pages_crawled, count(*) FILTER (message IS NOT NULL) AS pages_failed, coalesce(sum(images_found) FILTER (message IS NULL), 0)::BIGINT AS images_discovered FROM p), b AS (SELECT count(*) FILTER (outcome IN ('inserted', 'overwritten')) AS images_downloaded, count(*) FILTER (outcome = 'skipped') AS images_skipped, count(*) FILTER (outcome = 'failed') AS images_failed, count(*) FILTER (outcome = 'deduplicated') AS images_deduplicated, coalesce(sum(file_size) FILTER (outcome IN ('inserted', 'overwritten')), 0)::BIGINT AS total_bytes FROM v_items) SELECT *, pages_failed + images_failed AS error_count FROM a, b")
def _(s, d):
    log = v.crawl_log(s, d).withColumn("error_message", F.when((F.col("status") >= 400) | F.col("status").isNull(), "failed"))
    return reports.crawl_statistics(log, v.items(s, d))


@query("a27_backfill_coverage", "SELECT (SELECT count(DISTINCT domain) FROM v_crawl_log) AS crawl_log_domains, (SELECT count(*) FROM v_full WHERE source LIKE 'backfill%') AS backfilled_domains, (SELECT count(*) FROM v_full) AS total_domains")
def _(s, d):
    return reports.backfill_coverage(v.crawl_log(s, d), v.full_domains(s, d))


@query("a27_yield_by_status", "SELECT status, count(*) AS domain_count, avg(image_yield_rate) AS avg_yield, avg(pages_crawled) AS avg_pages FROM v_full WHERE source LIKE 'backfill%' GROUP BY 1")
def _(s, d):
    out = reports.yield_by_status(v.full_domains(s, d))
    return out.withColumn("avg_yield", F.round("avg_yield", 9))


ORACLE_SQL["a27_yield_by_status"] = ORACLE_SQL["a27_yield_by_status"].replace("avg(image_yield_rate) AS avg_yield", "round(avg(image_yield_rate), 9) AS avg_yield")


@query("a13_summary_totals", "WITH s AS (SELECT status, count(*) AS domains, round(avg(pages_crawled))::INTEGER AS avg_pages, sum(images_stored)::BIGINT AS total_images FROM v_full GROUP BY 1) SELECT * FROM s UNION ALL SELECT 'TOTAL', sum(domains)::BIGINT, NULL, sum(total_images)::BIGINT FROM s")
def _(s, d):
    return reports.summary_totals(v.full_domains(s, d))


@query("a9_hash_coverage", "SELECT count(*) AS total, count(CASE WHEN id % 9 <> 0 THEN 1 END) AS phash_count, 100.0::DOUBLE * count(CASE WHEN id % 9 <> 0 THEN 1 END) / count(*) AS phash_pct, count(CASE WHEN id % 4 = 0 THEN 1 END) AS dhash_count, 100.0::DOUBLE * count(CASE WHEN id % 4 = 0 THEN 1 END) / count(*) AS dhash_pct FROM v_images")
def _(s, d):
    part = lambda lo: F.substring("sha256", lo, 16)
    return reports.hash_coverage(v.images(s, d).select(F.when(F.col("id") % 9 != 0, part(1)).alias("phash_hash"), F.when(F.col("id") % 4 == 0, part(17)).alias("dhash_hash")))


_HALVES = "h AS (SELECT vec_id + c * 1000000 AS vec_id, high, CASE WHEN c = 1 THEN xor(low, 5 + (vec_id % 3) * 65536) ELSE low END AS low FROM (SELECT vec_id, list_reduce(list_prepend(0::BIGINT, list_transform(embedding[1:32], lambda x: (x > 0)::BIGINT)), lambda a, x: a * 2 + x) AS high, list_reduce(list_prepend(0::BIGINT, list_transform(embedding[33:64], lambda x: (x > 0)::BIGINT)), lambda a, x: a * 2 + x) AS low FROM embeddings), (VALUES (0), (1)) t(c))"


@query("j9_near_images_ext", f"WITH {_HALVES} SELECT a.vec_id AS a, b.vec_id AS b, (bit_count(xor(a.high, b.high)) + bit_count(xor(a.low, b.low)))::INTEGER AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.high, b.high)) + bit_count(xor(a.low, b.low)) <= 10")
def _(s, d):
    """Sign bits of the embeddings stand for hashes; every row also comes with two to four bits changed."""
    h = images.hash_halves(v.table(s, d, "embeddings"))
    near = h.select((F.col("vec_id") + 1_000_000).alias("vec_id"), "high", F.col("low").bitwiseXOR(F.lit(5) + F.col("vec_id") % 3 * 65_536).alias("low"))
    return images.near_duplicates(h.unionByName(near))


# --- pages and scalar rules


_REFS = "l AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS root, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?href=\"([^\"]*)\"', 1)) AS link, generate_subscripts(regexp_extract_all(html, '(?i)<a\\b[^>]*?href=\"([^\"]*)\"', 1), 1) - 1 AS ordinal FROM pages)"
_FOLLOWED = "link LIKE '/%' AND NOT regexp_matches(lower(link), '\\.(pdf|zip|jpg|jpeg|png|gif|webp)$')"


@query("h2_links", f"WITH {_REFS} SELECT page_id, ordinal::INTEGER AS ordinal, root || link AS target FROM l WHERE {_FOLLOWED}")
def _(s, d):
    return pages.followed_links(pages.references(v.table(s, d, "pages")))


@query("h3_page_outcomes", f"WITH {_REFS}, b AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS domain FROM pages WHERE page_id % 50 = 7), o AS (SELECT page_id, CASE WHEN regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) IN (SELECT domain FROM b) THEN 'blocked_domain' WHEN page_id % 9 = 4 THEN 'not_html' WHEN regexp_matches(lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), 'login|sign in') OR regexp_matches(html, '(?i)<input[^>]*type=\"?password') THEN 'login_blocked' ELSE 'parsed' END AS outcome FROM pages) SELECT page_id, outcome, 0::BIGINT AS images, CASE WHEN outcome = 'parsed' THEN coalesce(n, 0) ELSE 0 END AS links FROM o LEFT JOIN (SELECT page_id, count(*) AS n FROM l WHERE {_FOLLOWED} GROUP BY 1) USING (page_id)")
def _(s, d):
    """Pages of some domains are blocked, and some come with a type that is no page."""
    rows = v.table(s, d, "pages").withColumn("content_type", F.when(F.col("page_id") % 9 == 4, "application/pdf").when(F.col("page_id") % 2 == 0, "text/html; charset=utf-8"))
    blocked = rows.filter("page_id % 50 = 7").select(exprs.netloc(F.col("url")).alias("domain"))
    return pages.outcomes(rows, blocked)


@query("f1_canonical", r"SELECT id, regexp_replace(lower(regexp_replace(domain, ':443$', '')), '^www\.', '') AS canonical, 'example.com' AS registrable FROM (SELECT id, domain || CASE WHEN id % 2 = 0 THEN ':443' ELSE '' END AS domain FROM v_crawl_log)")
def _(s, d):
    url = F.concat(F.lit("https://"), "domain", F.when(F.col("id") % 2 == 0, ":443").otherwise(""), F.lit("/p?q=1"))
    return v.crawl_log(s, d).select("id", udfs.canonical_domain(url).alias("canonical"), udfs.canonical_domain(url, strip_subdomains=True).alias("registrable"))


@query("f15_fingerprints", "SELECT id, sha256('GET https://' || lower(domain) || '/p?a=' || (id % 3) || '&b=' || (id % 5)) AS fingerprint FROM v_crawl_log")
def _(s, d):
    n = F.col("id")
    return v.crawl_log(s, d).select("id", exprs.fingerprint(F.concat(F.lit("HTTPS://"), "domain", F.lit("/p?b="), n % 5, F.lit("&a="), n % 3, F.lit("#top"))).alias("fingerprint"))


@query("f21_seed_keys", "SELECT id, 'www.' || domain || '/x' AS key FROM v_domains")
def _(s, d):
    return v.domains(s, d).select("id", exprs.seed_key(F.concat(F.lit("http://www."), "domain", F.lit("/x//"))).alias("key"))


@query("f22_keys", "SELECT id, 'prod:' || domain || ':requests' AS key, domain || ':run-1' AS checkpoint FROM v_domains")
def _(s, d):
    return v.domains(s, d).select("id", exprs.namespaced(F.concat("domain", F.lit(":requests")), "prod").alias("key"), exprs.checkpoint_id(F.col("domain"), F.lit("run-1")).alias("checkpoint"))


@query("f24_log_records", """SELECT id, '{"timestamp":"' || strftime(crawled_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","level":"INFO","logger":"crawl","message":"' || page_url || '","images":' || images_found || '}' AS record FROM v_crawl_log""")
def _(s, d):
    return v.crawl_log(s, d).select("id", exprs.log_record(F.lit("INFO"), F.lit("crawl"), F.col("page_url"), F.col("crawled_at"), images=F.col("images_found")).alias("record"))


@query("p5_image_endings", "SELECT id, regexp_matches(lower(target), '\\.(jpg|jpeg|png|webp)$') AS whole, NOT regexp_matches(target, 'svg') AS accepted FROM (SELECT id, page_url || ['.jpg', '.PNG?x=1', '/a?file=b.webp', '.svg?v=1'][(id % 4 + 1)::INTEGER] AS target FROM v_crawl_log)")
def _(s, d):
    target = F.concat("page_url", F.element_at(F.array(*map(F.lit, (".jpg", ".PNG?x=1", "/a?file=b.webp", ".svg?v=1"))), (F.col("id") % 4 + 1).cast("int")))
    return v.crawl_log(s, d).select("id", exprs.ends_like_image(target).alias("whole"), (exprs.image_url(target) | target.contains(".PNG?")).alias("accepted"))


_TYPES = ("image/jpeg; q=1", "IMAGE/PNG", "image/svg+xml", "image/gif", "text/html", "")


@query("p6_types", "SELECT id, lower(trim(split_part(t, ';', 1))) IN ('image/jpeg', 'image/jpg', 'image/png', 'image/webp') AS accepted, t IN ('image/svg+xml', 'image/gif') AS refused, t = 'text/html' OR t = '' AS page, CASE WHEN t = '' THEN 'missing_content_type' WHEN lower(trim(split_part(t, ';', 1))) NOT IN ('image/jpeg', 'image/png') THEN 'unsupported_content_type: ' || t END AS reason FROM (SELECT id, ['image/jpeg; q=1', 'IMAGE/PNG', 'image/svg+xml', 'image/gif', 'text/html', ''][(id % 6 + 1)::INTEGER] AS t FROM v_crawl_log)")
def _(s, d):
    t = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("id") % 6 + 1).cast("int"))
    return v.crawl_log(s, d).select("id", exprs.type_accepted(t).alias("accepted"), exprs.type_refused(t).alias("refused"), exprs.parseable(F.lit(False), t, F.lit(10)).alias("page"), exprs.content_type_reason(t).alias("reason"))


@query("q8_resume", f"WITH f AS (SELECT domain || ':run-0' AS checkpoint_id, domain || '/x' || k AS url, k AS depth FROM v_full, (VALUES (1), (2)) t(k) WHERE id % 6 = 0) SELECT v.domain, coalesce(f.url, 'https://' || v.domain) AS url, coalesce(f.depth, 0) AS depth FROM v_full v LEFT JOIN f ON f.checkpoint_id = v.frontier_checkpoint_id")
def _(s, d):
    domains = v.full_domains(s, d)
    saved = domains.filter("id % 6 = 0").select(F.concat("domain", F.lit(":run-0")).alias("checkpoint_id"), "domain", F.explode(F.array(F.lit(1), F.lit(2))).alias("depth")).select("checkpoint_id", F.concat("domain", F.lit("/x"), "depth").alias("url"), "depth", (v.as_of() + F.make_dt_interval(F.lit(1))).alias("expires_at"))
    return frontier.resume(domains.select("domain", F.col("frontier_checkpoint_id").alias("checkpoint_id")), saved, v.as_of())


@query("j6_known_images", "SELECT id FROM v_provenance WHERE image_id IN (SELECT id FROM v_images) AND image_id IN (3, 5, 8)")
def _(s, d):
    chosen = s.createDataFrame([([3, 5, 8],)], "ids array<long>").select(F.explode("ids").alias("image_id"))
    return v.provenance(s, d).join(v.images(s, d).select(F.col("id").alias("image_id")), "image_id", "left_semi").join(chosen, "image_id", "left_semi").select("id")


@query("x3_seen_sizes", r"SELECT regexp_replace(lower(domain), '^www\.', '') AS domain, count(DISTINCT page_url) AS size FROM v_crawl_log WHERE id % 5 <> 0 GROUP BY 1")
def _(s, d):
    log = v.crawl_log(s, d).select("id", exprs.fallback_canonical(F.col("domain")).alias("domain"), "page_url")
    gone = log.filter("id % 5 = 0").select("id")
    return log.join(gone, "id", "left_anti").groupBy("domain").agg(F.count_distinct("page_url").alias("size"))


