"""The command line: `python -m seamark.cli --store FOLDER COMMAND`. Each command reads and writes the tables of one Warehouse.

Nothing is asked on the terminal: commands that destroy something need --yes (domain-reset: --force), and without it only show what
they would do and end with 1 (cleanup-stale-runs, domain-reset: 0, as an answer of no does).
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from seamark.conf import session
from seamark.functions import exprs
from seamark.operators import closing, frontier, reports
from seamark.operators import domains as dom
from seamark.sources import seeds
from seamark.store import Warehouse


def ingest_seeds(store: Warehouse, args: argparse.Namespace, now: Column) -> int:
    try:
        path = seeds.seed_path(args.source, args.file)
    except ValueError as e:
        print(f"Error: {e}")
        return 1
    hadoop = store.spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(store.spark._jsc.hadoopConfiguration()).exists(hadoop):
        print(f"Source file not found: {path}")
        return 1
    rows, stats = seeds.ingest(store.spark, path, store.read("start_urls"), args.limit, args.offset, args.source)
    store.append("start_urls", rows)
    for name, n in stats.items():
        print(f"{name}: {n}")
    return 0


def list_runs(store: Warehouse, args: argparse.Namespace, now: Column) -> int:
    rows = reports.runs_listed(store.read("crawl_runs"), args.limit).collect()  # at most --limit rows
    if not rows:
        print("No crawl runs found.")
    for r in rows:
        print(f"{r['id']:<36} {r['started_at']!s:<20} {r['mode']:<12} {r['pages_crawled'] or 0:<8} {r['images_downloaded'] or 0:<8}")
    return 0


def queue_status(store: Warehouse, args: argparse.Namespace, now: Column) -> int:
    r = frontier.queue_report(store.read("start_urls"), store.read("requests"), store.read("start_urls")).first()
    print(f"Start URLs (seeds): {r['start_urls']}\nScheduled requests: {r['requests']}\nUnique domains seen: {r['domains_seen']}")
    if r["pending_domains"]:
        print(f"Per-domain pending: {r['pending_domains']} domains")
    return 0


def backfill_domains(store: Warehouse, args: argparse.Namespace, now: Column) -> int:
    found = dom.backfill(store.read("crawl_log"))
    print(f"{'Would backfill' if args.dry_run else 'Backfilling'} {found.count()} domains")
    if not args.dry_run:
        ids = found.withColumns({"id": F.sha2("domain", 256), "source": F.lit("backfill_crawl_log"), "total_error_count": F.col("errors").cast("int"), "version": F.lit(0), "images_stored": F.lit(0), "priority_score": F.lit(0), "consecutive_error_count": F.lit(0), "frontier_size": F.lit(0)})
        merged = dom.upsert(store.read("domains"), store.conformed("domains", ids), "domain", ["pages_crawled", "images_found", "last_crawled_at"])
        store.write("domains", dom.with_images_stored(merged, store.read("provenance")))
    return 0


def domain_status(store: Warehouse, args: argparse.Namespace, now: Column) -> int:
    domains = store.read("domains")
    if not args.status:
        for r in sorted(reports.summary_totals(domains).collect(), key=lambda r: (r["status"] == "TOTAL", r["status"])):  # a row a state
            print(f"{r['status']:<15} {r['domains']:<10} {'' if r['status'] == 'TOTAL' else r['avg_pages'] or 0:<12} {r['total_images'] or 0:<15}")
        return 0
    rows = dom.by_status(domains, args.status, args.limit).collect()  # at most --limit rows
    if not rows:
        print(f"No domains found with status '{args.status}'")
    for r in rows:
        claim = (r["claimed_by"] or "") + (f" (expires {r['claim_expires_at']:%H:%M})" if r["claim_expires_at"] else "")
        print(f"{r['domain']:<40} {r['priority_score'] or 0:<10} {r['pages_crawled'] or 0:<10} {r['images_stored'] or 0:<10} {claim[:38]}")
    return 0


def domain_info(store: Warehouse, args: argparse.Namespace, now: Column) -> int:
    r = store.read("domains").filter(F.col("domain") == args.domain).first()
    if not r:
        print(f"Domain '{args.domain}' not found")
        return 1
    shown = {"Domain": "domain", "ID": "id", "Status": "status", "Source": "source", "Seed Rank": "seed_rank", "Version": "version", "Pages Crawled": "pages_crawled", "Pages Discovered": "pages_discovered", "Images Found": "images_found", "Images Stored": "images_stored"}
    for label, column in shown.items():
        print(f"{label}: {r[column]}")
    print(f"Image Yield Rate: {r['image_yield_rate']:.4f}" if r["image_yield_rate"] else "Image Yield Rate: N/A")
    print(f"Total Errors: {r['total_error_count'] or 0}\nConsecutive Errors: {r['consecutive_error_count'] or 0}")
    print(f"First Seen: {r['first_seen_at']}\nLast Crawled: {r['last_crawled_at'] or 'Never'}\nPriority Score: {r['priority_score']}")
    if r["block_reason"]:
        print(f"Block Reason: {r['block_reason']}")
    if r["frontier_checkpoint_id"]:
        print(f"Frontier Checkpoint: {r['frontier_checkpoint_id']}\nFrontier Size: {r['frontier_size'] or 0} URLs")
    if r["claimed_by"]:
        print(f"Claimed By: {r['claimed_by']}\nClaim Expires: {r['claim_expires_at']}")
    return 0


def recalculate_priorities(store: Warehouse, args: argparse.Namespace, now: Column) -> int:
    domains = store.read("domains")
    rated = domains.filter(~F.col("status").isin("blocked", "unreachable"))
    if not args.dry_run:
        store.write("domains", dom.recalculated(domains, now))
    counts = {r["status"]: r["n"] for r in rated.groupBy("status").agg(F.count("*").alias("n")).collect()}  # a row a state
    print(f"{'Would update' if args.dry_run else 'Updated'} {sum(counts.values())} domains")
    for status in sorted(counts):
        print(f"  {status}: {counts[status]}")
    return 0


def _claims(store: Warehouse, now: Column, head: str) -> int:
    rows = reports.claims_by_worker(store.read("domains"), now).orderBy(F.col("claims").desc(), "claimed_by").collect()  # a row a worker
    print(head if rows else "No active claims")
    for r in rows:
        print(f"  {r['claimed_by']}: {r['claims']} domains (expires: {r['first_expiry']} - {r['last_expiry']})")
    return sum(r["claims"] for r in rows)


def release_stuck_claims(store: Warehouse, args: argparse.Namespace, now: Column) -> int:
    if (args.all_active or args.worker_id) and not args.force:
        print(f"Error: {'--all-active' if args.all_active else '--worker-id'} requires --force flag for safety")
        return 1
    active = _claims(store, now, "Active claims:")
    domains = store.read("domains")
    if not args.force:
        which = F.coalesce(F.col("claim_expires_at") < now, F.lit(False))
    elif args.worker_id:
        which = F.col("claimed_by") == args.worker_id
        held = dom.claims_of(domains, args.worker_id)
        n = held.count()
        print(f"Would release {n} claims for worker: {args.worker_id}" if n else f"No active claims found for worker: {args.worker_id}")
        for r in held.limit(5).collect():
            print(f"  {r['domain']} (status: {r['status']})")
        if not n:
            return 0
    elif args.all_active:
        which = F.col("claimed_by").isNotNull()
        print(f"Would release {active} active claims across all workers")
    else:
        return 0
    if args.dry_run:
        print("DRY RUN: No changes made")
        return 0
    if args.force and not args.yes:
        print("Aborted")
        return 1
    out = dom.force_release(domains, which)
    print(f"Released {out.filter('released').count()} claims")
    store.write("domains", out)
    _claims(store, now, "Remaining active claims:")
    return 0


def cleanup_stale_runs(store: Warehouse, args: argparse.Namespace, now: Column) -> int:
    runs = store.read("crawl_runs")
    stale = reports.stale_runs(runs.withColumnRenamed("id", "crawl_run_id"), store.read("crawl_log"), now, args.older_than_minutes)
    n = stale.count()
    print(f"Found {n} stale runs" if n else f"No stale runs found (threshold: {args.older_than_minutes} minutes)")
    for r in stale.orderBy("last_activity").limit(20).collect():
        print(f"  Run {r['crawl_run_id']}: started {r['started_at']}, last activity {r['last_activity']} ({int(r['minutes_idle'])} min ago)")
    if not n or args.dry_run or not args.yes:
        print("No changes made")
        return 0
    store.write("crawl_runs", closing.failed_stale(runs, stale, now))
    print(f"Marked {n} runs as failed")
    return 0


def domain_reset(store: Warehouse, args: argparse.Namespace, now: Column) -> int:
    domains = store.read("domains")
    r = domains.filter(F.col("domain") == args.domain).first()
    if not r:
        print(f"Domain '{args.domain}' not found")
        return 1
    print(f"Domain: {r['domain']}\nCurrent Status: {r['status']}\nPages Crawled: {r['pages_crawled']}\nImages Stored: {r['images_stored']}")
    if not args.force:
        print("Aborted.")
        return 0
    store.write("domains", dom.reset(domains, F.col("domain") == args.domain))
    print(f"Domain '{args.domain}' has been reset to 'pending' status.")
    return 0


def cleanup_fingerprints(store: Warehouse, args: argparse.Namespace, now: Column) -> int:
    seen = store.read("fingerprints")
    n = seen.distinct().count()
    print(f"Total fingerprints: {n}" if n else "No fingerprints found")
    if n and args.dry_run:
        print(f"DRY RUN: Would delete {n} fingerprints")
    elif n:
        store.write("fingerprints", seen.filter("false"))
        print(f"Deleted {n} fingerprints")
    return 0


def top_domains(store: Warehouse, args: argparse.Namespace, now: Column) -> int:
    for r in dom.top_by_yield(store.read("domains"), args.limit).collect():  # at most --limit rows
        print(f"{r['domain']:<40} {'N/A' if r['image_yield_rate'] is None else format(r['image_yield_rate'], '.4f')}")
    return 0


def report(store: Warehouse, args: argparse.Namespace, now: Column) -> int:
    text = reports.markdown(reports.analysis(store.read("images"), store.read("provenance"), store.read("crawl_log"), store.read("crawl_runs")), "Crawl Analysis Summary")
    with open(args.out, "w", encoding="utf-8") as f:
        f.write(text)
    print(args.out)
    return 0


def clean(store: Warehouse, args: argparse.Namespace, now: Column) -> int:
    gone = store.truncate(confirm=args.yes)
    print(f"Deleted: {', '.join(gone) or 'nothing'}")
    return 0 if args.yes else 1


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seamark", description=__doc__)
    top.add_argument("--store", required=True, help="folder of the tables")
    top.add_argument("--as-of", help="the time that counts as now (ISO, UTC)")
    sub = top.add_subparsers(dest="command", required=True)

    def command(run: Callable[..., int], *arguments: tuple[str, dict]) -> None:
        p = sub.add_parser(run.__name__.replace("_", "-"))
        for name, options in arguments:
            p.add_argument(name, **options)
        p.set_defaults(run=run)

    flag = {"action": "store_true"}
    dry, yes = ("--dry-run", flag), ("--yes", flag)
    limit = lambda n: ("--limit", {"type": int, "default": n})
    command(ingest_seeds, ("--source", {"choices": ["tranco", "majestic", "custom"], "default": "tranco"}), limit(10_000), ("--offset", {"type": int, "default": 0}), ("--file", {}))
    command(list_runs, limit(10))
    command(queue_status)
    command(backfill_domains, dry)
    command(domain_status, ("--status", {"choices": list(exprs.STATUSES)}), limit(50))
    command(domain_info, ("domain", {}))
    command(recalculate_priorities, dry)
    command(release_stuck_claims, dry, ("--force", flag), ("--worker-id", {}), ("--all-active", flag), yes)
    command(cleanup_stale_runs, ("--older-than-minutes", {"type": int, "default": 60}), dry, yes)
    command(domain_reset, ("domain", {}), ("--force", flag))
    command(cleanup_fingerprints, dry)
    command(top_domains, limit(20))
    command(report, ("--out", {"required": True}))
    command(clean, yes)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or session("seamark-cli")
    now = F.lit(datetime.fromisoformat(args.as_of) if args.as_of else datetime.now(UTC)).cast("timestamp")
    return args.run(Warehouse(spark, args.store), args, now)


if __name__ == "__main__":
    raise SystemExit(main())
