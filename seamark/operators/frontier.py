"""Seeds, seen sets, checkpoints, budgets and breadth-first expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamark.functions import exprs
from seamark.store import written


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; a partial aggregate before the shuffle."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def checkpoint(urls: DataFrame, saved_at: Column, seconds: int = 2_592_000) -> DataFrame:
    """checkpoint_id, url, depth, seq: the last depth of each url, 0 where missing, urls without text skipped."""
    kept = urls.filter(F.coalesce(F.col("url"), F.lit("")) != "").groupBy("checkpoint_id", "url").agg(F.max_by(F.coalesce("depth", F.lit(0)), "seq").alias("depth"))
    return kept.withColumn("expires_at", saved_at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))


def resume(domains: DataFrame, saved: DataFrame, as_of: Column) -> DataFrame:
    """Each domain's checkpointed urls, or its root at depth 0."""
    live = saved.filter(F.col("expires_at") > as_of).select("checkpoint_id", "url", "depth")
    return domains.join(live, "checkpoint_id", "left").select("domain", F.coalesce("url", F.concat(F.lit("https://"), "domain")).alias("url"), F.coalesce("depth", F.lit(0)).alias("depth"))


def running(rows: DataFrame, key: str, at: str, tie: str, value: Column, name: str, seconds: int = 3600) -> DataFrame:
    """Adds the running sum of `value` over each key's rows by (at, tie), both ends of a row included.

    Rows are summed by key and span of `seconds` first; the spans' sums run on, and within a span its own rows do. So one
    key's rows are spread over its spans, and what one task holds of a key is a span, or a row a span.
    """
    span = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (seconds * 1_000_000))
    dealt = rows.withColumns({"__span": span, "__value": value})
    before = Window.partitionBy(key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(key, "__span").agg(F.sum("__value").alias("__sum")).select(F.col(key).alias("__key"), F.col("__span").alias("__at"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(key, "__span").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("__own", F.sum("__value").over(inside))
    return own.join(sums, own[key].eqNullSafe(sums["__key"]) & own["__span"].eqNullSafe(sums["__at"])).withColumn(name, F.col("__own") + F.col("__before")).select(*rows.columns, name)


def budgeted(pages: DataFrame, key: str, order: list[str], budget: int) -> DataFrame:
    """Adds `follows`: the page is among its domain's first `budget`; 0 is no limit."""
    if not budget:
        return pages.withColumn("follows", F.lit(True))
    return running(pages, key, *order, F.lit(1), "__k").withColumn("follows", F.col("__k") <= budget).drop("__k")


def globally_budgeted(pages: DataFrame, key: str, order: list[str], max_pages: int) -> DataFrame:
    """Adds `follows`: links of all pages before the max_pages-th are followed; 0 is no limit. Only max_pages keys are ranked."""
    if not max_pages:
        return pages.withColumn("follows", F.lit(True))
    first = pages.orderBy(*order).limit(max_pages - 1).select(key, F.lit(True).alias("__first"))
    return pages.join(first, key, "left").withColumn("follows", F.coalesce("__first", F.lit(False))).drop("__first")


def capped(rows: DataFrame, key: str, order: list[str], cap: int = 1000) -> DataFrame:
    """The first `cap` rows of each key. Spark cuts each partition's rows to `cap` a key before the shuffle."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__k") <= cap).drop("__k")


def dequeued(queue: DataFrame, key: str, order: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """The first n rows of each key's queue, and what stays in it."""
    out = capped(queue, key, order, n)
    return out, queue.join(out.select(key, *order), [key, *order], "left_anti")


def queue_status(queue: DataFrame, domains: DataFrame, key: str = "domain") -> DataFrame:
    """Each domain's queue size, and whether it is active or exhausted."""
    sizes = queue.groupBy(key).agg(F.count("*").alias("size"))
    return domains.select(key).distinct().join(sizes, key, "left").select(key, F.coalesce("size", F.lit(0)).alias("size"), F.when(F.coalesce("size", F.lit(0)) > 0, "active").otherwise("exhausted").alias("queue"))


def blocked_after(pages: DataFrame, key: str, order: list[str], most: int = 3) -> DataFrame:
    """Adds `errors_so_far` and `blocked` by responses that refuse service."""
    bad = F.coalesce(F.col("status").isin(403, 429, 503), F.lit(False)).cast("int")
    return running(pages, key, *order, bad, "errors_so_far").withColumn("blocked", F.col("errors_so_far") >= most)


def flush_batches(pages: DataFrame, key: str, order: list[str], every: int) -> DataFrame:
    """Adds `batch`; with 0 nothing is flushed before the end."""
    if not every:
        return pages.withColumn("batch", F.lit(0).cast("long"))
    return running(pages, key, *order, F.lit(1), "__k").withColumn("batch", F.floor((F.col("__k") - 1) / every)).drop("__k")


def scheduled(requests: DataFrame, seen: DataFrame) -> DataFrame:
    """requests: seq, url, priority, dont_filter, crawl_type. Those that go into the queue, with their fingerprint and domain:
    the first of each fingerprint not seen before, and all that are not to be filtered (these are not remembered either).
    Refreshes stand ten back."""
    rows = requests.withColumns({"fingerprint": exprs.fingerprint(F.col("url")), "domain": exprs.netloc(F.col("url")), "free": F.coalesce("dont_filter", F.lit(False))})
    first = rows.filter(~F.col("free")).groupBy("fingerprint").agg(F.min("seq").alias("seq")).join(seen.select("fingerprint"), "fingerprint", "left_anti")
    kept = rows.filter("free").unionByName(rows.filter(~F.col("free")).join(first, ["fingerprint", "seq"], "left_semi").select(rows.columns))
    return kept.select("seq", "url", "domain", "fingerprint", (F.col("priority") - F.when(F.col("crawl_type") == "refresh", 10).otherwise(0)).alias("priority"), "crawl_type", "free")


def remembered(seen: DataFrame, kept: DataFrame) -> DataFrame:
    """Fingerprints after a scheduled() batch."""
    return seen.select("fingerprint").unionByName(kept.filter(~F.col("free")).select("fingerprint")).distinct()


def popped(queue: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The n requests to be sent next, highest priority first and then in order of arrival, and the queue without them."""
    out = queue.orderBy(F.col("priority").desc(), "seq").limit(n)
    return out, queue.join(out.select("seq"), "seq", "left_anti")


def queue_report(start_urls: DataFrame, requests: DataFrame, seen: DataFrame) -> DataFrame:
    """One row: seeds, scheduled requests, domains seen, domains with requests."""
    one = lambda df, c, name: df.agg(c.alias(name))
    return one(start_urls, F.count_distinct("url"), "start_urls").crossJoin(one(requests, F.count("*"), "requests")).crossJoin(one(seen, F.count_distinct("domain_key"), "domains_seen")).crossJoin(one(requests, F.count_distinct("domain"), "pending_domains"))  # one row each


def loaded(saved: DataFrame, checkpoint_id: str, as_of: Column) -> DataFrame:
    """A checkpoint's live urls by depth, then url."""
    return saved.filter((F.col("checkpoint_id") == checkpoint_id) & (F.col("expires_at") > as_of)).select("url", "depth").orderBy("depth", "url")


def checkpoint_sizes(saved: DataFrame, as_of: Column) -> DataFrame:
    """Live checkpoints and how many urls they hold; a checkpoint exists if it is here."""
    return saved.filter(F.col("expires_at") > as_of).groupBy("checkpoint_id").agg(F.count("*").alias("size"))


def without_checkpoints(saved: DataFrame, gone: DataFrame) -> DataFrame:
    """saved without the checkpoints of `gone` (checkpoint_id)."""
    return saved.join(gone.select("checkpoint_id"), "checkpoint_id", "left_anti")


def queue_sizes(moves: DataFrame, key: str) -> DataFrame:
    """moves: key and a signed delta."""
    return moves.groupBy(key).agg(F.sum("delta").alias("size"))


def expand(roots: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """url, depth of all pages within `depth` links (src, dst), at the least depth. Each front is written once, so a level costs one join however deep it lies."""
    seen = front = written(roots.select("url").distinct().withColumn("depth", F.lit(0)), "front")
    for d in range(1, depth + 1):
        reached = front.join(links, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        front = written(reached.join(seen, "url", "left_anti").withColumn("depth", F.lit(d)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def domain_pages(pages: DataFrame) -> DataFrame:
    return pages.groupBy(exprs.netloc(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))
