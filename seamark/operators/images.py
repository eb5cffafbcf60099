"""Image responses: validation, storing with provenance, near duplicates by perceptual hash (an extension)."""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.conf import EngineConf
from seamark.functions import exprs, udfs
from seamark.store import written


def validated(responses: DataFrame, conf: EngineConf = EngineConf(), variant: str = "async") -> DataFrame:
    """responses: url, status, content_type, body (and content_length for the sync variant). Adds width, height, format, sha256 and the first rejection (null: accepted).

    The sync variant believes the declared length before the body, says of a body over the limit only that it exceeds
    it (a reason that no counter knows), and gives details of a payload that it cannot read.
    """
    sync = variant == "sync"
    size = F.length("body")
    rows = responses.withColumn("__info", udfs.image_header("body"))
    w, h = F.col("__info.width"), F.col("__info.height")
    bytes_of = lambda n: F.concat(n, F.lit(" bytes"))
    why = F.when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), exprs.reason(F.lit("http_error"), F.coalesce(F.col("status").cast("string"), F.lit("")))).when(exprs.content_type_reason(F.col("content_type")).isNotNull(), exprs.content_type_reason(F.col("content_type")))
    if sync:
        told = F.col("content_length")
        why = why.when(told < conf.min_bytes, exprs.reason(F.lit("file_too_small"), bytes_of(told))).when(told > conf.max_bytes, exprs.reason(F.lit("file_too_large"), bytes_of(told))).when(size > conf.max_bytes, F.lit(f"File exceeds maximum size of {conf.max_bytes} bytes"))
    why = (
        why.when(size < conf.min_bytes, exprs.reason(F.lit("file_too_small"), bytes_of(size))).when(size > conf.max_bytes, exprs.reason(F.lit("file_too_large"), bytes_of(size)))
        .when(w.isNull() | h.isNull(), exprs.reason(F.lit("invalid_image_payload"), F.lit("cannot parse dimensions" if sync else ""))).when((w < conf.min_width) | (h < conf.min_height), exprs.reason(F.lit("image_dimensions_too_small"), F.concat(w, F.lit("x"), h)))
    )
    return rows.select("*", w.alias("width"), h.alias("height"), F.col("__info.format").alias("format"), F.sha2("body", 256).alias("sha256"), why.alias("rejection")).drop("__info")


OUTCOMES = "seq long, outcome string, image_url string"


def fold(rows: list[tuple]) -> list[tuple[int, str, str]]:
    """(seq, url, sha256) in order of seq, rows that are stored already with seq None first: (seq, outcome, url of the image that holds it).

    A known url with its hash: deduplicated; a known url with another: overwritten; else a known hash: deduplicated, held by the
    least url with that hash; else inserted.
    """
    held: dict[str, str] = {}
    urls: dict[str, set[str]] = {}
    out = []
    for seq, url, sha in rows:
        old = held.get(url)
        if seq is None or old != sha:
            if seq is not None:
                outcome = "overwritten" if old is not None else "deduplicated" if urls.get(sha) else "inserted"
                out.append((seq, outcome, url if outcome != "deduplicated" else min(urls[sha])))
                if outcome == "deduplicated":
                    continue
            if old is not None:
                urls[old].discard(url)
            held[url] = sha
            urls.setdefault(sha, set()).add(url)
        else:
            out.append((seq, "deduplicated", url))
    return out


def fold_group(group: pa.Table) -> pa.Table:
    """One group of urls and hashes that conflict."""
    rows = sorted(zip(*(group.column(c).to_pylist() for c in ("seq", "url", "sha256")), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    found = fold(rows)
    columns = list(zip(*found, strict=True)) if found else [[], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["seq", "outcome", "image_url"])


def store(images: DataFrame, arrivals: DataFrame) -> DataFrame:
    """arrivals: seq, url, sha256. The outcome each has when they are stored in order of seq, and the url of the image that then holds it: see fold().

    Only urls that meet several hashes (in the store and the batch together) can change a hash that others rely on. Their
    rows, with the stored rows of those hashes, are folded in order, group by group of what they connect. Of all other rows
    with such a hash, only the first between two changes goes with them: once it is in, the rest of that span finds the hash
    known. Rows whose hash no such url ever has are settled by the first row of the hash, without an order. So one hash or
    url that fills a third of the batch is aggregated, not folded.
    """
    stored = images.select("url", "sha256").dropDuplicates(["url"])
    known = stored.join(arrivals.select("url").distinct(), "url", "left_semi")
    pairs = arrivals.select("url", "sha256").distinct().unionByName(known).distinct()
    restless = written(pairs.groupBy("url").agg(F.count("*").alias("n")).filter("n > 1").select("url"), "restless")
    core = written(arrivals.join(restless, "url", "left_semi").select("seq", "url", "sha256"), "core")
    touched = core.select("sha256").unionByName(known.join(restless, "url", "left_semi").select("sha256")).distinct()
    moved = known.join(restless, "url", "left_semi")
    spans = core.select("url", "seq").join(core.select("url", "sha256").unionByName(moved.select("url", "sha256")).distinct(), "url").groupBy("sha256").agg(F.array_sort(F.collect_set("seq")).alias("at"))
    calm = arrivals.join(restless, "url", "left_anti").join(known.select("url", F.lit(True).alias("is_known")), "url", "left").select("seq", "url", "sha256", "is_known")
    same = calm.filter("is_known").select("seq", F.lit("deduplicated").alias("outcome"), F.col("url").alias("image_url"))
    leaf = calm.filter("is_known is null").drop("is_known")

    quiet = leaf.join(touched, "sha256", "left_anti")
    by_hash = stored.join(quiet.select("sha256").distinct(), "sha256", "left_semi").groupBy("sha256").agg(F.min("url").alias("held"))
    first = quiet.groupBy("sha256").agg(F.min_by("url", "seq").alias("first_url"), F.min("seq").alias("first_seq")).join(by_hash, "sha256", "left")
    settled = quiet.join(first, "sha256").select("seq", F.when(F.col("held").isNull() & (F.col("seq") == F.col("first_seq")), "inserted").otherwise("deduplicated").alias("outcome"), F.coalesce("held", "first_url").alias("image_url"))

    near = leaf.join(touched, "sha256", "left_semi").join(spans, "sha256", "left").withColumn("span", F.size(F.filter(F.coalesce("at", F.array().cast("array<bigint>")), lambda x: x < F.col("seq"))))
    heads = near.groupBy("sha256", "span").agg(F.min("seq").alias("seq"), F.min_by("url", "seq").alias("url"))
    old = stored.join(touched, "sha256", "left_semi").unionByName(moved).distinct()
    # of the stored rows of a hash that no url of the batch can take away, the least stands for all
    still = old.join(restless, "url", "left_anti").groupBy("sha256").agg(F.min("url").alias("url"))
    base = moved.select("url", "sha256").unionByName(still.select("url", "sha256")).select(F.lit(None).cast("long").alias("seq"), "url", "sha256")
    rows = written(base.unionByName(core).unionByName(heads.select("seq", "url", "sha256")), "conflicts")
    groups = grouped(rows.join(restless, "url", "left_semi").select("url", "sha256").distinct())
    dealt = rows.join(groups, "sha256", "left").select("seq", "url", "sha256", F.coalesce("label", "sha256").alias("label"))
    folded = written(dealt.groupBy("label").applyInArrow(fold_group, OUTCOMES), "folded")
    head_of = heads.select(F.col("sha256").alias("hs"), F.col("span").alias("hp"), F.col("seq").alias("head_seq")).join(folded.select(F.col("seq").alias("head_seq"), F.col("image_url").alias("head_image")), "head_seq")
    rest = near.join(head_of, (F.col("sha256") == F.col("hs")) & (F.col("span") == F.col("hp"))).filter(F.col("seq") != F.col("head_seq"))
    followers = rest.select("seq", F.lit("deduplicated").alias("outcome"), F.col("head_image").alias("image_url"))
    outcomes = same.unionByName(settled).unionByName(folded).unionByName(followers)
    return arrivals.select("seq", "url", "sha256").join(outcomes, "seq")


def grouped(edges: DataFrame) -> DataFrame:
    """edges: url, sha256. sha256, label: hashes that urls connect have one label. Labels fall until none changes."""
    labels = written(edges.select("sha256").distinct().withColumn("label", F.col("sha256")), "labels")
    while True:
        by_url = edges.join(labels, "sha256").groupBy("url").agg(F.min("label").alias("near"))
        near = edges.join(by_url, "url").groupBy("sha256").agg(F.min("near").alias("near"))
        after = labels.join(near, "sha256")
        jump = after.join(labels.select(F.col("sha256").alias("near"), F.col("label").alias("further")), "near", "left")
        new = written(jump.select("sha256", F.least("near", F.coalesce("further", "near")).alias("label"), (F.least("near", F.coalesce("further", "near")) < F.col("label")).alias("moved")), "labels")
        labels = new.select("sha256", "label")
        if new.filter("moved").isEmpty():
            return labels


def stored_images(images: DataFrame, arrivals: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """images after the batch. arrivals: seq, url, sha256 and any further columns of images; the last arrival at an image sets what an insert or a new hash brings."""
    more = [c for c in arrivals.columns if c in images.columns and c not in ("url", "sha256")]
    hits = outcomes.select("seq", "outcome", "image_url").join(arrivals, "seq")
    brings = hits.filter("outcome <> 'deduplicated'").groupBy(F.col("image_url").alias("url")).agg(F.max_by(F.struct("sha256", *more), "seq").alias("new"))
    seen = hits.groupBy(F.col("image_url").alias("url")).agg(F.lit(True).alias("hit"))
    joined = images.join(brings, "url", "full_outer").join(seen, "url", "left")
    if "id" in images.columns and "id" not in more:
        joined = joined.withColumn("id", F.coalesce("id", F.sha2("url", 256)))
    pick = {c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)) for c in ("sha256", *more)}
    if "last_seen_at" in images.columns:
        pick["last_seen_at"] = F.when(F.col("hit"), as_of).otherwise(F.col("last_seen_at"))
    return joined.withColumns(pick).select(images.columns)


def linked(provenance: DataFrame, links: DataFrame, as_of: Column) -> DataFrame:
    """links: image_id, source_page_url, source_domain, discovery_type. provenance with them; a pair that is there takes the new time and type."""
    keys = ["image_id", "source_page_url"]
    new = links.dropDuplicates(keys).withColumn("discovered_at", as_of)
    names = [*keys, "source_domain", "discovery_type", "discovered_at"]
    kept = provenance.select(*names).join(new.select(*keys), keys, "left_anti")
    domains = provenance.select(*keys, F.col("source_domain").alias("__old"))
    return kept.unionByName(new.join(domains, keys, "left").withColumn("source_domain", F.coalesce("__old", "source_domain")).select(*names))


def ensured(provenance: DataFrame, images: DataFrame, links: DataFrame, as_of: Column) -> DataFrame:
    """linked(), for images that exist."""
    return linked(provenance, links.join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi"), as_of)


def bumped_log(log: DataFrame, downloads: DataFrame) -> DataFrame:
    """downloads: page_url, crawl_run_id, a row an image that came new. Every log row of that page and run counts them."""
    keys = ["page_url", "crawl_run_id"]
    n = downloads.filter("crawl_run_id is not null").groupBy(*keys).agg(F.count("*").alias("__n"))
    return log.join(n, keys, "left").withColumn("images_downloaded", (F.col("images_downloaded") + F.coalesce("__n", F.lit(0))).cast(log.schema["images_downloaded"].dataType)).select(log.columns)


def skipped(arrivals: DataFrame, images: DataFrame, as_of: Column, refresh_days: int) -> DataFrame:
    """Adds `skipped`: a discovery of a url that is known and not due for a refresh. Refreshes are always looked at again."""
    known = images.select("url", F.lit(True).alias("__known"), due(images, as_of, refresh_days).alias("__due")).dropDuplicates(["url"])
    hit = F.coalesce("__known", F.lit(False)) & ~F.coalesce("__due", F.lit(False)) & (F.col("crawl_type") == "discovery")
    return arrivals.join(known, "url", "left").withColumn("skipped", F.coalesce(hit, F.lit(False))).select(*arrivals.columns, "skipped")


#: The pipeline's counters.
PIPELINE = ("images_received", "images_downloaded", "images_deduplicated", "images_skipped", "images_failed", "total_bytes_downloaded")


def pipeline_counters(items: DataFrame) -> DataFrame:
    """items: outcome (inserted, overwritten, deduplicated, skipped or failed), error_message, file_size. A row a counter: the pipeline's six, then one for each reason of a rejection and one for unknown ones; zero where nothing was counted."""
    spark = items.sparkSession
    new = F.col("outcome").isin("inserted", "overwritten")
    totals = items.agg(F.count("*"), F.count_if(new), F.count_if(F.col("outcome") == "deduplicated"), F.count_if(F.col("outcome") == "skipped"), F.count_if(F.col("outcome") == "failed"), F.coalesce(F.sum(F.when(new, F.col("file_size"))), F.lit(0)))
    first = totals.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in PIPELINE]), F.array(*[F.col(f"`{c}`") for c in totals.columns]))).alias("counter", "n"))
    reasons = spark.createDataFrame([(r,) for r in (*exprs.REASONS, "unknown") if r != "fetch_exception"], "counter string")
    counted = items.filter("outcome = 'failed'").groupBy(exprs.rejection_class(F.col("error_message")).alias("counter")).agg(F.count("*").alias("n"))
    return first.unionByName(reasons.join(counted, "counter", "left").select("counter", F.coalesce("n", F.lit(0)).alias("n")))


def due(images: DataFrame, as_of: Column, days: int) -> Column:
    """Whether an image is to be fetched again; never with 0 days or without a last sight."""
    return F.lit(days > 0) & F.coalesce(F.col("last_seen_at") < as_of - F.make_dt_interval(F.lit(days)), F.lit(False))


def exact_duplicates(images: DataFrame) -> DataFrame:
    return images.groupBy("sha256").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def hash_halves(embeddings: DataFrame) -> DataFrame:
    """Sign bits of 64 numbers as two 32-bit halves."""
    half = lambda lo: F.aggregate(F.slice("embedding", lo, 32), F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0))
    return embeddings.select("vec_id", half(1).alias("high"), half(33).alias("low"))


def near_duplicates(halves: DataFrame, most: int = 10) -> DataFrame:
    """Extension: pairs of ids within `most` (up to 11) differing bits of 64, each once.

    Of four blocks of 16 bits, one differs in at most most // 4 bits. Each row stands under its four blocks, and asks under
    every block value within that many flips (137 for two); so a pair meets only where a block is that close, and the
    first such block alone reports it, so no pair needs to be made distinct.
    """
    if not 0 <= most < 12:
        raise ValueError("most must be from 0 to 11")
    flips = most // 4
    masks = [sum(1 << i for i in c) for k in range(flips + 1) for c in itertools.combinations(range(16), k)]
    block = lambda row, i: F.shiftright(F.col(f"{row}.high" if i < 2 else f"{row}.low"), 16 * (1 - i % 2)).bitwiseAND(0xFFFF)
    rows = halves.select(F.struct("vec_id", "high", "low").alias("r"))
    stands = rows.select(F.col("r").alias("b"), F.posexplode(F.array(*[block("r", i) for i in range(4)])).alias("place", "value"))
    asks = rows.select(F.col("r").alias("a"), F.posexplode(F.array(*[block("r", i) for i in range(4)])).alias("place", "own")).withColumn("value", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("own").bitwiseXOR(m)))).drop("own")
    met = asks.join(stands, ["place", "value"]).filter(F.col("a.vec_id") < F.col("b.vec_id"))
    differ = F.bit_count(F.col("a.high").bitwiseXOR(F.col("b.high"))) + F.bit_count(F.col("a.low").bitwiseXOR(F.col("b.low")))
    close = F.array(*[F.bit_count(block("a", i).bitwiseXOR(block("b", i))) <= flips for i in range(4)])
    return met.filter((differ <= most) & (F.array_position(close, True) == F.col("place") + 1)).select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), differ.alias("distance"))
