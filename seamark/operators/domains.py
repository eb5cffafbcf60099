"""The domains table: inserts, updates by deltas, scores, leases and states. State in, state out; one writer applies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamark.functions import exprs


def insert_new(state: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or ignore."""
    return state.unionByName(new.dropDuplicates([key]).join(state.select(key), key, "left_anti").select(state.columns), allowMissingColumns=True)


def upsert(state: DataFrame, new: DataFrame, key: str, overwrite: list[str]) -> DataFrame:
    """New rows go in whole; rows that exist take only the columns to overwrite."""
    n = new.select(F.col(key), F.struct(*[c for c in state.columns if c != key]).alias("__new"), F.lit(True).alias("__has_new"))
    o = state.select(F.col(key), F.struct(*[c for c in state.columns if c != key]).alias("__old"), F.lit(True).alias("__has_old"))
    pick = lambda c: F.when(F.col("__has_old").isNull(), F.col(f"__new.{c}")).when(F.col("__has_new") & F.lit(c in overwrite), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c)
    return o.join(n, key, "full_outer").select(*[F.col(key) if c == key else pick(c) for c in state.columns])


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Last write wins for each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("r")).select(*keys, "r.*")


def apply_deltas(state: DataFrame, deltas: DataFrame, key: str = "domain", guard: Column | None = None) -> DataFrame:
    """Adds the sums of delta columns (same names as the state's); the yield follows from the values after the update."""
    names = [c for c in deltas.columns if c != key]
    d = deltas.groupBy(key).agg(*[F.sum(c).alias(f"__{c}") for c in names])
    joined = state.join(d, key, "left")
    allowed = guard if guard is not None else F.lit(True)
    add = {c: (F.col(c) + F.when(allowed, F.coalesce(f"__{c}", F.lit(0))).otherwise(0)).cast(state.schema[c].dataType) for c in names}
    out = joined.withColumns(add).select(state.columns)
    return out.withColumn("image_yield_rate", exprs.rate(F.col("images_stored"), F.col("pages_crawled"))) if guard is None else out


def backfill(log: DataFrame) -> DataFrame:
    """crawl_log to domains: raw domains first, then canonical names; mostly failing ones are blocked."""
    raw = log.groupBy("domain").agg(F.count("*").alias("total"), F.count_if(F.col("status") < 400).alias("ok"), F.count_if(F.col("status") >= 400).alias("errors"), F.coalesce(F.sum("images_found"), F.lit(0)).alias("images"), F.min("crawled_at").alias("first"), F.max("crawled_at").alias("last"))
    by = raw.groupBy(exprs.fallback_canonical(F.col("domain")).alias("domain")).agg(F.sum("total").alias("pages_discovered"), F.sum("ok").alias("pages_crawled"), F.sum("images").alias("images_found"), F.sum("errors").alias("errors"), F.min("first").alias("first_seen_at"), F.max("last").alias("last_crawled_at"))
    return by.withColumn("status", F.when(F.col("errors") > 0.5 * F.col("pages_discovered"), "blocked").otherwise("exhausted"))


def images_stored(provenance: DataFrame) -> DataFrame:
    """Per canonical domain: distinct images summed over raw variants, and exactly distinct ones."""
    canonical = exprs.fallback_canonical(F.col("source_domain")).alias("domain")
    parity = provenance.groupBy("source_domain").agg(F.countDistinct("image_id").alias("n")).groupBy(canonical).agg(F.sum("n").alias("images_stored"))
    return parity.join(provenance.groupBy(canonical).agg(F.countDistinct("image_id").alias("distinct_images")), "domain")


def scored(domains: DataFrame, as_of: Column) -> DataFrame:
    """Rates and priority of domains that are neither blocked nor unreachable; others keep none."""
    rates = domains.withColumns({"image_yield_rate": exprs.rate(F.col("images_stored"), F.col("pages_crawled")), "error_rate": exprs.rate(F.col("total_error_count"), F.col("pages_crawled"))})
    return rates.filter(~F.col("status").isin("blocked", "unreachable")).withColumn("priority_score", exprs.priority(as_of))


def candidates(domains: DataFrame, as_of: Column) -> DataFrame:
    free = F.col("claimed_by").isNull() | (F.col("claim_expires_at") < as_of)
    return domains.filter(F.col("status").isin("pending", "active") & (F.col("next_crawl_after").isNull() | (F.col("next_crawl_after") < as_of)) & free)


def claim(domains: DataFrame, workers: list[str], batch: int, as_of: Column, lease_minutes: int = 30) -> DataFrame:
    """Disjoint batches for the workers, in claim order. The global top is found without sorting everything; only batch * workers rows are ranked."""
    order = [(F.col("status") == "active").desc(), F.col("priority_score").desc(), F.col("last_crawled_at").asc_nulls_first(), F.col("domain")]
    best = candidates(domains, as_of).orderBy(*order).limit(batch * len(workers))
    place = F.row_number().over(Window.orderBy(*order)) - 1
    owner = F.element_at(F.array(*map(F.lit, workers)), (F.floor(place / batch) + 1).cast("int"))
    return best.withColumn("claimed_by", owner).withColumns({"claim_expires_at": as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lease_minutes)), "version": F.col("version") + 1})


def renew(domains: DataFrame, worker: str, as_of: Column, lease_minutes: int = 30) -> DataFrame:
    mine = F.coalesce((F.col("claimed_by") == worker) & (F.col("claim_expires_at") > as_of), F.lit(False))
    longer = as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(lease_minutes))
    return domains.withColumns({"claim_expires_at": F.when(mine, longer).otherwise(F.col("claim_expires_at")), "version": F.col("version") + mine.cast("int"), "renewed": mine})


def may_move(old: Column, new: Column) -> Column:
    return F.concat_ws(">", old, new).isin(*[f"{a}>{b}" for a, bs in exprs.MOVES.items() for b in bs])


def release(domains: DataFrame, requests: DataFrame, as_of: Column | None = None) -> DataFrame:
    """requests: id, worker, expected_version, new_status (null: stay), one a domain. Further columns named like a column of
    domains with _delta after it add to it (null: nothing), those named like a column replace it. Adds `applied`.

    A release holds only for the claim's owner at the expected version and, if the state changes, by an allowed move; it
    clears the claim, sets last_crawled_at and counts the version up once. Refused rows stay as they are.
    """
    fixed = ("id", "worker", "expected_version", "new_status")
    more = [c for c in requests.columns if c not in fixed]
    unknown = [c for c in more if c.removesuffix("_delta") not in domains.columns]
    if unknown:
        raise ValueError(f"no such columns of domains: {unknown}")
    asked = requests.select("id", *[F.col(c).alias(f"__{c}") for c in (*fixed[1:], *more)])
    r = domains.join(asked, "id", "left")
    move = F.col("__new_status").isNull() | may_move(F.col("status"), F.col("__new_status"))
    ok = F.coalesce((F.col("claimed_by") == F.col("__worker")) & (F.col("version") == F.col("__expected_version")) & move, F.lit(False))
    out = {"status": F.when(ok, F.coalesce("__new_status", "status")).otherwise(F.col("status")), "claimed_by": F.when(~ok, F.col("claimed_by")), "claim_expires_at": F.when(~ok, F.col("claim_expires_at")), "version": F.col("version") + ok.cast("int"), "applied": ok}
    if as_of is not None:
        out["last_crawled_at"] = F.when(ok, as_of.cast(domains.schema["last_crawled_at"].dataType)).otherwise(F.col("last_crawled_at"))
    for c in more:
        name = c.removesuffix("_delta")
        new = F.col(name) + F.coalesce(F.col(f"__{c}"), F.lit(0)) if c.endswith("_delta") else F.col(f"__{c}")
        out[name] = F.when(ok, new).otherwise(F.col(name)).cast(domains.schema[name].dataType)
    return r.withColumns(out).select(*domains.columns, "applied")


def expire(domains: DataFrame, as_of: Column) -> DataFrame:
    over = F.coalesce(F.col("claim_expires_at") < as_of, F.lit(False))
    return force_release(domains, over)


def force_release(domains: DataFrame, which: Column) -> DataFrame:
    """Clears claims without a version bump; adds `released`."""
    hit = F.col("claimed_by").isNotNull() & which
    return domains.withColumns({"released": hit, "claimed_by": F.when(~hit, F.col("claimed_by")), "claim_expires_at": F.when(~hit, F.col("claim_expires_at"))})


#: What a reset sets to zero and to null. next_crawl_after stays.
RESET_ZERO = ("pages_crawled", "pages_discovered", "images_found", "images_stored", "total_error_count", "consecutive_error_count", "frontier_size")
RESET_NULL = ("image_yield_rate", "last_crawled_at", "last_crawl_run_id", "frontier_checkpoint_id", "claimed_by", "claim_expires_at", "block_reason", "block_reason_code")


def reset(domains: DataFrame, which: Column) -> DataFrame:
    """The chosen domains as if new, one version up; columns that the frame lacks are left out."""
    hit = F.coalesce(which, F.lit(False))
    out = {c: F.when(hit, F.lit(0).cast(domains.schema[c].dataType)).otherwise(F.col(c)) for c in RESET_ZERO if c in domains.columns}
    out |= {c: F.when(~hit, F.col(c)) for c in RESET_NULL if c in domains.columns}
    return domains.withColumns(out | {"status": F.when(hit, "pending").otherwise(F.col("status")), "version": F.col("version") + hit.cast("int")})


def replaced(state: DataFrame, sets: DataFrame, key: str = "domain", keep_null: bool = True) -> DataFrame:
    """sets: one row a key with columns of state to be replaced; nulls keep the old value unless keep_null is False."""
    names = [c for c in sets.columns if c != key]
    joined = state.join(sets.select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in names]), key, "left")
    pick = lambda c: F.coalesce(f"__{c}", c) if keep_null else F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c))
    return joined.withColumns({c: pick(c).cast(state.schema[c].dataType) for c in names}).select(state.columns)


def update_stats(state: DataFrame, deltas: DataFrame, as_of: Column, sets: DataFrame | None = None) -> DataFrame:
    """apply_deltas, then the absolute values of `sets` (nulls keep the old ones) and last_crawled_at of every domain named."""
    named = deltas.select("domain").distinct().withColumn("last_crawled_at", as_of)
    out = replaced(apply_deltas(state, deltas), named)
    return replaced(out, sets) if sets is not None else out


def increment_claimed(domains: DataFrame, deltas: DataFrame, as_of: Column) -> DataFrame:
    """deltas: id, worker, crawl_run_id (null keeps the old) and columns to add. Only domains that the worker holds change;
    pages_discovered, the yield and the version do not. Adds `applied`."""
    names = [c for c in deltas.columns if c not in ("id", "worker", "crawl_run_id")]
    asked = deltas.groupBy("id", "worker").agg(F.max("crawl_run_id").alias("__run"), *[F.sum(c).alias(f"__{c}") for c in names])
    r = domains.join(asked, (domains["id"] == asked["id"]) & (domains["claimed_by"] == asked["worker"]), "left").drop(asked["id"])
    ok = F.col("worker").isNotNull()
    out = {c: (F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0))).cast(domains.schema[c].dataType) for c in names}
    out |= {"last_crawled_at": F.when(ok, as_of.cast(domains.schema["last_crawled_at"].dataType)).otherwise(F.col("last_crawled_at")), "last_crawl_run_id": F.coalesce("__run", "last_crawl_run_id"), "applied": ok}
    return r.withColumns(out).select(*domains.columns, "applied")


def set_checkpoints(domains: DataFrame, saved: DataFrame, as_of: Column) -> DataFrame:
    """saved: domain, frontier_checkpoint_id, frontier_size. The domains named take them and are active again."""
    return replaced(domains, saved.withColumns({"frontier_updated_at": as_of, "status": F.lit("active")}))


def clear_checkpoints(domains: DataFrame, names: DataFrame, as_of: Column) -> DataFrame:
    """names: domain. Their checkpoints are forgotten."""
    gone = names.select("domain").distinct().withColumns({"frontier_checkpoint_id": F.lit(None).cast("string"), "frontier_size": F.lit(0), "frontier_updated_at": as_of})
    return replaced(domains, gone, keep_null=False)


def touched(old: DataFrame, new: DataFrame, key: str, as_of: Column) -> DataFrame:
    """new with updated_at set where any other column differs from old's row, and where there is none."""
    names = [c for c in new.columns if c not in (key, "updated_at")]
    before = old.select(key, F.struct(*names).alias("__before"))
    changed = F.col("__before").isNull() | ~F.struct(*names).eqNullSafe(F.col("__before"))
    return new.join(before, key, "left").withColumn("updated_at", F.when(changed, as_of).otherwise(F.col("updated_at"))).select(new.columns)


def with_images_stored(domains: DataFrame, provenance: DataFrame) -> DataFrame:
    """domains with images_stored from provenance, where it has any."""
    return replaced(domains, images_stored(provenance).select("domain", "images_stored"))


def by_status(domains: DataFrame, status: str, n: int = 50) -> DataFrame:
    """The first n of a state: highest score, then longest not crawled."""
    return domains.filter(F.col("status") == status).orderBy(F.col("priority_score").desc_nulls_first(), F.col("last_crawled_at").asc_nulls_first(), "domain").limit(n)


def claims_of(domains: DataFrame, worker: str) -> DataFrame:
    """A worker's claims, the first to expire first."""
    return domains.filter(F.col("claimed_by") == worker).select("id", "domain", "status", "pages_crawled", "claim_expires_at").orderBy(F.col("claim_expires_at").asc_nulls_last(), "domain")


def recalculated(domains: DataFrame, as_of: Column) -> DataFrame:
    """domains with rates, scores and priority_computed_at; blocked and unreachable ones keep what they have."""
    return replaced(domains, scored(domains, as_of).select("domain", "image_yield_rate", "error_rate", "priority_score").withColumn("priority_computed_at", as_of), keep_null=False)


def refresh_candidates(domains: DataFrame, as_of: Column, n: int) -> DataFrame:
    """Extension (a design of the reference that it does not run): exhausted domains that are due, best yield first."""
    due = domains.filter((F.col("status") == "exhausted") & (F.col("next_crawl_after") < as_of))
    return due.orderBy(F.col("image_yield_rate").desc_nulls_last(), F.col("last_crawled_at").asc_nulls_last(), "domain").limit(n)


def top_by_yield(domains: DataFrame, n: int = 20) -> DataFrame:
    """Extension: domains by image yield."""
    return domains.orderBy(F.col("image_yield_rate").desc_nulls_last(), "domain").limit(n)
