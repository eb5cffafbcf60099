"""Mixing sources to target weights by hash-threshold histograms.

Each document has a hash of its id. Within a source, documents are taken in the order of that hash until
the source's budget is met, but nothing is sorted: words are summed by source and leading bits of the
hash, the bits at which the running sum passes the budget are the boundary, and only that boundary's
documents are summed again by the next bits (nested budgets). After LEVELS such steps a boundary holds
about one document in 2**36 of its source, whose rows settle the rest. Then one comparison with the
source's threshold decides for each row. Everything is DataFrame functions.

A source whose target is above its size has all its documents whole times, and budgets the remainder.

Null texts have size 0, a null source is a source of its own (the last one), null ids hash like the
empty text. Rows with the same id hash alike and are taken together. No rows give no rows. Columns
beside id, source and text are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamark.llm.store import WORD, drop, written

BITS, LEVELS, HASH_BITS = 12, 3, 60
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3


def id_hash(key: Column) -> Column:
    """60 bits, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """Never null, so that plain joins keep the rows without a source."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sizes: source_key, source_size, one row a source. Adds target: min(most * size, level * weight), with one level so that targets sum to all sizes."""
    order = Window.orderBy(F.col("source_key") == "", "source_key")
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    # in the order in which sources reach their ceiling: each row's level is what is left for it and those after it
    by_ceiling = Window.orderBy(F.col("ceiling") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    levelled = (
        weighed.withColumn("ceiling", F.lit(float(most)) * F.col("source_size"))
        .withColumn("level", F.try_divide(F.sum("source_size").over(everything) - F.coalesce(F.sum("ceiling").over(by_ceiling), F.lit(0.0)), F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ceiling), F.lit(0.0))))
        .withColumn("full", F.col("ceiling") <= F.col("level") * F.col("weight"))
    )
    # rows after the first that is not full count their neighbours' ceilings too: the greatest level is the first's
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return levelled.select("source_key", "source_size", F.when(F.col("full"), F.col("ceiling")).otherwise(level * F.col("weight")).alias("target"))


def sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("source_key"), words.alias("size"), id_hash(F.col(id_col)).alias("hash"))


def limits(lean: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """A written row per source of lean (sized()'s rows): source_key, source_size, target, whole, limit. Documents are taken `whole` times, and once more if their hash is below `limit`."""
    budgets = targets(lean.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    # prefix: the boundary's leading bits; before: words of the documents below them
    bounds = written(budgets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long")), "mix-budgets")
    for step in range(1, LEVELS + 1):
        shift = HASH_BITS - BITS * step
        inside = lean.join(bounds.select("source_key", F.col("prefix").alias("p")), "source_key").filter(F.shiftright("hash", shift + BITS) == F.col("p"))
        buckets = inside.groupBy("source_key", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source_key").orderBy("bucket")
        passed = buckets.withColumn("upto", F.sum("words").over(running)).join(bounds, "source_key").withColumn("upto", F.col("upto") + F.col("before"))
        # the first bucket at whose end the budget is reached; with none, the one after the last
        here = F.col("upto") >= F.col("budget")
        found = passed.groupBy("source_key").agg(
            F.min(F.when(here, F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")))).alias("hit"), F.max(F.struct((F.col("bucket") + 1).alias("bucket"), F.col("upto").alias("before"))).alias("end"))
        at = F.coalesce("hit", "end")
        narrowed = bounds.drop("prefix", "before").join(found.select("source_key", at["bucket"].alias("prefix"), at["before"].alias("before")), "source_key", "left")
        # an empty boundary has no rows: its first finer bucket stands for it
        old = bounds.select("source_key", F.shiftleft("prefix", BITS).alias("old_prefix"), F.col("before").alias("old_before"))
        narrowed = narrowed.join(old, "source_key").withColumn("prefix", F.coalesce("prefix", "old_prefix")).withColumn("before", F.coalesce("before", "old_before")).drop("old_prefix", "old_before")
        outer, bounds = bounds, written(narrowed, f"mix-bounds{step}")
        drop(outer)
    shift = HASH_BITS - BITS * LEVELS
    last = lean.join(bounds, "source_key").filter(F.shiftright("hash", shift) == F.col("prefix")).groupBy("source_key", "hash", "budget", "before").agg(F.sum("size").alias("words"))
    last = last.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("source_key").orderBy("hash")))
    # taken while it comes nearer to the budget
    nearer = (F.col("upto") <= F.col("budget")) | (F.col("upto") - F.col("budget") <= F.col("budget") - (F.col("upto") - F.col("words")))
    edge = last.filter(nearer).groupBy("source_key").agg(F.max("hash").alias("edge"))
    out = written(bounds.join(edge, "source_key", "left").select("source_key", "source_size", "target", "whole", F.coalesce(F.col("edge") + 1, F.shiftleft("prefix", shift)).alias("limit")), "mix-limits")
    drop(bounds)
    return out


def copies() -> Column:
    return (F.col("whole") + F.when(F.col("hash") < F.col("limit"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row per document: id, size, source_size, target (its source's words), copies and taken (words, copies counted)."""
    lean = written(sized(docs, id_col, source_col, text_col), "mix-sizes")
    decided = lean.join(limits(lean, weights, most), "source_key")
    return decided.select(F.col("id").alias(id_col), "size", "source_size", "target", copies().alias("copies"), (F.col("size") * copies()).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with each row as often as the mix takes it; the texts stay where they are, only sources' limits move."""
    lean = written(sized(docs, id_col, source_col, text_col), "mix-sizes")
    found = limits(lean, weights, most).select(F.col("source_key").alias("__source"), "whole", "limit")
    drop(lean)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), source_key(F.col(source_col)).alias("__source"), id_hash(F.col(id_col)).alias("hash"))
    return rows.join(found, "__source").select("doc", F.explode(F.array_repeat(F.lit(0), copies().cast("int")))).select("doc.*")
