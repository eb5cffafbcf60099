"""Connected components of a table of links, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.store import drop, written


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns vertex, label: the least vertex of its component, for every vertex of a link.

    Each round takes the least label among neighbours, then the label's own label. Labels stay within a
    component and only fall, so the round that changes nothing is the last.
    """
    both = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("vertex"), F.least("a", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("vertex").alias("b"), "label"), "b").groupBy(F.col("a").alias("vertex")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "vertex").select("vertex", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("vertex").alias("label"), F.col("label").alias("further"))
        after = written(lower.join(jump, "label").select("vertex", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("old")).alias("moved")), "labels")
        drop(labels)
        labels = after
        if labels.filter("moved").isEmpty():
            drop(both)
            return labels.select("vertex", "label")
