"""Placement of keys on shards by a permutation-filled lookup table.

Each shard walks the slots of a prime-sized table in an order of its own (an offset and a step, both
from its name) and the shards take turns at claiming the next slot that is still free. A key's slot is
a hash of its text modulo the prime, so placing a key is one look-up, shares are even, and a shard that
comes or goes moves few keys besides its own.

The table has `slots` entries whatever the data hold, so broadcasting it has a fixed bound.

Null keys count as the empty text. Repeated keys go to one shard. Columns of the input named like the
result's are not touched, since only the key is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
MAX_SLOTS = 4_194_301
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The shard's position in `shards` for each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime between the number of shards and {MAX_SLOTS}")
    starts, steps = [], []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        starts.append(int.from_bytes(digest[:8], "big") % slots)
        steps.append(int.from_bytes(digest[8:], "big") % (slots - 1) + 1)
    owner = [-1] * slots
    at = list(starts)
    left = slots
    while left:
        for shard, step in enumerate(steps):
            slot = at[shard]
            while owner[slot] >= 0:
                slot = (slot + step) % slots
            owner[slot] = shard
            at[shard] = (slot + step) % slots
            left -= 1
            if not left:
                break
    return np.array(owner, dtype=np.int32)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    owners = lookup_table(shards, slots)
    return spark.createDataFrame([(i, int(x), shards[x]) for i, x in enumerate(owners)], "slot int, shard int, shard_name string")


def place(docs: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """A row per row of docs: the key, its slot, its shard's position and name. A key named like one of these comes out as `key`."""
    keyed = docs.select(F.col(key).alias("key"), slot_of(F.col(key), slots).alias("slot"))
    placed = keyed.join(F.broadcast(table_frame(docs.sparkSession, shards, slots)), "slot")
    return placed.select(F.col("key").alias("key" if key in ("slot", "shard", "shard_name") else key), "slot", "shard", "shard_name")
