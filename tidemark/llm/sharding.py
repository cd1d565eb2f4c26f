"""Consistent sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size: offset + k * skip, modulo the size. The
shards take turns, each claiming its first free slot, until the table is full; so every shard has an equal share of
slots to within one, and when shards come or go, most slots keep their shard. A row's slot is the hash of its key modulo the size. The table
has ``slots`` rows whatever the data, so it is broadcast, and placement is one look-up a row.

Rows with a null key are placed by their text, so that they don't gather in one shard; repeated keys share a
shard; columns of the input named slot or shard are replaced; other columns pass through.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65537


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot; slots must be a prime above the number of shards."""
    if not shards or slots <= len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime above the number of shards, of which there must be one")
    step = []
    for name in shards:
        h = hashlib.sha256(name.encode()).digest()
        step.append((int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1))
    table, at, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for i, (offset, skip) in enumerate(step):
            while table[slot := (offset + at[i] * skip) % slots] >= 0:
                at[i] += 1
            table[slot] = i
            left -= 1
            if not left:
                break
    return table


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """slot, shard: one row a slot."""
    return spark.createDataFrame([(s, shards[i]) for s, i in enumerate(fill(shards, slots))], "slot int, shard string")


def slot_of(key: Column, fallback: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.when(key.isNull(), F.xxhash64(F.lit("no key"), fallback)).otherwise(F.xxhash64(key)), F.lit(slots)).cast("int")


def place(rows: DataFrame, shards: list[str], key: str = "doc_id", fallback: str = "text", slots: int = SLOTS) -> DataFrame:
    """rows with the slot and shard of each."""
    rows = rows.drop("slot", "shard")
    table = lookup(rows.sparkSession, shards, slots)
    return rows.withColumn("slot", slot_of(F.col(key), F.col(fallback), slots)).join(F.broadcast(table), "slot").select(*rows.columns, "slot", "shard")
