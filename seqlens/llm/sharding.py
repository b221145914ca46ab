"""Consistent placement by a permutation-filled lookup table (operator 8).

Every shard prefers the slots of a prime-sized table in an order of its own (an offset and a stride from its name).
Shards take turns, each claiming the first slot of its order that is free, until the table is full; so all own nearly
the same number of slots, and when a shard leaves, few slots of the others change. A key's place is one lookup.
The table has `slots` rows whatever the corpus, so its broadcast is bounded.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65537
MAX_SLOTS = 655373


def preference(name: str, slots: int) -> tuple[int, int]:
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def fill_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The owner, as a place in the list of shards, of every slot. Shards take turns in order of their names."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards are named, once each")
    if not len(shards) <= slots <= MAX_SLOTS or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the number of slots is a prime from the number of shards to {MAX_SLOTS}")
    owner = np.full(slots, -1, np.int32)
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    at = [preference(name, slots) for name in shards]
    place = [offset for offset, _ in at]
    free = slots
    while True:
        for i in turns:
            while owner[place[i]] >= 0:
                place[i] = (place[i] + at[i][1]) % slots
            owner[place[i]] = i
            free -= 1
            if not free:
                return owner


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    owner = fill_table(shards, slots)
    return spark.createDataFrame([(i, shards[o]) for i, o in enumerate(owner.tolist())], "slot int, shard string")


def place(rows: DataFrame, shards: list[str], id_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """doc_id, slot, shard of every row, by a broadcast of the table; no row is shuffled.

    The key is the id's text, hashed by XXH64; a null id is the key of the empty text. Equal ids go to one shard."""
    spark = rows.sparkSession
    key = F.xxhash64(F.coalesce(rows[id_col].cast("string"), F.lit("")))
    placed = rows.select(rows[id_col].alias("doc_id"), F.pmod(key, F.lit(slots)).cast("int").alias("slot"))
    return placed.join(F.broadcast(lookup_table(spark, shards, slots)), "slot").select("doc_id", "slot", "shard")
