"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: a permutation given by an offset and a stride from
hashes of its name. Shards take turns, each claiming the first slot of its order that is still free, until all slots are
taken; so shares differ by at most one slot, and adding or losing a shard moves few slots beside its own. A row's key is
hashed to a slot, and the table, whose size is a fixed parameter, is broadcast: placement is one lookup, without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime far above the number of shards.
SLOTS = 8191
SHARDS = 64


def names(n: int) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def lookup(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The filled table: for each slot the position of its shard in ``shards``. Bounded by ``slots``, whatever the data."""
    if not shards or len(set(shards)) != len(shards) or slots < len(shards):
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be prime")

    def number(name: str, salt: str) -> int:
        return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)

    at = [number(s, "offset") % slots for s in shards]
    stride = [number(s, "stride") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + stride[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column | str, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text, modulo the table's size; a null key counts as the empty text."""
    c = F.col(key) if isinstance(key, str) else key
    digest = F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digest, 16, 10).cast("long") % slots


def lookup_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as rows ``(slot, shard)``."""
    cells = F.split(F.lit(",".join(map(str, lookup(shards, slots)))), ",")
    return spark.range(1).select(F.posexplode(cells).alias("slot", "shard")).select(F.col("slot").cast("long").alias("slot"), F.col("shard").cast("int").alias("shard"))


def place(docs: DataFrame, *, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS, slot_column: str = "slot", shard_column: str = "shard") -> DataFrame:
    """Every row with its slot and shard number. Equal keys share a shard; repeated rows and nulls stay; an empty table stays empty.

    The new columns replace columns of the same name, every other column stays. DataFrame functions only; one narrow pass over the input.
    """
    docs = docs.drop(slot_column, shard_column)
    own, taken = "table_slot", {c.lower() for c in (*docs.columns, slot_column, shard_column)}
    while own in taken:
        own += "_"
    table = lookup_frame(docs.sparkSession, shards or names(SHARDS), slots).toDF(own, shard_column)
    placed = docs.withColumn(slot_column, slot_of(F.col(key), slots))
    return placed.join(F.broadcast(table), placed[slot_column] == table[own]).drop(own)


def moved(before: list[str], after: list[str], slots: int = SLOTS) -> float:
    """Share of slots whose shard (by name) changes between two sets of shards."""
    a, b = lookup(before, slots), lookup(after, slots)
    return sum(before[x] != after[y] for x, y in zip(a, b)) / slots
