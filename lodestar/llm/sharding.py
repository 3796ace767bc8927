"""Sharding by a permutation-filled lookup table.

Each shard has a preference order of the slots of a prime-sized table: it starts
at an offset and goes on by a step, both from a hash of its name, so every slot
comes once.  Shards take turns claiming their next free slot until the table is
full.  A key's slot is its hash modulo the size, its shard what the table holds
there.  Turns keep the shards even to within one slot; taking a shard away moves
few keys but its own.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

#: Prime, and over 100 slots a shard for up to 655 shards.
SLOTS = 65537
#: The table is broadcast: rows of a number and a name, so at most about 100 MB.
MAX_SLOTS = 1 << 20


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def preference(shard: str, slots: int) -> tuple[int, int]:
    """(offset, step) of a shard's order: slot j is (offset + j * step) mod slots."""
    return _number(f"offset:{shard}") % slots, _number(f"step:{shard}") % (slots - 1) + 1


def fill(shards: list[str], slots: int = SLOTS) -> list[str]:
    """The shard of each slot.

    Shards are taken in name order, names once; an empty list or a size that is
    no prime (steps would not reach every slot) raises.
    """
    names = sorted(set(shards))
    if not names:
        raise ValueError("there is no shard")
    if slots < 2 or slots > MAX_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots is a prime of at most 2**20")
    if len(names) > slots:
        raise ValueError("there are more shards than slots")
    at, step = map(list, zip(*(preference(x, slots) for x in names)))
    table: list[str | None] = [None] * slots
    left = slots
    while True:
        for i, name in enumerate(names):
            while table[at[i]] is not None:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = name
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot: 60 bits of the MD5 of its text, modulo the size; a null key has that of the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(rows: DataFrame, key_col: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """rows with slot and shard.

    Edge cases: null keys share the slot of the empty text; equal keys share a
    shard, so the key should be that of a row (an id), not of a group; a key may
    be of any type that casts to text and of any length; columns of rows with
    the names above are replaced, also a key of that name once its slot is
    known; no rows give no rows.
    """
    spark = rows.sparkSession
    schema = T.StructType([T.StructField("slot", T.IntegerType(), False), T.StructField("shard", T.StringType(), False)])
    table = spark.createDataFrame(list(enumerate(fill(shards, slots))), schema)
    (at,) = fresh(rows, "at")
    placed = rows.withColumn(at, slot_of(F.col(f"`{key_col}`"), slots))
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("slot", "shard")]
    return placed.select(*kept, at).join(F.broadcast(table), F.col(at) == F.col("slot")).select(*kept, "slot", "shard")
