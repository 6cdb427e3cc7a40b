"""Shard placement by a permutation-filled lookup table.

Every shard walks the slots of a prime-sized table in its own order (an offset and a skip drawn
from its name) and the shards take turns to claim their next free slot until none is left. The
table has a fixed size whatever the data, so it is broadcast and a key is placed by one lookup;
adding or losing a shard moves about 1/shards of the keys.

Defined cases: a null key is placed as the text "null"; equal keys land on the same shard; an
empty table gives an empty result; the key column is the only one read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots (a prime) and shards in production.
SLOTS, SHARDS = 65537, 64


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def fill(names: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """Slot -> index of the shard that claimed it. A shard of weight w claims w slots a turn."""
    if not names or slots < len(names):
        raise ValueError("there must be shards, and as many slots")
    start = [_number(n, "offset") % slots for n in names]
    skip = [_number(n, "skip") % (slots - 1) + 1 for n in names]
    owner, step, free = [-1] * slots, [0] * len(names), slots
    turns = weights or [1] * len(names)
    while free:
        for shard, times in enumerate(turns):
            for _ in range(min(times, free)):
                while owner[at := (start[shard] + step[shard] * skip[shard]) % slots] >= 0:
                    step[shard] += 1
                owner[at] = shard
                free -= 1
    return owner


def place(rows: DataFrame, key: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(key, slot int, shard int) for each row."""
    owner = fill([f"shard-{i}" for i in range(shards)], slots)
    lookup = rows.sparkSession.createDataFrame(list(enumerate(owner)), "slot int, shard int")
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    slot = F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")
    # The table has `slots` rows of 8 bytes by construction.
    return rows.select(key, slot.alias("slot")).join(F.broadcast(lookup), "slot").select(key, "slot", "shard")
