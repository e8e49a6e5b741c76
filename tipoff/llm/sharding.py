"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table whose size is prime, from two hashes of its name. The shards take turns;
at each turn a shard claims its most preferred free slot, until the table is full. A key's slot is a hash of it, so placement is one lookup in a
table of fixed size. Adding or taking away a shard moves few slots besides its own.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.frames import fresh

#: Slots of the table, a prime well above a hundred times the shards.
SLOTS = 65_537


def fill_table(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[str]:
    """The shard of each slot. A shard of weight w takes w turns in a row (1 if not given); the order of ``shards`` does not matter."""
    names = sorted(set(shards))
    if not names or len(names) > slots:
        raise ValueError(f"{len(names)} shards for {slots} slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots ** 0.5) + 1)):
        raise ValueError(f"{slots} is not a prime")
    offset = {s: xxhash.xxh64_intdigest(s, 1) % slots for s in names}
    skip = {s: xxhash.xxh64_intdigest(s, 2) % (slots - 1) + 1 for s in names}
    tried = dict.fromkeys(names, 0)
    table: list[str | None] = [None] * slots
    free = slots
    turns = [s for s in names for _ in range((weights or {}).get(s, 1))]
    if not turns:
        raise ValueError("no shard has a turn")
    while free:
        for s in turns:
            slot = (offset[s] + tried[s] * skip[s]) % slots
            while table[slot] is not None:
                tried[s] += 1
                slot = (offset[s] + tried[s] * skip[s]) % slots
            table[slot] = s
            tried[s] += 1
            free -= 1
            if not free:
                break
    return table


def place(rows: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None,
          slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """Adds ``slot`` and ``shard`` to every row. Equal keys share a shard; null is a key like any other.

    The table is broadcast: its size is ``slots``, whatever the rows. Columns that have one of the added names are replaced.
    """
    spark = rows.sparkSession
    names = sorted(set(shards))
    number = {s: k for k, s in enumerate(names)}
    filled = bytes().join(number[s].to_bytes(4, "big") for s in fill_table(names, slots, weights))
    rows = rows.drop(slot_col, shard_col)
    key = fresh("slot_of_row", rows.columns)
    at = F.conv(F.hex(F.substring(F.lit(bytearray(filled)), 4 * F.col("id").cast("int") + 1, F.lit(4))), 16, 10).cast("int")
    table = spark.range(slots).select(F.col("id").alias(slot_col), F.element_at(F.array(*map(F.lit, names)), at + 1).alias(shard_col))
    hashed = rows.withColumn(key, F.pmod(F.xxhash64(*keys), F.lit(slots)))
    return hashed.join(F.broadcast(table), F.col(key) == F.col(slot_col)).drop(key)


def write_shards(placed: DataFrame, path: str, shard_col: str = "shard") -> None:
    """One folder for each shard, each written by as many tasks as hold rows of it: no shard gathers in one task."""
    placed.write.partitionBy(shard_col).parquet(path)
