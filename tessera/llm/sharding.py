"""Sharding by a permutation-filled lookup table.

Each of the n shards has its own preference order over the slots of a table of
prime size m: offset + j * skip (mod m). The shards take turns; at its turn a shard
claims its next preferred slot that is still free, until none is. So each shard has
m // n or m // n + 1 slots, and taking a shard away moves little but its own keys.
A row's key is hashed to a slot, and the table, broadcast, gives its shard: m rows,
a fixed bound that does not grow with the data. No shuffle is needed to place rows.

Edge cases: null keys hash like any other value, so null doc_ids share one slot;
equal keys get one shard, wherever they lie, but for a hot key, whose rows are spread
over `spread` slots by a second key; an empty table gives no rows; other columns stay as
they are, whatever their names (but for slot and shard, which are replaced); fewer than
one shard, or a size that is not a prime above the number of shards, is an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots; with 128 shards no two differ by more than one slot in 512.
TABLE_SIZE = 65_537


def _is_prime(m: int) -> bool:
    return m > 1 and all(m % d for d in range(2, int(m**0.5) + 1))


def fill(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The table: for each slot, the number of the shard that claimed it."""
    if not shards or not _is_prime(size) or size < len(shards):
        raise ValueError("there must be shards, and a prime number of slots, no fewer than shards")
    place, skip = [], []
    for name in shards:
        d = hashlib.md5(name.encode()).digest()
        place.append(int.from_bytes(d[:8], "big") % size)
        skip.append(int.from_bytes(d[8:], "big") % (size - 1) + 1)
    table, left = [-1] * size, size
    while True:
        for i in range(len(shards)):
            at = place[i]
            while table[at] >= 0:
                at = (at + skip[i]) % size
            table[at] = i
            place[i] = (at + skip[i]) % size
            left -= 1
            if not left:
                return table


def lookup(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """slot, shard: the table as a DataFrame of `size` rows."""
    return spark.createDataFrame(list(enumerate(fill(shards, size))), "slot int, shard int")


def slot_of(*cols: str, size: int = TABLE_SIZE) -> Column:
    """md5 of the key's text, its first 60 bits modulo the table's size."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, key: list[str], shards: list[str], size: int = TABLE_SIZE, hot: DataFrame | None = None, spread_by: list[str] | None = None, spread: int = 16) -> DataFrame:
    """df with slot and shard (a column of either name is replaced).

    hot: keys (columns named as in `key`) too frequent for one shard, from hot_keys; their rows
    go over `spread` slots chosen by the columns spread_by. There are fewer than 1 / share of
    them: they are broadcast, and no row moves."""
    own = df.drop("slot", "shard").columns
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")
    rows = df.select(row, slot_of(*[f"`{k}`" for k in key], size=size).alias("slot"), *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(key)])
    if hot is not None:
        marks = hot.select(*[F.col(f"`{k}`").alias(f"h{i}") for i, k in enumerate(key)], F.lit(True).alias("is_hot")).distinct()
        rows = rows.join(F.broadcast(marks), [F.col(f"k{i}").eqNullSafe(F.col(f"h{i}")) for i in range(len(key))], "left")
        moved = (F.col("slot") + slot_of(*[f"row.`{c}`" for c in spread_by or key], size=spread) * (size // spread)) % size
        rows = rows.withColumn("slot", F.when(F.col("is_hot"), moved).otherwise(F.col("slot")).cast("int"))
    return rows.select("row", "slot").join(F.broadcast(lookup(df.sparkSession, shards, size)), "slot").select("row.*", "slot", "shard")


def hot_keys(df: DataFrame, key: list[str], share: float, rows: int) -> DataFrame:
    """Keys with over `share` of all `rows`, counted before any row is moved: fewer than 1 / share."""
    return df.groupBy(*[F.col(f"`{k}`") for k in key]).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > share * rows).drop("_n")


def moved(df: DataFrame, key: list[str], before: list[str], after: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """Rows whose shard's name changes between two lists of shards."""
    b, a = fill(before, size), fill(after, size)
    change = [(i, before[x], after[y]) for i, (x, y) in enumerate(zip(b, a, strict=True)) if before[x] != after[y]]
    changed = df.sparkSession.createDataFrame(change, "slot int, from_shard string, to_shard string")
    return df.withColumn("slot", slot_of(*key, size=size)).join(F.broadcast(changed), "slot")
