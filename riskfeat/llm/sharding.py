"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size. The
shards take turns; at its turn a shard claims the first slot in its order that is still
free, until the table is full. So each shard gets the same number of slots, give or take
one, and a shard that goes or comes leaves most other slots where they were. The table
has ``size`` rows, a parameter and not a matter of the data; it is broadcast, and a row
finds its shard by one hash and one lookup. DataFrame functions only.

Defined results: a null key has the fixed slot of the empty hash input; repeated keys go
to the same shard; no rows give no rows. Columns of the input named ``slot`` or ``shard``
are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = [f"shard-{i:02d}" for i in range(64)]
SIZE = 8191
HEX_DIGITS = 15  # of an md5: below 2**60


def _hash(text: str, seed: str) -> int:
    return int(hashlib.md5(f"{seed}:{text}".encode()).hexdigest()[:HEX_DIGITS], 16)


def lookup_table(shards: list[str] = SHARDS, size: int = SIZE) -> list[int]:
    """The number of the shard that owns each slot."""
    if not shards or len({*shards}) != len(shards) or size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("give distinct shards and a prime size of at least their number")
    places = [_hash(s, "offset") % size for s in shards]
    steps = [_hash(s, "skip") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while True:
        for shard, step in enumerate(steps):
            while table[places[shard]] >= 0:
                places[shard] = (places[shard] + step) % size
            table[places[shard]] = shard
            free -= 1
            if not free:
                return table


def slot(key: Column, size: int = SIZE) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long") % size).cast("int")


def table_frame(spark: SparkSession, table: list[int]) -> DataFrame:
    """The table as rows (slot, shard)."""
    cells = F.split(F.lit(",".join(map(str, table))), ",")
    return spark.range(1).select(F.posexplode(cells).alias("slot", "shard")).select("slot", F.col("shard").cast("int"))


def place(df: DataFrame, key: str, shards: list[str] = SHARDS, size: int = SIZE) -> DataFrame:
    """The rows with their slot and the number of their shard."""
    table = table_frame(df.sparkSession, lookup_table(shards, size))
    return df.drop("slot", "shard").withColumn("slot", slot(F.col(key), size)).join(F.broadcast(table), "slot")


def write_shards(df: DataFrame, key: str, path: str, shards: list[str] = SHARDS, size: int = SIZE, files: int = 4) -> None:
    """One folder a shard under ``path``. Rows are dealt by shard and one of ``files``
    salts, so a shard is not one task."""
    placed = place(df, key, shards, size)
    salt = F.pmod(F.xxhash64(key), F.lit(files))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)
