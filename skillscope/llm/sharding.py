"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime
size (start and step come from two hashes of its name; a prime size makes any
step visit every slot).  Shards take turns: on its turn a shard claims the
first slot of its order that is still free.  The filled table is as even as the
weights allow, and adding or removing a shard moves few slots besides its own.
Rows are placed by one hash of their key and one lookup.

The table has ``size`` entries whatever the input, so it is broadcast: its
size is a parameter, not a function of the data.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime number of slots; more than a hundred for each shard keeps shares within one percent.
SLOTS = 65537


def lookup_table(shards: list[str], size: int = SLOTS, weights: dict[str, float] | None = None) -> list[int]:
    """Index of the owning shard for every slot.

    ``weights`` (default 1 each, positive) are relative shares: in each round a
    shard earns ``weight / max(weight)`` turns.  Shards are taken in name order,
    so the result does not depend on the order of the list.  Raises ValueError
    for no shards, repeated names, weights that are not positive, or a size
    that is not prime or is below the number of shards."""
    names = sorted(shards)
    if not names or len(set(names)) < len(names):
        raise ValueError("shards must be distinct and at least one")
    if size < max(2, len(names)) or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("size must be a prime of at least the number of shards")
    share = [float((weights or {}).get(n, 1.0)) for n in names]
    if min(share) <= 0:
        raise ValueError("weights must be positive")
    share = [s / max(share) for s in share]
    position = [xxhash.xxh64_intdigest(n, 1) % size for n in names]
    step = [xxhash.xxh64_intdigest(n, 2) % (size - 1) + 1 for n in names]
    owner, credit, left = [-1] * size, [0.0] * len(names), size
    index = {n: i for i, n in enumerate(shards)}
    while left:
        for k, name in enumerate(names):
            credit[k] += share[k]
            if credit[k] < 1 or not left:
                continue
            credit[k] -= 1
            while owner[position[k]] >= 0:
                position[k] = (position[k] + step[k]) % size
            owner[position[k]] = index[name]
            left -= 1
    return owner


def slot_of(keys: list[Column], size: int = SLOTS) -> Column:
    """Slot of a row: a 64-bit hash of its key columns, reduced to the table.

    Null keys hash like any other value, so they have a defined slot."""
    return F.pmod(F.xxhash64(*keys), F.lit(size)).cast("int")


def table_frame(spark: SparkSession, shards: list[str], size: int = SLOTS,
                weights: dict[str, float] | None = None) -> DataFrame:
    """The lookup table as a frame (slot, shard)."""
    owner = lookup_table(shards, size, weights)
    return spark.createDataFrame(pa.table({"slot": pa.array(range(size), pa.int32()),
                                           "shard": pa.array([shards[i] for i in owner], pa.string())}))


def assign(df: DataFrame, keys: list[str], shards: list[str], size: int = SLOTS,
           weights: dict[str, float] | None = None) -> DataFrame:
    """Rows of ``df``, each as struct ``row``, with their ``slot`` and ``shard``.

    One narrow pass: no shuffle, one broadcast of ``size`` small rows.  Equal
    keys always meet in one shard, repeated rows are all kept, an empty table
    gives no rows, and the input's columns stay inside ``row`` so that their
    names cannot clash."""
    table = F.broadcast(table_frame(df.sparkSession, shards, size, weights))
    placed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                       slot_of([F.col(f"`{k}`") for k in keys], size).alias("slot"))
    return placed.join(table, "slot")


def write_shards(placed: DataFrame, path: str) -> None:
    """Write the result of :func:`assign` as one folder for each shard.

    Every task writes its own file into each folder, so no shard, however
    heavy, has to pass through one task."""
    placed.select("row.*", F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)
