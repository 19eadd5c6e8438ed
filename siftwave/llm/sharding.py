"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own (an offset and a step, both
from a hash of its name). Shards take turns claiming their next free slot until none is left, so slot
counts differ by one at most, and a shard that comes or goes moves few keys. A document goes to the
shard of slot hash(doc_id) mod size; the table is broadcast (`size` rows), so placement is one lookup.

Defined cases: a null doc_id is placed like the empty key; repeated rows share a shard; an empty table
gives an empty result; other columns are kept, but shard and slot are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
N_SHARDS = 256


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The index of the owning shard for each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not is_prime(size) or size < len(shards):
        raise ValueError("size must be a prime of at least the number of shards")
    digests = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in digests]
    step = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 for d in digests]
    owner = [-1] * size
    left = size
    while left:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def place(df: DataFrame, shards: list[str], size: int = TABLE_SIZE, key: str = "doc_id") -> DataFrame:
    """`df` with slot and shard; `size` bounds the broadcast table."""
    spark = df.sparkSession
    rows = [(slot, shards[i]) for slot, i in enumerate(lookup_table(shards, size))]
    table = spark.createDataFrame(rows, "slot int, shard string")
    kept = df.drop("slot", "shard")
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")
    return kept.withColumn("slot", (hashed % size).cast("int")).join(F.broadcast(table), "slot")


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, [f"shard-{i:04d}" for i in range(N_SHARDS)]).select("doc_id", "slot", "shard")
