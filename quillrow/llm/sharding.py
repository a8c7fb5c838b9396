"""Sharding by a permutation-filled lookup table. DataFrame functions only.

Each shard prefers the slots of a table of prime size in an order of its own (an offset and a
stride); in turn the shards claim their next free slot until the table is full. The table has a
fixed size, so it is broadcast, and a key's place is one hash and one lookup. When a shard joins
or leaves, few slots but its own change hands.

Defined cases: a null key hashes as the empty text; equal keys share a shard; rows that repeat are
all placed; an empty table gives an empty result. All columns of the input are kept by ``place``;
an input column named slot or shard gets the name given_slot or given_shard.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrow.llm.common import table

SHARDS = 64
#: Prime, over a hundred times the shards, so that their shares differ by under one per cent.
SLOTS = 8191


def preference(name: str, slots: int) -> tuple[int, int]:
    """Offset and stride of a shard's order of slots."""
    offset, stride = (int(hashlib.md5(f"{kind}:{name}".encode()).hexdigest()[:12], 16) for kind in ("offset", "stride"))
    return offset % slots, stride % (slots - 1) + 1


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not names or slots < len(names) or slots < 2 or any(slots % k == 0 for k in range(2, math.isqrt(slots) + 1)):
        raise ValueError("the table needs a prime size, and shards that it can hold")
    owner, orders, claimed = [-1] * slots, [preference(n, slots) for n in names], 0
    following = [0] * len(names)
    while True:
        for shard, (offset, stride) in enumerate(orders):
            while owner[at := (offset + following[shard] * stride) % slots] >= 0:
                following[shard] += 1
            owner[at] = shard
            claimed += 1
            if claimed == slots:
                return owner


def lookup_table(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): as many rows as slots."""
    owners = ",".join(map(str, fill(names, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner")).select("slot", F.col("owner").cast("int").alias("shard"))


def place(df: DataFrame, key: str, names: list[str], slots: int = SLOTS) -> DataFrame:
    """df with the slot and the shard of each row's key."""
    given = {c: f"given_{c}" for c in ("slot", "shard") if c in df.columns}
    if taken := set(given.values()).intersection(df.columns):
        raise ValueError(f"columns {sorted(taken)} stand in the way of {sorted(given)}")
    digest = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8)
    slot = (F.conv(digest, 16, 10).cast("long") % slots).cast("int")
    shards = F.broadcast(lookup_table(df.sparkSession, names, slots))  # bounded by slots
    kept = [given.get(c, c) for c in df.columns]
    own = df.select(*(F.col(f"`{c}`").alias(name) for c, name in zip(df.columns, kept, strict=True)), slot.alias("slot"))
    return own.join(shards, "slot").select(*(F.col(f"`{c}`") for c in kept), "slot", "shard")


def write_shards(df: DataFrame, path: str) -> None:
    """Placed rows as Parquet, a folder for each shard; tasks that would be too large are split."""
    df.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def op7_sharding(spark, sf_dir):
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", [f"shard-{k:03d}" for k in range(SHARDS)])


QUERIES = {"op7_sharding": op7_sharding}
ORACLE_SQL = {
    "op7_sharding": f"""
WITH owners AS (SELECT [{", ".join(map(str, fill([f"shard-{k:03d}" for k in range(SHARDS)])))}] AS owner)
SELECT doc_id, slot, owner[slot + 1]::INTEGER AS shard
FROM (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SLOTS})::INTEGER AS slot FROM documents), owners"""
}
