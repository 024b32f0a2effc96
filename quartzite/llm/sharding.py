"""Shard placement by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own (a start and a step from hashes of its name).  The
shards take turns, each claiming the next free slot it prefers, until the table is full: all have the same number of slots, give
or take one, and a shard that comes or goes moves few others.  A row's slot is its key's hash modulo the prime, its shard is the
table's entry: the table goes to all executors once, its size is the prime, and no row moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime, some thousand times the number of shards.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the place of its shard in `shards`, which are distinct; the turns go by name, so their order doesn't matter."""
    if len(set(shards)) != len(shards) or not 0 < len(shards) <= slots or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("shards must be distinct, and slots a prime not under their number")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    at = [_number(f"start {shards[i]}") % slots for i in order]
    step = [_number(f"step {shards[i]}") % (slots - 1) + 1 if slots > 1 else 0 for i in order]
    table, free = [-1] * slots, slots
    while True:
        for k, i in enumerate(order):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = i
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key; null counts as the empty string."""
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign_shards(df: DataFrame, key_col: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """`df` with slot int and shard string, both by the key alone: equal keys and repeated rows go together, a null key like ''.

    Input columns slot and shard are replaced (one of them may be the key), all others pass through; long keys are hashed whole; an
    empty table stays empty.
    """
    spark = df.sparkSession
    table = lookup_table(shards, slots)
    names = [c for c in df.columns if c not in ("slot", "shard")]
    entries = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(table)], "of int, name string")
    src = df.select(F.struct(*names).alias("row") if names else F.lit(0).alias("row"), slot_of(F.col(key_col), slots).alias("slot"))
    return src.join(F.broadcast(entries), F.col("slot") == F.col("of")).select(*(F.col("row")[n].alias(n) for n in names), "slot", F.col("name").alias("shard"))


def write_shards(df: DataFrame, key_col: str, path: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS, files: int = 8) -> None:
    """Write Parquet partitioned by shard, each in up to `files` files by slot, so that no shard is one task."""
    placed = assign_shards(df, key_col, shards, slots)
    placed.repartition(len(shards) * files, "shard", F.pmod(F.col("slot"), F.lit(files))).write.partitionBy("shard").parquet(path)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id")


#: The table as one string of letters, a letter a slot.
ORACLE_SQL = {
    "op7_sharding": f"""
WITH s AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(CAST(ascii(substr('{"".join(chr(65 + i) for i in lookup_table(SHARDS))}', slot + 1, 1)) - 65 AS VARCHAR), 2, '0') AS shard FROM s""",
}
