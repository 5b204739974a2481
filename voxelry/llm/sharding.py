"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own, given by an offset and a step from hashes
of its name. Shards take turns, each claiming the first slot of its order that is still free, until all are taken;
shares differ by one slot at most, and adding or removing a shard moves few keys of the others. The table's size is
a parameter, so it is broadcast with a known bound, and a key finds its shard by one hash and one lookup.

A null key counts as the empty string. Repeated rows go to one shard; other columns are ignored, and a table without
rows gives none.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{k:02d}" for k in range(16))
#: A prime, over a hundred slots for each shard.
SLOTS = 2039
#: Largest table that is broadcast (rows of two numbers).
MOST_SLOTS = 1_000_003


def hash32(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def fill(shards=SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard's number of each slot."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, and no more than slots")
    if slots > MOST_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the number of slots must be a prime up to {MOST_SLOTS}")
    offsets = [hash32(f"{s}/offset") % slots for s in shards]
    steps = [hash32(f"{s}/step") % (slots - 1) + 1 for s in shards]
    tried = [0] * len(shards)
    table = [-1] * slots
    for turn in range(slots):
        k = turn % len(shards)
        while table[at := (offsets[k] + tried[k] * steps[k]) % slots] >= 0:
            tried[k] += 1
        table[at] = k
    return table


def lookup_table(spark: SparkSession, shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """``slot, shard`` as a table made from one literal."""
    one = F.posexplode(F.split(F.lit(",".join(map(str, fill(shards, slots)))), ","))
    return spark.range(1).select(one.alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    first = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    return F.pmod(first, F.lit(slots)).cast("int")


def place(rows: DataFrame, key: str, shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and ``shard`` (in place of columns of these names)."""
    placed = rows.withColumn("slot", slot_of(F.col(f"`{key}`"), slots)).drop("shard")
    return placed.join(F.broadcast(lookup_table(rows.sparkSession, shards, slots)), "slot")


def shard_documents(docs: DataFrame) -> DataFrame:
    return place(docs.select("doc_id"), "doc_id").select("doc_id", F.col("slot").cast("long").alias("slot"), F.col("shard").cast("long").alias("shard"))


#: DuckDB's SQL for :func:`shard_documents`; the table is filled turn by turn.
ORACLE_SQL = f"""
with recursive s as (select k, ('0x' || md5(name || '/offset')[1:8])::bigint % {SLOTS} as o, ('0x' || md5(name || '/step')[1:8])::bigint % {SLOTS - 1} + 1 as d
  from (select k, 'shard-' || lpad(k::varchar, 2, '0') as name from range({len(SHARDS)}) r(k))),
f(turn, taken, slot, shard) as (
  select 0::bigint, [(select o from s where k = 0)], (select o from s where k = 0), 0::bigint
  union all
  select turn + 1, list_append(taken, nxt), nxt, (turn + 1) % {len(SHARDS)} from (
    select turn, taken, list_first(list_filter(list_transform(range({SLOTS}), lambda j: (s.o + j * s.d) % {SLOTS}), lambda p: not list_contains(taken, p))) as nxt
    from f join s on s.k = (turn + 1) % {len(SHARDS)} where turn + 1 < {SLOTS}))
select doc_id, h.slot::bigint as slot, f.shard::bigint as shard
from (select doc_id, ('0x' || md5(coalesce(doc_id::varchar, ''))[1:8])::bigint % {SLOTS} as slot from documents) h join f on f.slot = h.slot
"""
