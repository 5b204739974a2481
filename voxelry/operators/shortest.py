"""Cheapest paths of many sources at once, by rounds of a frontier over tables.

A vertex's state is the least (length, number of edges, vertex before) known. In a round the vertices whose state has
improved offer one to their neighbours; offers and states meet by vertex in one aggregation. ``STEPS`` rounds make one job.
Paths are then marked from their ends backwards by pointer doubling, so a path of n edges takes log n joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.storage import cut, cut_buckets, dropped

STEPS = 6


def least_lengths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``id, length, hops, before`` of all vertices that a start (``id``) reaches over ``src, dst, weight``, each edge both ways.

    Of equally long ways the one with fewest edges counts, then the smallest vertex before; weights must not be negative.
    A vertex that several starts reach belongs to the nearest.
    """
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    near = cut_buckets(both.groupBy(F.col("src").alias("id")).agg(F.collect_list(F.struct("dst", "weight")).alias("near")), "id")
    kind = dict(e.dtypes)["src"]
    state = F.struct(F.lit(0.0).alias("length"), F.lit(0).alias("hops"), F.lit(None).cast(kind).alias("before"))
    now = cut(starts.select("id").distinct().select("id", state.alias("s"), F.lit(True).alias("fresh")))
    while True:
        table = now
        for _ in range(STEPS):
            own = F.array(F.struct(F.col("id"), F.col("s"), F.lit(True).alias("own")))
            offer = lambda v: F.struct(v["dst"].alias("id"), F.struct((F.col("s.length") + v["weight"]).alias("length"), (F.col("s.hops") + 1).alias("hops"), F.col("id").alias("before")).alias("s"), F.lit(False).alias("own"))
            offers = F.when(F.col("fresh") & F.col("near").isNotNull(), F.concat(own, F.transform("near", offer))).otherwise(own)
            met = table.join(near, "id", "left").select(F.explode(offers).alias("o")).select("o.*")
            best = met.groupBy("id").agg(F.min("s").alias("s"), F.min(F.when(F.col("own"), F.col("s"))).alias("old"))
            table = best.select("id", "s", F.coalesce(F.col("old.length") > F.col("s.length"), F.lit(False)).alias("shorter"), F.coalesce(F.col("old.hops") > F.col("s.hops"), F.lit(False)).alias("fewer"), F.col("old").isNull().alias("new"))
            table = table.select("id", "s", (F.col("new") | F.col("shorter") | F.col("fewer")).alias("fresh"))
        new = cut(table)
        dropped(now)
        now = new
        if now.where("fresh").isEmpty():
            return now.select("id", "s.length", "s.hops", "s.before")


def paths(lengths: DataFrame, ends: DataFrame) -> DataFrame:
    """``id`` of the vertices on the ways to the ends (``id``) that are reached."""
    on = cut(ends.select("id").distinct().join(lengths, "id", "left_semi"))
    jump = cut(lengths.where("before is not null").select("id", F.col("before").alias("to")))
    while not jump.isEmpty():
        new = cut(on.unionByName(on.join(jump, "id").select(F.col("to").alias("id"))).distinct())
        further = cut(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")))
        dropped(on, jump)
        on, jump = new, further
    return on


def between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id`` on the cheapest ways from ``first`` to ``last`` of each pair, where pairs lie in components of their own."""
    ways = cut(least_lengths(edges, pairs.select(F.col("first").alias("id"))))
    return paths(ways, pairs.select(F.col("last").alias("id")))
