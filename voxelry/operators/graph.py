"""Graphs as tables of edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.storage import cut, dropped


#: Edges up to which one task finds the components in one go.
AT_ONCE = 100_000


def _joined(edges: DataFrame) -> DataFrame:
    """(id, component) by one task's union of sets: for tables of a checked size only."""

    def work(batches):
        root: dict[int, int] = {}

        def top(v: int) -> int:
            while root.setdefault(v, v) != v:
                root[v] = v = root[root[v]]
            return v

        for pdf in batches:
            for u, v in pdf.itertuples(index=False):
                a, b = top(u), top(v)
                root[max(a, b)] = min(a, b)
        yield pd.DataFrame({"id": list(root), "component": [top(v) for v in root]}, dtype="int64")

    return edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).coalesce(1).mapInPandas(work, "id long, component long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) of every vertex of ``edges``; a component is named by its smallest vertex.

    Alternates large-star and small-star steps: a vertex links its larger neighbours, then its smaller ones, to its
    smallest neighbour, until nothing changes. At most ``AT_ONCE`` edges, counted first, are left to one task, with the
    same result. Smallest neighbours are aggregates, combined before the shuffle, and
    written before they are joined, so that Spark can split the partition of a vertex with very many edges.
    """
    u, v = F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")
    now = cut(edges.where(F.col(src) != F.col(dst)).select(u, v).distinct())
    kind = now.schema["u"].dataType.simpleString()
    if kind in ("int", "bigint") and now.count() <= AT_ONCE:
        return _joined(now).select(*(F.col(c).cast(kind) for c in ("id", "component")))
    before = None
    while (state := _state(now)) != before:
        before, old = state, now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least2 = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least2.select("u", F.col("m").alias("v"))).distinct())
        dropped(old, least, large, least2)
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
