"""Clouds of points: rows of ``idx, z, y, x``; ``idx`` carries the order, which many operators depend on."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelry.functions.columns import cross, distance2, half_even, norm

ZYX = ("z", "y", "x")


def rasterize(points: DataFrame, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Places of rounded points (halves to even); those outside ``shape`` are dropped."""
    p = points.select(*(half_even(F.col(c)).alias(c) for c in ZYX))
    for c, n in zip(ZYX, shape or (), strict=False):
        p = p.where((F.col(c) >= 0) & (F.col(c) < n))
    return p.distinct()


def reverse_coord(points: DataFrame) -> DataFrame:
    """z and x exchanged."""
    return points.withColumns({"z": F.col("x"), "x": F.col("z")})


def points_range(points: DataFrame, margin: float | tuple[float, ...] = 0, clip_neg: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """``lo_c, hi_c, n_c`` for each axis c: the integer box around the points, widened by the margin."""
    margins = margin if isinstance(margin, tuple) else (margin,) * 3
    low = [F.floor(F.min(c)) - math.ceil(m) for c, m in zip(ZYX, margins, strict=True)]
    high = [F.ceil(F.max(c)) + math.ceil(m) for c, m in zip(ZYX, margins, strict=True)]
    low = [F.greatest(a, F.lit(0)) for a in low] if clip_neg else low
    cols = [c for k, n in enumerate(ZYX) for c in (low[k].cast("long").alias(f"lo_{n}"), high[k].cast("long").alias(f"hi_{n}"), (high[k] - low[k] + 1).cast("long").alias(f"n_{n}"))]
    return points.groupBy(*by).agg(*cols) if by else points.agg(*cols)


def deduplicate(points: DataFrame, count: bool = False) -> DataFrame:
    """Rounded points without repeats, each with the smallest ``idx``, and with ``count`` how often it came."""
    rounded = points.select("idx", *(half_even(F.col(c)).alias(c) for c in ZYX))
    aggs = [F.min("idx").alias("idx"), *([F.count("*").alias("n")] if count else [])]
    return rounded.groupBy(*ZYX).agg(*aggs)


def in_region(points: DataFrame, region: DataFrame, bounds: tuple[int, int, int]) -> DataFrame:
    """Points within ``bounds`` whose truncated place is in the region."""
    p = points
    for c, n in zip(ZYX, bounds, strict=True):
        p = p.where((F.col(c) >= 0) & (F.col(c) < n))
    keys = region.select(*(F.col(c).cast("int").alias(f"__{c}") for c in ZYX)).distinct()
    on = [F.col(c).cast("int") == F.col(f"__{c}") for c in ZYX]
    return p.join(keys, on, "left_semi")


def wireframe_length(points: DataFrame, by: tuple[str, ...] = ("z",), order: str = "idx", axes: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """``length`` of the line through each group's points in order."""
    line = Window.partitionBy(*by).orderBy(order)
    step = norm(*(F.col(c).cast("double") - F.lag(c).over(line) for c in axes))
    return points.withColumn("__d", F.coalesce(step, F.lit(0.0))).groupBy(*by).agg(F.sum("__d").alias("length"))


def normals_tangent(points: DataFrame) -> DataFrame:
    """Two tangents of each normal ``nz, ny, nx``: one in the plane of y and x, one across."""
    n = tuple(F.col(f"n{c}").cast("double") for c in ZYX)
    t = (F.lit(0.0), -n[2], n[1])
    b = cross(n, t)
    return points.withColumns({f"t{c}": v for c, v in zip(ZYX, t, strict=True)} | {f"b{c}": v for c, v in zip(ZYX, b, strict=True)})


def in_hull(points: DataFrame, facets: list[tuple[float, float, float, float]], eps: float = 1e-9) -> DataFrame:
    """Points on the inner side of all facets (az, ay, ax, b); facets are a parameter, tried in one pass over the rows."""

    @F.pandas_udf("boolean")
    def inside(z: pd.Series, y: pd.Series, x: pd.Series) -> pd.Series:
        z, y, x = (c.to_numpy(float) for c in (z, y, x))
        ok = np.ones(len(z), bool)
        for az, ay, ax, b in facets:
            ok &= az * z + ay * y + ax * x + b < eps
        return pd.Series(ok)

    return points.where(inside(*(F.col(c).cast("double") for c in ZYX)))


def sort_clouds_by_ref(points: DataFrame, ref: tuple[float, float, float], cloud: str = "cloud") -> DataFrame:
    """Clouds with their smallest squared distance ``d2`` to a point and their ``place`` in that order.

    Clouds are few (labels); the order runs over one row for each.
    """
    d2 = distance2(tuple(F.col(c).cast("double") for c in ZYX), tuple(F.lit(float(v)) for v in ref))
    least = points.groupBy(cloud).agg(F.min(d2).alias("d2"))
    return least.withColumn("place", F.row_number().over(Window.orderBy("d2", cloud)))


def sort_by_pca(points: DataFrame) -> DataFrame:
    """Adds ``score``, the place along the first principal axis of all (y, x), and ``place``, the order in each slice."""
    m = points.agg(F.avg("y"), F.avg("x"), F.var_pop("y"), F.var_pop("x"), F.covar_pop("y", "x")).first()
    my, mx, vy, vx, c = (float(v or 0) for v in m)
    a = 0.5 * math.atan2(2 * c, vx - vy)
    score = (F.col("x") - mx) * math.cos(a) + (F.col("y") - my) * math.sin(a)
    return points.withColumn("score", score).withColumn("place", F.row_number().over(Window.partitionBy("z").orderBy(F.round("score", 6), "idx")))


def covariance(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means and the covariance matrix of z, y and x, of all rows or of each group."""
    aggs = [F.avg(c).alias(f"m{c}") for c in ZYX] + [F.covar_pop(a, b).alias(f"c{a}{b}") for k, a in enumerate(ZYX) for b in ZYX[k:]]
    return (points.groupBy(*by) if by else points.groupBy()).agg(F.count("*").alias("n"), *aggs)


def reference_point(points: DataFrame, dist: float | None = None) -> tuple[float, float, float]:
    """A point beside the cloud: its centre plus ``dist`` (by default the size of its box) times PC1 x z."""
    r = covariance(points).join(points.agg(*(F.max(c) - F.min(c) for c in ZYX)).toDF("rz", "ry", "rx")).first()
    m = np.array([[r[f"c{min(a, b, key=ZYX.index)}{max(a, b, key=ZYX.index)}"] for b in ZYX] for a in ZYX])
    pc1 = np.linalg.eigh(m)[1][:, -1]
    size = dist if dist is not None else float(np.linalg.norm([r["rz"], r["ry"], r["rx"]]))
    ref = np.array([r["mz"], r["my"], r["mx"]]) + size * np.cross(pc1, [1.0, 0.0, 0.0])
    return tuple(float(v) for v in ref)


def ordinal(df: DataFrame, outer: str, *inner: str):
    """``df`` with ``ord``, its place from 0 in the order of ``outer`` and ``inner``: counts of the outer values, then a window in each."""
    counts = df.groupBy(outer).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy(outer)) - F.col("__n")
    place = F.row_number().over(Window.partitionBy(outer).orderBy(*inner)) - 1
    return df.join(counts.select(outer, before.alias("__before")), outer).withColumn("ord", (F.col("__before") + place).cast("long")).drop("__before")
