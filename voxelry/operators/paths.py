"""Points of slices in order: shortest paths, contour matching, regions around a contour.

Paths run over all slices at once, as rounds over tables. A contour to match or to draw a curve through is a few hundred
points; those functions handle one in numpy, and the operators run them by slice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.functions.columns import orients_absdiff
from voxelry.functions.splines import Curve, wire_length
from voxelry.operators.graph import connected_components
from voxelry.operators.points import ordinal
from voxelry.operators.shortest import between
from voxelry.operators.spatial import neighbor_edges
from voxelry.storage import cut


def _pairs_of_components(points: DataFrame, edges: DataFrame, inside: Column) -> DataFrame:
    """``first, last``: of each component's points for which ``inside`` holds, the least and greatest ``id``."""
    found = connected_components(edges)
    named = points.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return named.where(inside).groupBy("component").agg(F.min("id").alias("first"), F.max("id").alias("last"))


def bridge_gaps(candidates: DataFrame, gapped: DataFrame, r: float) -> DataFrame:
    """In each slice and component of the candidates: the path of least turning from the first to the last one that is
    a gapped point too. Candidates have ``idx, z, y, x, orient``; the result is the candidates on paths.

    Of equal paths the one of fewest steps counts, then, from its end backwards, the smallest ``idx``.
    """
    keys = gapped.select("z", "y", "x").distinct().withColumn("inside", F.lit(True))
    both = ordinal(candidates.select("idx", "z", "y", "x", "orient"), "z", "idx").withColumnRenamed("ord", "id")
    p = cut(both.join(keys, ["z", "y", "x"], "left").withColumn("inside", F.coalesce("inside", F.lit(False))))
    near = cut(neighbor_edges(p.select(F.col("id").alias("idx"), "z", "y", "x"), r, ("y", "x"), ("z",)))
    of = lambda k: p.select(F.col("id").alias(k), F.col("orient").alias(f"o_{k}"))
    turning = near.join(of("src"), "src").join(of("dst"), "dst").select("src", "dst", orients_absdiff(F.col("o_src"), F.col("o_dst")).alias("weight"))
    on = between(turning, cut(_pairs_of_components(p, near, F.col("inside"))))
    return p.join(on, "id", "left_semi").select("idx", "z", "y", "x", "orient")


def simplify_by_path(points: DataFrame, r: float = 1.5) -> DataFrame:
    """In each slice and component: the points on the shortest path from the first to the last; ties as for :func:`bridge_gaps`."""
    p = cut(ordinal(points.select("idx", "z", "y", "x"), "z", "idx").withColumnRenamed("ord", "id"))
    near = cut(neighbor_edges(p.select(F.col("id").alias("idx"), "z", "y", "x"), r, ("y", "x"), ("z",)))
    on = between(near.select("src", "dst", F.col("dist").alias("weight")), cut(_pairs_of_components(p, near, F.lit(True))))
    return p.join(on, "id", "left_semi").select("idx", "z", "y", "x")


def time_warp(a: np.ndarray, b: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """The least root of summed squared distances over monotone pairings of two lines, and one such pairing."""
    cost = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    total = np.full((len(a) + 1, len(b) + 1), np.inf)
    total[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            total[i + 1, j + 1] = cost[i, j] + min(total[i, j], total[i, j + 1], total[i + 1, j])
    i, j, path = len(a), len(b), []
    while i:
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda s: total[s])
    return float(np.sqrt(total[-1, -1])), path[::-1]


def match_contours(a: np.ndarray, b: np.ndarray, closed: bool = False) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """``b`` in the order (forward, backward, and for closed ones from any start) that pairs best with ``a``, and the pairs."""
    orders = [b, b[::-1]] if not closed else [np.roll(o, k, axis=0) for o in (b, b[::-1]) for k in range(len(b))]
    warped = [time_warp(a, o) for o in orders]
    best = min(range(len(orders)), key=lambda k: (warped[k][0], k))
    return orders[best], warped[best][1]


def interpolate_along_z(points: DataFrame, closed: bool = False, by: str = "object") -> DataFrame:
    """Contours at every z between annotated ones: neighbours are matched, and pairs joined by straight lines.

    A contour object is a few annotated slices and is handled whole.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        zyx = np.rint(pdf.sort_values("idx")[["z", "y", "x"]].to_numpy(float))
        zs = np.unique(zyx[:, 0])
        now = zyx[zyx[:, 0] == zs[0], 1:]
        out = [np.column_stack([np.full(len(now), zs[0]), now])]
        for z1, z2 in zip(zs[:-1], zs[1:], strict=True):
            then, pairs = match_contours(now, zyx[zyx[:, 0] == z2, 1:], closed)
            i, j = np.array(pairs).T
            for z in np.arange(z1 + 1, z2):
                w = (z - z1) / (z2 - z1)
                out.append(np.column_stack([np.full(len(i), z), (1 - w) * now[i] + w * then[j]]))
            out.append(np.column_stack([np.full(len(then), z2), then]))
            now = then
        rows = np.concatenate(out)
        return pd.DataFrame({by: pdf[by].iloc[0], "idx": np.arange(len(rows)), "z": rows[:, 0], "y": rows[:, 1], "x": rows[:, 2]})

    kind = points.schema[by].dataType.simpleString()
    return points.select(by, "idx", "z", "y", "x").groupBy(by).applyInPandas(one, f"{by} {kind}, idx long, z double, y double, x double")


def interpolate_along_xy(points: DataFrame, degree: int = 2) -> DataFrame:
    """In each slice: a spline through the points, sampled twice a place and rounded without repeats."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        yx = np.rint(pdf.sort_values("idx")[["y", "x"]].to_numpy(float))
        yx = yx[np.sort(np.unique(yx, axis=0, return_index=True)[1])]
        if len(yx) > 1:
            dense = np.rint(Curve(yx, degree)(np.linspace(0, 1, max(2, int(2 * wire_length(yx))))))
            yx = dense[np.sort(np.unique(dense, axis=0, return_index=True)[1])]
        return pd.DataFrame({"z": pdf["z"].iloc[0], "idx": np.arange(len(yx)), "y": yx[:, 0].astype(int), "x": yx[:, 1].astype(int)})

    kind = points.schema["z"].dataType.simpleString()
    return points.select("z", "idx", "y", "x").groupBy("z").applyInPandas(one, f"z {kind}, idx long, y int, x int")


def regions_beside_contour(contour: DataFrame, extend: tuple[float, float], cut_end: bool = True, probe: int = 5) -> DataFrame:
    """``z, y, x, side``: places within reach of each slice's contour, on the side of its normals (+1) or the other (-1).

    A place's nearest contour point tells its distance and side (ties: the first point); those on the contour have no
    side. With ``cut_end``, places beyond an end are left out: they lie on the outer side of the end's normal, and
    their nearest point is among the ``probe`` points at that end. The contour has ``idx, z, y, x, ny, nx``.
    """
    reach = int(max(extend)) + 1
    shifts = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if a * a + b * b <= reach * reach))).alias("d")
    c = contour.select("z", "idx", F.rint("y").cast("int").alias("cy"), F.rint("x").cast("int").alias("cx"), F.col("ny").cast("double").alias("ny"), F.col("nx").cast("double").alias("nx"))
    places = c.select("*", shifts).select("z", "idx", "cy", "cx", "ny", "nx", (F.col("cy") + F.col("d.dy")).alias("y"), (F.col("cx") + F.col("d.dx")).alias("x")).where("y >= 0 and x >= 0")
    d2 = (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) + (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx"))
    near = places.withColumn("d2", d2).groupBy("z", "y", "x").agg(F.min(F.struct("d2", "idx", "cy", "cx", "ny", "nx")).alias("n")).select("z", "y", "x", "n.*")
    near = near.withColumn("dot", (F.col("y") - F.col("cy")) * F.col("ny") + (F.col("x") - F.col("cx")) * F.col("nx"))
    side = F.when((F.col("dot") > 0) & (F.col("d2") <= extend[0] ** 2), 1).when((F.col("dot") < 0) & (F.col("d2") <= extend[1] ** 2), -1)
    near = near.withColumn("side", side).where("side is not null")
    if cut_end:
        span = contour.groupBy("z").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
        pick = lambda k, n: contour.select("z", F.col("idx").alias(k), *(F.rint(v).alias(f"{v}_{n}") if v in "yx" else F.col(v).cast("double").alias(f"{v}_{n}") for v in ("y", "x", "ny", "nx")))
        ends = span.withColumns({"pf": F.least(F.col("first") + probe, "last"), "pl": F.greatest(F.col("last") - probe, "first")})
        for k, n in (("first", "a"), ("pf", "pa"), ("last", "b"), ("pl", "pb")):
            ends = ends.join(pick(k, n), ["z", k])
        near = near.join(ends, "z")
        for n, inside in (("a", F.col("idx") < F.col("pf")), ("b", F.col("idx") > F.col("pl"))):
            size = F.sqrt(F.col(f"ny_{n}") * F.col(f"ny_{n}") + F.col(f"nx_{n}") * F.col(f"nx_{n}"))
            ny, nx = F.col(f"ny_{n}") / size, F.col(f"nx_{n}") / size
            dy, dx = F.col(f"y_{n}") - F.col(f"y_p{n}"), F.col(f"x_{n}") - F.col(f"x_p{n}")
            along = dy * ny + dx * nx
            outer = (F.col("y") - F.col(f"y_{n}")) * (dy - along * ny) + (F.col("x") - F.col(f"x_{n}")) * (dx - along * nx)
            near = near.where(~((outer >= 0) & inside))
    return near.select("z", "y", "x", "side")
