"""Normals, hulls and triangle meshes.

Meshes are tables, ``vid, z, y, x`` and ``tid, a, b, c``, refined by joins on edges. Normals and hulls of one cloud
are worked out in numpy, a cloud at a time.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.operators.points import ZYX

COLUMNS = list(ZYX)


class Cells:
    """Points by cells of the radius, for neighbours within it."""

    def __init__(self, p: np.ndarray, r: float):
        self.p, self.r, self.at = p, r, {}
        for k, c in enumerate(map(tuple, np.floor(p / r).astype(int))):
            self.at.setdefault(c, []).append(k)

    def near(self, q: np.ndarray) -> np.ndarray:
        c = np.floor(q / self.r).astype(int)
        k = [i for a in (-1, 0, 1) for b in (-1, 0, 1) for d in (-1, 0, 1) for i in self.at.get((c[0] + a, c[1] + b, c[2] + d), ())]
        k = np.array(k, int)
        return k[((self.p[k] - q) ** 2).sum(axis=1) <= self.r * self.r] if len(k) else k


def point_normals(p: np.ndarray, r: float, ref: np.ndarray | None = None, neighbours: int = 10) -> np.ndarray:
    """Normals by the least principal axis within ``r``, turned alike along a tree of least turning, and all away from ``ref``."""
    near = Cells(p, r)
    n = np.zeros_like(p)
    around = []
    for k, q in enumerate(p):
        i = near.near(q)
        around.append(i)
        n[k] = np.linalg.eigh(np.cov(p[i].T))[1][:, 0] if len(i) > 2 else np.array([0.0, 0.0, 1.0])
    seen = np.zeros(len(p), bool)
    for start in range(len(p)):
        if seen[start]:
            continue
        queue = [(0.0, start, start)]
        while queue:
            _, k, before = heapq.heappop(queue)
            if seen[k]:
                continue
            seen[k] = True
            if n[k] @ n[before] < 0:
                n[k] = -n[k]
            i = around[k]
            if len(i) > neighbours:
                i = i[np.argsort(((p[i] - p[k]) ** 2).sum(axis=1), kind="stable")[: neighbours + 1]]
            for j in i:
                if not seen[j]:
                    heapq.heappush(queue, (1 - abs(float(n[j] @ n[k])), int(j), k))
    if ref is not None and len(p):
        k = ((p - ref) ** 2).sum(axis=1).argmin()
        if n[k] @ (p[k] - ref) < 0:
            n = -n
    return n


def hull_facets(p: np.ndarray, eps: float = 1e-9) -> np.ndarray:
    """Outward planes (az, ay, ax, b) of the convex hull, points inside where a p + b <= 0."""
    return _hull(p, eps)[0]


def _hull(p: np.ndarray, eps: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """The hull's planes and the corners they were drawn through; by adding the furthest point outside, one by one.

    A point inside once is so for good, so few are left to look at after a few steps.
    """
    p = np.unique(np.asarray(p, float), axis=0)
    scale = float(np.ptp(p, axis=0).max()) if len(p) else 0.0
    tol = eps * max(scale, 1.0)

    def corners() -> list[int] | None:
        a = int(p[:, 0].argmin())
        d = np.linalg.norm(p - p[a], axis=1)
        b = int(d.argmax())
        if d[b] <= tol:
            return None
        d = np.linalg.norm(np.cross(p - p[a], p[b] - p[a]), axis=1)
        c = int(d.argmax())
        if d[c] <= tol * scale:
            return None
        d = np.abs((p - p[a]) @ np.cross(p[b] - p[a], p[c] - p[a]))
        e = int(d.argmax())
        return None if d[e] <= tol * scale * scale else [a, b, c, e]

    first = corners() if len(p) >= 4 else None
    if first is None:
        raise ValueError("a hull needs four points that are not in one plane")
    inside = p[first].mean(axis=0)

    def facet(t: tuple[int, int, int]) -> tuple[tuple[int, int, int], np.ndarray, float]:
        n = np.cross(p[t[1]] - p[t[0]], p[t[2]] - p[t[0]])
        n = n / np.linalg.norm(n)
        b = -float(n @ p[t[0]])
        return (t, n, b) if n @ inside + b < 0 else ((t[0], t[2], t[1]), -n, -b)

    facets = [facet(t) for t in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)) for t in [tuple(first[i] for i in t)]]
    planes = np.array([[*n, b] for _, n, b in facets])
    rest = np.arange(len(p))
    while True:
        above = p[rest] @ planes[:, :3].T + planes[:, 3]
        top = above.max(axis=1, initial=-np.inf)
        if not (top > tol).any():
            break
        far = int(top.argmax())
        k, seen = int(rest[far]), above[far] > tol
        top[far] = -np.inf
        rest = rest[top > tol]
        edges: dict[tuple[int, int], int] = {}
        for (t, _, _), s in zip(facets, seen, strict=True):
            if s:
                for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                    edges[e] = edges.get(e, 0) + 1
        rim = [e for e in edges if (e[1], e[0]) not in edges]
        facets = [f for f, s in zip(facets, seen, strict=True) if not s]
        for e in rim:
            if np.linalg.norm(np.cross(p[e[1]] - p[e[0]], p[k] - p[e[0]])) > tol * tol:
                facets.append(facet((*e, k)))
        planes = np.array([[*n, b] for _, n, b in facets])
    return planes, p[sorted({i for t, _, _ in facets for i in t})]


def convex_hull(points: DataFrame, sigma: float = 0.0, limit: int = 200_000) -> list[tuple[float, float, float, float]]:
    """Facets of the hull of a cloud, and with ``sigma`` of the points moved that far along ``nz, ny, nx`` and back.

    Each partition keeps the corners of its own hull, then again those of the partitions together, so few points reach
    the driver; ``limit`` bounds them.
    """
    moved = points.select(*(F.col(c).cast("double").alias(c) for c in COLUMNS))
    if sigma:
        for s in (sigma, -sigma):
            moved = moved.unionByName(points.select(*((F.col(c) + s * F.col(f"n{c}")).alias(c) for c in COLUMNS)))

    def corners(batches):
        kept = np.empty((0, 3))
        for pdf in batches:
            kept = np.unique(np.concatenate([kept, pdf[COLUMNS].to_numpy(float)]), axis=0)
            try:
                kept = _hull(kept)[1]
            except ValueError:
                pass
        yield pd.DataFrame(kept, columns=COLUMNS)

    got = moved.dropna().distinct().mapInPandas(corners, "z double, y double, x double").limit(limit + 1).toPandas().to_numpy(float)
    if len(got) > limit:
        raise ValueError("the cloud has too many corners for one hull")
    return [tuple(float(v) for v in f) for f in hull_facets(got)]


def mesh_edges(triangles: DataFrame) -> DataFrame:
    """``a < b`` and the opposite vertex ``o`` of each triangle at the edge."""
    sides = F.explode(F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), F.col(o).alias("o")) for p, q, o in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b"))))).alias("e")
    return triangles.select("tid", sides).select("tid", "e.*")


def subdivide(vertices: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of Loop's subdivision: each triangle becomes four, and vertices move to the usual weighted means.

    Edges with one triangle are the boundary; vertices there depend on the boundary only.
    """
    edges = mesh_edges(triangles).groupBy("a", "b").agg(F.count("*").alias("n"), F.collect_list("o").alias("o")).withColumn("mid", F.xxhash64("a", "b"))
    v = lambda k: vertices.select(F.col("vid").alias(k), *(F.col(c).cast("double").alias(f"{c}_{k}") for c in COLUMNS))
    ends = edges.join(v("a"), "a").join(v("b"), "b")
    opposite = edges.select("mid", F.explode("o").alias("p")).join(v("p"), "p").groupBy("mid").agg(*(F.sum(f"{c}_p").alias(f"{c}_o") for c in COLUMNS))
    middle = lambda c: F.when(F.col("n") == 2, 0.375 * (F.col(f"{c}_a") + F.col(f"{c}_b")) + 0.125 * F.col(f"{c}_o")).otherwise(0.5 * (F.col(f"{c}_a") + F.col(f"{c}_b"))).alias(c)
    new = ends.join(opposite, "mid").select(F.col("mid").alias("vid"), *(middle(c) for c in COLUMNS))

    both = ends.select("n", "a", "b", *(f"{c}_{k}" for k in "ab" for c in COLUMNS))
    spokes = both.select(F.col("a").alias("vid"), "n", *(F.col(f"{c}_b").alias(c) for c in COLUMNS)).unionByName(both.select(F.col("b").alias("vid"), "n", *(F.col(f"{c}_a").alias(c) for c in COLUMNS)))
    rim = lambda c: F.sum(F.when(F.col("n") == 1, F.col(c))).alias(f"rim_{c}")
    sums = spokes.groupBy("vid").agg(F.count("*").alias("k"), F.max((F.col("n") == 1).cast("int")).alias("at_rim"), *(F.sum(c).alias(f"all_{c}") for c in COLUMNS), *(rim(c) for c in COLUMNS))
    inner = F.lit(0.625) - F.pow(0.375 + 0.25 * F.cos(F.lit(2 * np.pi) / F.col("k")), F.lit(2))
    beta = inner / F.col("k")
    moved = lambda c: F.when(F.col("at_rim") == 1, 0.75 * F.col(c) + 0.125 * F.col(f"rim_{c}")).otherwise((1 - F.col("k") * beta) * F.col(c) + beta * F.col(f"all_{c}")).alias(c)
    old = vertices.join(sums, "vid").select("vid", *(moved(c) for c in COLUMNS))

    mid = lambda p, q: F.xxhash64(F.least(p, q), F.greatest(p, q))
    ab, bc, ca = mid("a", "b"), mid("b", "c"), mid("c", "a")
    parts = F.posexplode(F.array(*(F.struct(x.alias("a"), y.alias("b"), z.alias("c")) for x, y, z in ((F.col("a"), ab, ca), (ab, F.col("b"), bc), (ca, bc, F.col("c")), (ab, bc, ca))))).alias("k", "t")
    finer = triangles.select("tid", "a", "b", "c", parts).select((F.col("tid") * 4 + F.col("k")).alias("tid"), "t.*")
    return old.unionByName(new), finer


def subdivide_to(vertices: DataFrame, triangles: DataFrame, spacing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Rounds of subdivision until neighbours are about ``spacing`` apart: log2 of the largest L1 distance to a nearest vertex."""
    v = lambda k: vertices.select(F.col("vid").alias(k), *(F.col(c).cast("double").alias(f"{c}_{k}") for c in COLUMNS))
    ends = mesh_edges(triangles).select("a", "b").distinct().join(v("a"), "a").join(v("b"), "b")
    l1 = sum((F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) for c in COLUMNS[1:]), F.abs(F.col("z_a") - F.col("z_b")))
    each = ends.select(F.explode(F.array("a", "b")).alias("vid"), l1.alias("d")).groupBy("vid").agg(F.min("d").alias("d"))
    widest = each.agg(F.max("d")).first()[0]
    for _ in range(max(0, int(np.ceil(np.log2(widest / spacing)))) if widest else 0):
        vertices, triangles = subdivide(vertices, triangles)
    return vertices, triangles


def surround(triangles: DataFrame, chosen: DataFrame) -> DataFrame:
    """``vid`` of the chosen vertices and of all triangles that touch the boundary of the mesh they span."""
    own = triangles
    for c in "abc":
        own = own.join(chosen.select(F.col("vid").alias(c)), c, "left_semi")
    rim = mesh_edges(own).groupBy("a", "b").count().where(F.col("count") != 2).select(F.explode(F.array("a", "b")).alias("vid")).distinct()
    touching = triangles.select("tid", F.explode(F.array("a", "b", "c")).alias("vid")).join(rim, "vid", "left_semi").select("tid").distinct()
    more = triangles.join(touching, "tid", "left_semi").select(F.explode(F.array("a", "b", "c")).alias("vid"))
    return chosen.select("vid").unionByName(more).distinct()


def smooth_surface(p: np.ndarray, sigma: float, spacing: float = 1.0) -> np.ndarray:
    """Places on a smooth surface through a cloud: heights over its main plane, by local quadratic fits.

    This stands in for a Poisson reconstruction: each node of a grid in the plane of the two first principal axes gets
    the height of a quadratic fitted to the points within 2 sigma, weighted by distance; nodes without enough points
    are left out.
    """
    centre = p.mean(axis=0)
    axes = np.linalg.eigh(np.cov((p - centre).T))[1][:, ::-1]
    q = (p - centre) @ axes
    step = spacing / 2
    near = Cells(np.column_stack([q[:, :2], np.zeros(len(q))]), 2 * sigma)
    nodes = np.unique(np.rint(q[:, :2] / step), axis=0)
    wide = int(np.ceil(sigma / step / 2))
    shifts = np.array([(a, b) for a in range(-wide, wide + 1) for b in range(-wide, wide + 1)])
    nodes = np.unique((nodes[:, None] + shifts[None]).reshape(-1, 2), axis=0) * step
    out = []
    for u, v in nodes:
        k = near.near(np.array([u, v, 0.0]))
        if len(k) < 6:
            continue
        d = q[k, :2] - (u, v)
        w = np.exp(-(d**2).sum(axis=1) / (2 * sigma * sigma))
        a = np.column_stack([np.ones(len(k)), d, d[:, 0] ** 2, d[:, 0] * d[:, 1], d[:, 1] ** 2])
        c = np.linalg.lstsq(a * w[:, None], q[k, 2] * w, rcond=None)[0]
        out.append((u, v, c[0]))
    return np.array(out).reshape(-1, 3) @ axes.T + centre


def refine_surface(points: DataFrame, sigma_normal: float, sigma_mesh: float, sigma_hull: float, bound: DataFrame | None = None, by: str = "label") -> DataFrame:
    """``by, z, y, x``: each cloud's smooth surface at whole places, within the hull of its points widened along their normals."""
    kind = points.schema[by].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.unique(pdf[COLUMNS].to_numpy(float), axis=0)
        box = np.ptp(p, axis=0) + 1
        width = min(sigma_mesh, box[0] / 2, float(np.linalg.norm(box[1:])) / 2)
        n = point_normals(p, sigma_normal)
        fit = np.unique(np.rint(smooth_surface(p, max(width, 1.0))), axis=0) if len(p) > 6 else p
        try:
            f = hull_facets(np.concatenate([p, p + sigma_hull * n, p - sigma_hull * n]))
            fit = fit[(fit @ f[:, :3].T + f[:, 3] < 1e-9).all(axis=1)]
        except ValueError:
            pass
        return pd.DataFrame({by: pdf[by].iloc[0], **{c: fit[:, k].astype(int) for k, c in enumerate(COLUMNS)}})

    out = points.select(by, *COLUMNS).groupBy(by).applyInPandas(one, f"{by} {kind}, z int, y int, x int")
    return out.join(bound.select(*COLUMNS).distinct(), COLUMNS, "left_semi") if bound is not None else out
