"""Minimum spanning forests by rounds over tables, and normals turned alike along them.

A round takes the least edge that leaves each tree and joins the trees at its ends; chains of joined trees are followed
by pointer doubling. With each vertex goes a sign, the product of the edges' signs on its path to the tree's root, so
that no tree is ever walked. Edges are ordered by weight, then ends, so there is one least forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelry.operators.points import ZYX, ordinal
from voxelry.operators.spatial import neighbor_edges
from voxelry.storage import cut, dropped


def _followed(hooks: DataFrame) -> DataFrame:
    """``c, to, sign``: each tree's last one along the hooks, and the product of the signs on the way."""
    to = lambda h: h.select(F.col("c").alias("to"), F.col("to").alias("next"), F.col("sign").alias("more"))
    while True:
        step = hooks.join(to(hooks), "to").select("c", F.col("next").alias("to"), (F.col("sign") * F.col("more")).alias("sign"), (F.col("next") != F.col("to")).alias("moved"))
        new = cut(step)
        dropped(hooks)
        hooks = new.drop("moved")
        if new.where("moved").isEmpty():
            return hooks


#: Edges that a task gathers before it looks which of them can be in a forest.
GATHERED = 1 << 18


def _least(e: np.ndarray) -> np.ndarray:
    """Of edges ``a, b, sign, w`` (a record array), those of their own least forest."""
    order = np.lexsort((e["sign"], e["b"], e["a"], e["w"]))
    names, ends = np.unique(np.concatenate([e["a"][order], e["b"][order]]), return_inverse=True)
    root, kept = list(range(len(names))), []
    for k, (u, v) in enumerate(zip(ends[: len(order)].tolist(), ends[len(order) :].tolist(), strict=True)):
        while root[u] != u:
            root[u] = u = root[root[u]]
        while root[v] != v:
            root[v] = v = root[root[v]]
        if u != v:
            root[v] = u
            kept.append(k)
            if len(kept) == len(names) - 1:
                break
    return e[order[kept]]


def _thinned(edges: DataFrame) -> DataFrame:
    """``w, a, b, sign`` without edges that are the greatest of a ring of their task's edges: such a one is in no least forest.

    A task keeps fewer edges than it has vertices, whatever their number.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("w", float), ("a", np.int64), ("b", np.int64), ("sign", np.int32)]
        held, more, n = np.empty(0, kinds), [], 0
        for batch in batches:
            part = np.empty(batch.num_rows, kinds)
            for c, _ in kinds:
                part[c] = batch.column(c).to_numpy(zero_copy_only=False)
            more.append(part)
            n += len(part)
            if n >= max(GATHERED, len(held)):
                held, more, n = _least(np.concatenate([held, *more])), [], 0
        held = _least(np.concatenate([held, *more]))
        for k in range(0, len(held), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(held[c][k : k + (1 << 16)])) for c, _ in kinds], names=[c for c, _ in kinds])

    return edges.mapInArrow(work, "w double, a long, b long, sign int")


def minimum_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``id, root, sign`` of every vertex, ``src, dst`` of the forest's edges) of ``src, dst, weight, sign`` (1 or -1).

    ``sign`` of a vertex is the product of the edges' on its path to ``root``, some vertex of its tree.
    """
    ends = edges.where("src <> dst").select(F.col("weight").cast("double").alias("w"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("sign").cast("int").alias("sign"))
    kind = ends.schema["a"].dataType.simpleString()
    if kind in ("int", "bigint"):
        ends = _thinned(ends.withColumns({c: F.col(c).cast("long") for c in "ab"}))
    a, b = (F.col(c).cast(kind) for c in "ab")
    left = cut(ends.select(F.struct("w", a.alias("a"), b.alias("b")).alias("key"), a.alias("src"), b.alias("dst"), "sign"))
    vertices = left.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    state = cut(vertices.select("id", F.col("id").alias("root"), F.lit(1).alias("sign")))
    # What is left of an edge: the trees at its ends, and how their roots stand to each other.
    left = left.select("key", F.col("src").alias("s"), F.col("dst").alias("d"), "sign")
    tree: list[DataFrame] = []
    while not left.isEmpty():
        one_way = lambda a, b: left.select(F.col(a).alias("c"), F.struct("key", F.col(b).alias("to"), "sign").alias("e"))  # noqa: B023, E731
        least = one_way("s", "d").unionByName(one_way("d", "s")).groupBy("c").agg(F.min("e").alias("e"))
        hooks = cut(least.select("c", F.col("e.to").alias("to"), F.col("e.sign").alias("sign"), F.col("e.key").alias("key")))
        tree.append(cut(hooks.select(F.col("key.a").alias("src"), F.col("key.b").alias("dst")).distinct()))
        # Two trees that take the same edge: the one of the smaller name is the root.
        other = hooks.select(F.col("c").alias("to"), F.col("to").alias("back"))
        root = (F.col("back") == F.col("c")) & (F.col("c") < F.col("to"))
        rooted = hooks.join(other, "to").select("c", F.when(root, F.col("c")).otherwise(F.col("to")).alias("to"), F.when(root, 1).otherwise(F.col("sign")).alias("sign"))
        ends = _followed(cut(rooted))
        of = lambda k: ends.select(F.col("c").alias(k), F.col("to").alias(f"{k}_to"), F.col("sign").alias(f"{k}_sign"))  # noqa: B023, E731
        new = cut(state.join(of("root"), "root", "left").select("id", F.coalesce("root_to", "root").alias("root"), (F.col("sign") * F.coalesce("root_sign", F.lit(1))).alias("sign")))
        between = left.join(of("s"), "s").join(of("d"), "d").where("s_to <> d_to")
        rest = cut(between.select("key", F.col("s_to").alias("s"), F.col("d_to").alias("d"), (F.col("sign") * F.col("s_sign") * F.col("d_sign")).alias("sign")))
        dropped(state, hooks, ends)
        state, left = new, rest
    out = tree[0] if tree else left.select(F.col("s").alias("src"), F.col("d").alias("dst"))
    for t in tree[1:]:
        out = out.unionByName(t)
    return state, out


def local_axes(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, nz, ny, nx, gap, spread``: the axis of least spread of the points beside each one and itself, (0, 0, 1) with fewer than three.

    ``points`` has ``id`` and coordinates, ``edges`` the pairs of near ones. The component of greatest size is positive.
    ``gap`` is the next eigenvalue less the least, ``spread`` a measure of how far the three differ.
    """
    at = lambda k: points.select(F.col("id").alias(k), *(F.col(c).cast("double").alias(f"{k}_{c}") for c in ZYX))
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    d = {c: F.col(f"dst_{c}") - F.col(f"src_{c}") for c in ZYX}
    pairs = [(a, b) for k, a in enumerate(ZYX) for b in ZYX[k:]]
    sums = both.join(at("src"), "src").join(at("dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), *(F.sum(d[c]).alias(c) for c in ZYX), *(F.sum(d[a] * d[b]).alias(a + b) for a, b in pairs))
    n = F.col("n") + 1  # with the point itself
    spread = [(F.col(a + b) - F.col(a) * F.col(b) / n).alias(a + b) for a, b in pairs]
    matrix = points.select("id").join(sums.where("n >= 2").select("id", *spread), "id", "left").fillna(0.0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zz, zy, zx, yy, yx, xx = (batch.column(k).to_numpy() for k in range(1, 7))
            m = np.stack([zz, zy, zx, zy, yy, yx, zx, yx, xx], axis=1).reshape(-1, 3, 3)
            values, axes = np.linalg.eigh(m)
            v = axes[:, :, 0]
            v[~m.any(axis=(1, 2))] = (0.0, 0.0, 1.0)
            v *= np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(v[:, k])) for k in range(3)), pa.array(values[:, 1] - values[:, 0]), pa.array(values.std(axis=1) / np.sqrt(2))], names=["id", "nz", "ny", "nx", "gap", "spread"])

    return matrix.select("id", *(a + b for a, b in pairs)).mapInArrow(work, "id long, nz double, ny double, nx double, gap double, spread double")


def oriented_normals(points: DataFrame, r: float, ref: tuple[float, float, float] | None = None, by: str = "label", neighbours: int = 10) -> DataFrame:
    """``points`` (``by, idx, z, y, x``) with unit normals ``nz, ny, nx``: least axes within ``r``, turned alike.

    Each point's links are those to its nearest ``neighbours`` within ``r``; normals of a linked part agree along its
    forest of least turning. A part is turned so that at its point nearest to ``ref`` the normal points away from it;
    without ``ref``, its first point keeps its axis, whose component of greatest size is positive.
    """
    p = cut(ordinal(points.select(by, "idx", *(F.col(c).cast("double").alias(c) for c in ZYX)), by, "idx").withColumnRenamed("ord", "id"))
    edges = cut(neighbor_edges(p.select(by, F.col("id").alias("idx"), *ZYX), r, by=(by,)))
    axes = cut(local_axes(p, edges))
    both = edges.select("src", "dst", "dist").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    links = both.withColumn("place", place).where(F.col("place") <= neighbours).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    of = lambda k: axes.select(F.col("id").alias(k), *(F.col(f"n{c}").alias(f"{k}_{c}") for c in ZYX))
    dot = sum((F.col(f"src_{c}") * F.col(f"dst_{c}") for c in ZYX), F.lit(0.0))
    turning = links.join(of("src"), "src").join(of("dst"), "dst").select("src", "dst", (1 - F.abs(dot)).alias("weight"), F.when(dot < 0, -1).otherwise(1).alias("sign"))
    signs, _ = minimum_forest(turning)
    named = p.join(axes, "id").join(signs, "id", "left").select(*p.columns, *(f"n{c}" for c in ZYX), F.coalesce("root", "id").alias("root"), F.coalesce("sign", F.lit(1)).alias("sign"))
    if ref is None:
        first = named.groupBy("root").agg(F.min_by("sign", "id").alias("turn"))
    else:
        away = [(F.col(c) - float(v), f"n{c}") for c, v in zip(ZYX, ref, strict=True)]
        side = F.when(sum((a * F.col(n) for a, n in away), F.lit(0.0)) * F.col("sign") < 0, -1).otherwise(1)
        first = named.groupBy("root").agg(F.min_by(side, F.struct(sum((a * a for a, _ in away), F.lit(0.0)).alias("d2"), F.col("id"))).alias("turn"))
    return named.join(first, "root").select(by, "idx", *ZYX, *((F.col(f"n{c}") * F.col("sign") * F.col("turn")).alias(f"n{c}") for c in ZYX))
