"""Cubic sampling of volumes, flat embeddings of surfaces, and principal components of boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ZYX = ["z", "y", "x"]
#: Sides of the cubes in which a volume is worked on, and the voxels around one on which it depends: a coefficient's
#: share of a value falls by 0.27 a voxel, to 1e-14 of it at ``REACH`` less the two voxels of the spline itself.
CUBE, REACH = 64, 26
AT_ONCE = 1_000_000
_POLE = np.sqrt(3) - 2


def spline_coefficients(v: np.ndarray, margin: int = 24) -> np.ndarray:
    """Coefficients of the cubic B-spline through a volume whose edges go on as they are; padded by ``margin``."""
    a = np.pad(np.asarray(v, float), margin, mode="edge")
    for axis in range(a.ndim):
        c = np.moveaxis(a, axis, 0) * 6.0
        c[0] = c[0] / (1 - _POLE)
        for k in range(1, len(c)):
            c[k] += _POLE * c[k - 1]
        c[-1] = c[-1] * _POLE / (_POLE - 1)
        for k in range(len(c) - 2, -1, -1):
            c[k] = _POLE * (c[k + 1] - c[k])
        a = np.moveaxis(c, 0, axis)
    return a


def cubic(coefficients: np.ndarray, at: np.ndarray, margin: int = 24) -> np.ndarray:
    """Values of the spline at points (rows of ``at``); beyond the padding, those at its edge."""
    p = np.clip(at + margin, 1, np.array(coefficients.shape) - 3.000001)
    low = np.floor(p).astype(int)
    t = p - low
    w = np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3]) / 6
    out = np.zeros(len(at))
    for i in range(4):
        for j in range(4):
            for k in range(4):
                out += w[i, :, 0] * w[j, :, 1] * w[k, :, 2] * coefficients[low[:, 0] + i - 1, low[:, 1] + j - 1, low[:, 2] + k - 1]
    return out


def sample_cubic(points: DataFrame, voxels: DataFrame, dist: float, value: str = "v") -> DataFrame:
    """``idx, sample``: the dense volume at ``dist`` along each point's normal, by cubic splines.

    The volume is worked on in cubes, each with the voxels around it on which its values depend; only cubes with samples
    are read. A task holds one cube, however large the volume is, and more than ``AT_ONCE`` samples of a cube are dealt to
    several. Places outside the volume go on from its edge. Points without a place or normal, and all of a volume without
    voxels, have no sample.
    """
    box = voxels.agg(F.count("*"), *(F.min(c) for c in ZYX), *(F.max(c) for c in ZYX)).first()
    kind = points.schema["idx"].dataType.simpleString()
    if not box[0]:
        return points.select("idx", F.lit(None).cast("double").alias("sample"))
    low, high = box[1:4], box[4:7]
    cube = [f"c{c}" for c in ZYX]
    place = lambda c, a, b: F.greatest(F.lit(float(a)), F.least(F.lit(float(b)), c))
    at = points.select("idx", *((F.col(c) + dist * F.col(f"n{c}")).cast("double").alias(c) for c in ZYX))
    at = at.withColumns({f"c{c}": F.floor(place(F.col(c), a, b) / CUBE).cast("int") for c, a, b in zip(ZYX, low, high, strict=True)})
    used = at.groupBy(*cube).agg(F.ceil(F.count("*") / AT_ONCE).cast("int").alias("parts"))
    samples = at.join(used, cube).withColumn("part", F.pmod(F.xxhash64("idx"), F.col("parts")).cast("int")).drop("parts")
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - REACH) / CUBE).cast("int"), F.floor((F.col(c) + REACH) / CUBE).cast("int"))).alias(f"c{c}")
    around = voxels.select(*(F.col(c).cast("int").alias(c) for c in ZYX), F.col(value).cast("double").alias("v"))
    for c in ZYX:
        around = around.select("*", near(c))
    around = around.join(used, cube).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).drop("parts")

    def one(key: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        first = [max(a, k * CUBE - REACH) for a, k in zip(low, key, strict=False)]
        last = [min(b, (k + 1) * CUBE - 1 + REACH) for b, k in zip(high, key, strict=False)]
        v = np.zeros([b - a + 1 for a, b in zip(first, last, strict=True)])
        v[tuple((q[ZYX].to_numpy(int) - first).T)] = q["v"]
        at = p[ZYX].to_numpy(float) - first
        known = np.isfinite(at).all(axis=1)
        return pd.DataFrame({"idx": p["idx"], "sample": np.where(known, cubic(spline_coefficients(v), np.where(known[:, None], at, 0.0)), np.nan)})

    by = [*cube, "part"]
    return samples.groupBy(*by).cogroup(around.groupBy(*by)).applyInPandas(one, f"idx {kind}, sample double")


def tangent_embedding(p: np.ndarray, neighbours: int = 20) -> np.ndarray:
    """Two coordinates for each point of a surface, by aligning the tangent planes of neighbourhoods."""
    n = len(p)
    k = min(neighbours, n - 1)
    m = np.zeros((n, n))
    for i in range(n):
        near = np.argsort(((p - p[i]) ** 2).sum(axis=1), kind="stable")[: k + 1]
        q = p[near] - p[near].mean(axis=0)
        u = np.linalg.svd(q, full_matrices=False)[0][:, :2]
        g = np.column_stack([np.full(len(near), len(near) ** -0.5), u])
        m[np.ix_(near, near)] += np.eye(len(near)) - g @ g.T
    return np.linalg.eigh(m)[1][:, 1:3]


def embed(points: DataFrame, step: int = 5, neighbours: int = 20, most: int = 4000) -> DataFrame:
    """``idx, e1, e2``: every ``step``-th slice's every ``step``-th point is embedded, the others follow their nearest ones.

    The fitted points are few by construction; more than ``most`` are an error, and a larger step is wanted.
    """
    zs = points.select("z").distinct().withColumn("__z", F.row_number().over(Window.orderBy("z")) - 1).where(F.col("__z") % step == 0).select("z")
    place = F.row_number().over(Window.partitionBy("z").orderBy("idx")) - 1
    fit = points.join(F.broadcast(zs), "z").withColumn("__p", place).where(F.col("__p") % step == 0).select(*ZYX).limit(most + 1).toPandas().to_numpy(float)
    if len(fit) > most:
        raise ValueError(f"more than {most} points to embed")
    flat = tangent_embedding(fit, neighbours)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = pdf[ZYX].to_numpy(float)
            d = ((q[:, None] - fit[None]) ** 2).sum(axis=2)
            near = np.argsort(d, axis=1)[:, :4]
            w = 1 / (np.take_along_axis(d, near, axis=1) + 1e-9)
            e = (flat[near] * w[:, :, None]).sum(axis=1) / w.sum(axis=1)[:, None]
            yield pd.DataFrame({"idx": pdf["idx"], "e1": e[:, 0], "e2": e[:, 1]})

    kind = points.schema["idx"].dataType.simpleString()
    return points.select("idx", *ZYX).mapInPandas(work, f"idx {kind}, e1 double, e2 double")


def box_components(cells: DataFrame, n: int = 2) -> DataFrame:
    """``idx, components``: the first principal components of boxes (``idx, i, j, value``)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = cells.groupBy("idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "value"))), lambda c: c["value"]).alias("v")).withColumn("vector", array_to_vector("v"))
    model = PCA(k=n, inputCol="vector", outputCol="out").fit(rows)
    return model.transform(rows).select("idx", vector_to_array("out").alias("components"))
