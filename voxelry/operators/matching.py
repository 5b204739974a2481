"""Matching candidates to a reference surface, and telling two kinds of boxes apart: mixtures fitted by passes over the rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.functions.columns import gaussian_pdf, half_even, orients_absdiff
from voxelry.operators import image, vote
from voxelry.operators.paths import bridge_gaps
from voxelry.operators.points import rasterize
from voxelry.operators.spatial import sort_by_guide

ZYX = ["z", "y", "x"]


def _posterior(x: Column, means, sigmas, weights) -> Column:
    a, b = (w * gaussian_pdf(x, m, s) for m, s, w in zip(means, sigmas, weights, strict=True))
    return F.coalesce(F.try_divide(a, a + b), F.lit(0.0))


def fixed_mean_threshold(df: DataFrame, value: str, means=(0.0, math.pi / 2), sigmas=(0.1, 0.1), weights=(0.5, 0.5), tol: float = 1e-3, max_iter: int = 100) -> float | None:
    """The largest value that two Gaussians of given means assign to the first one; their widths and weights are fitted.

    Each iteration is one aggregation. It ends when no value's probability grows by ``tol``, or after ``max_iter``.
    """
    x = F.col(value).cast("double")
    df = df.select(x.alias(value)).where(F.col(value).isNotNull()).persist()
    try:
        p = _posterior(F.col(value), means, sigmas, weights)
        for _ in range(max_iter):
            d2 = [F.pow(F.col(value) - m, F.lit(2)) for m in means]
            r = df.agg(F.count("*"), F.sum(p), F.sum(p * d2[0]), F.sum((1 - p) * d2[1])).first()
            n, s0 = r[0], r[1]
            if not n:
                return None
            s1 = n - s0
            weights = (s0 / n, s1 / n)
            sigmas = tuple(max(math.sqrt(max(q, 0.0) / s), 1e-12) if s > 0 else old for q, s, old in ((r[2], s0, sigmas[0]), (r[3], s1, sigmas[1])))
            new = _posterior(F.col(value), means, sigmas, weights)
            grown = df.agg(F.max(new - p)).first()[0]
            p = new
            if grown < tol:
                break
        return df.agg(F.max(F.when(p > 0.5, F.col(value)))).first()[0]
    finally:
        df.unpersist()


def match_by_closeness(candidates: DataFrame, reference: DataFrame, sigma: float, shape: tuple[int, int]) -> DataFrame:
    """Candidates (``z, y, x, o``) close to a reference surface (``z, y, x, o``) and turned as it is.

    The reference votes; where it is stronger than e^-1/2, closed by one place, candidates stay whose orientation
    differs from the vote's by less than the fitted threshold.
    """
    votes = vote.vote(reference.withColumn("s", F.lit(1.0)), sigma, shape)
    near = image.close(votes.where(F.col("s") > math.exp(-0.5)).select(*ZYX))
    both = candidates.join(near, ZYX, "left_semi").join(votes.select(*ZYX, F.col("o").alias("__o")), ZYX).withColumn("d_orient", orients_absdiff(F.col("o"), F.col("__o"))).drop("__o")
    limit = fixed_mean_threshold(both, "d_orient")
    return both.where(F.col("d_orient") < F.lit(limit)) if limit is not None else both.limit(0)


def match_candidates(candidates: DataFrame, reference: DataFrame, guide: DataFrame, r: float, shape: tuple[int, int]) -> DataFrame:
    """Candidates that follow the reference, with gaps bridged along the candidates: ``idx, z, y, x`` sorted by the guide."""

    def oriented(points: DataFrame) -> DataFrame:
        placed = rasterize(points, None).withColumn("v", F.lit(1.0))
        grid = _padded(placed, shape)
        return image.ridge(grid, 1.0).select(*ZYX, "o").join(placed.select(*ZYX), ZYX, "left_semi")

    cand, ref = oriented(candidates), oriented(reference)
    kept = match_by_closeness(cand, ref, r, shape)
    numbered = sort_by_guide(cand.withColumn("idx", F.xxhash64(*ZYX)), guide).select("place", *ZYX, F.col("o").alias("orient")).withColumn("idx", F.col("place").cast("long"))
    bridged = bridge_gaps(numbered.select("idx", *ZYX, "orient"), kept, r)
    return bridged.select("idx", *(half_even(F.col(c)).alias(c) for c in ZYX))


def _padded(placed: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """A dense image of the placed points' slices."""
    ny, nx = shape
    grid = placed.select("z").distinct().select("z", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("y")).select("z", "y", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("x"))
    return grid.join(placed, ZYX, "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def class_templates(offsets: list[tuple[int, int, int]], rn: tuple[float, float], rt: float) -> np.ndarray:
    """Two box images by place along the normal and rounded-up radius: a particle on a membrane, and a membrane."""
    n0 = min(o[0] for o in offsets)
    plate, radius2 = max(rn[0], 0), max(rt / 2, 1)
    shape = (max(o[0] for o in offsets) - n0 + 1, max(math.ceil(math.hypot(o[1], o[2])) for o in offsets) + 1)
    sums, counts = np.zeros((2, *shape)), np.zeros(shape)
    for n, a, b in offsets:
        cell = (n - n0, math.ceil(math.hypot(a, b)))
        counts[cell] += 1
        on_plate = (n - plate) ** 2 <= 1
        sums[(1, *cell)] += on_plate
        sums[(0, *cell)] += on_plate or a * a + b * b <= radius2
    return sums / np.maximum(counts, 1)


def standard_rows(a: np.ndarray) -> np.ndarray:
    a = a.reshape(len(a), -1)
    s = a.std(axis=1, keepdims=True)
    return (a - a.mean(axis=1, keepdims=True)) / np.where(np.isclose(s, 0), 1, s)


def classify_boxes(cells: DataFrame, rn: tuple[float, float], rt: float, tol: float = 1e-3, max_iter: int = 100) -> DataFrame:
    """``idx, class`` of boxes (``idx, i, j, value``): 0 like a particle, 1 like a membrane.

    A mixture of two Gaussians with a width for each cell starts from the templates, equal weights and the cells'
    overall widths. Each iteration sums every partition's rows in numpy and adds the sums up; only those reach the
    driver, two numbers a cell and class.
    """
    from voxelry.operators.spatial import box_offsets

    start = standard_rows(class_templates(box_offsets(rn, rt), rn, rt))
    rows = cells.groupBy("idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "value"))), lambda c: c["value"]).alias("v")).persist()
    try:

        def sums(step) -> tuple[np.ndarray, float, int]:
            def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    if len(pdf):
                        total, score = step(standard_rows(np.stack(pdf["v"].to_numpy())))
                        yield pd.DataFrame({"k": range(total.size + 1), "s": [*total.ravel(), score]})

            got = rows.mapInPandas(work, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
            flat = np.zeros(len(got))
            for r in got:
                flat[r["k"]] = r["s"]
            return flat[:-1], float(flat[-1]), len(got)

        d = start.shape[1]
        flat, n, _ = sums(lambda x: (np.stack([x.sum(axis=0), (x * x).sum(axis=0)]), len(x)))
        if not n:
            return rows.select("idx", F.lit(0).alias("class"))
        m = flat.reshape(2, d) / n
        means, var, weights = start, np.tile(m[1] - m[0] ** 2, (2, 1)) + 1e-6, np.array([0.5, 0.5])
        before = -np.inf
        for _ in range(max_iter):
            params = (means, var, weights)

            def step(x: np.ndarray, params=params) -> tuple[np.ndarray, float]:
                logs = _log_densities(x, *params)
                top = logs.max(axis=1, keepdims=True)
                p = np.exp(logs - top)
                score = float((top[:, 0] + np.log(p.sum(axis=1))).sum())
                p /= p.sum(axis=1, keepdims=True)
                return np.stack([np.concatenate([[q.sum()], q @ x, q @ (x * x)]) for q in p.T]), score

            flat, score, _ = sums(step)
            s = flat.reshape(2, 2 * d + 1)
            nk = s[:, :1] + 1e-12
            means = s[:, 1 : d + 1] / nk
            var = np.maximum(s[:, d + 1 :] / nk - means**2, 0) + 1e-6
            weights = nk[:, 0] / nk.sum()
            if abs(score / n - before) < tol:
                break
            before = score / n
        final = (means, var, weights)

        def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({"idx": pdf["idx"], "class": _log_densities(standard_rows(np.stack(pdf["v"].to_numpy())), *final).argmax(axis=1).astype("int32")})

        kind = rows.schema["idx"].dataType.simpleString()
        return rows.mapInPandas(label, f"idx {kind}, class int")
    finally:
        rows.unpersist()


def _log_densities(x: np.ndarray, means: np.ndarray, var: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.stack([np.log(w) - 0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v).sum(axis=1) for m, v, w in zip(means, var, weights, strict=True)], axis=1)


def class_averages(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """``class, i, j`` and the mean value of the boxes of the class."""
    return cells.join(classes, "idx").groupBy("class", "i", "j").agg(F.avg("value").alias("mean"))
