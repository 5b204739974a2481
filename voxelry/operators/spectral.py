"""Cuts of a weighted graph into n parts by the eigenvectors of its normalised adjacency.

The eigenvectors of a large graph come from subspace iteration: a block of vectors, one row for each vertex, is put
through a polynomial of the matrix (a chain of joins with the edges and sums) that grows the wanted end of the spectrum;
only products of the vectors with each other, a small square matrix, pass the driver. A graph of at most ``AT_ONCE`` vertices,
counted first, is solved in one task instead; the tests compare both ways. Labels are the discrete ones nearest to a rotation of the
vectors, found by alternating sums by label with a rotation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.operators.communities import doubled
from voxelry.storage import cut, dropped

#: Vertices up to which one task solves the whole; vectors beside the wanted ones; degree of the polynomial; bounds of rounds and rest.
AT_ONCE, SPARE, DEGREE, MOST_ROUNDS, REST = 2000, 4, 6, 200, 1e-9
#: Turns of the labels' rotation at most.
MOST_TURNS = 100


def _fixed_signs(v: np.ndarray) -> np.ndarray:
    """Columns whose entry of greatest size is positive."""
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


def _products(table: DataFrame, left: str, right: str, p: int, q: int) -> np.ndarray:
    """Inner products of the columns of two arrays."""
    sums = [F.sum(F.col(left)[i] * F.col(right)[j]) for i in range(p) for j in range(q)]
    return np.array(table.agg(*sums).first(), float).reshape(p, q)


def _combined(v: str, m: np.ndarray):
    """The array's columns times a matrix."""
    return F.array(*(sum((F.col(v)[i] * float(m[i, j]) for i in range(len(m))), F.lit(0.0)) for j in range(m.shape[1])))


def eigenvectors(both: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """(``id, degree, v``: the n eigenvectors of greatest eigenvalue of the normalised adjacency, the eigenvalues), by iteration.

    ``both`` has each edge both ways. Vectors are of unit length, and one entry of greatest size is positive.
    """
    degrees = cut(both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree")))
    size = degrees.count()
    p = min(n + SPARE, size)
    scale = lambda x: degrees.select(F.col("id").alias(x), F.col("degree").alias(f"d_{x}"))
    matrix = cut(both.join(scale("src"), "src").join(scale("dst"), "dst").select("src", "dst", (F.col("weight") / F.sqrt(F.col("d_src") * F.col("d_dst"))).alias("a")))
    # The first vector is known: the roots of the degrees. The others begin as hashes of the vertices.
    start = [F.sqrt("degree"), *(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 30)) / float(1 << 29) - 1 for k in range(1, p))]
    block = cut(degrees.select("id", "degree", F.array(*start).alias("v")))
    lower = -1.0

    def times(table: DataFrame) -> DataFrame:
        """The matrix times each vector ``v`` as ``w``."""
        parts = matrix.join(table.select(F.col("id").alias("dst"), "v"), "dst").groupBy("src").agg(*(F.sum(F.col("a") * F.col("v")[k]).alias(f"s{k}") for k in range(p)))
        return table.join(parts.select(F.col("src").alias("id"), F.array(*(F.col(f"s{k}") for k in range(p))).alias("w")), "id")

    values = None
    for _ in range(MOST_ROUNDS):
        # Orthonormal vectors of the block, then those of the matrix within it.
        gram = _products(block, "v", "v", p, p)
        d, u = np.linalg.eigh((gram + gram.T) / 2)
        basis = u[:, d > d.max() * 1e-13] / np.sqrt(d[d > d.max() * 1e-13])
        again = cut(times(block))
        inner = basis.T @ _products(again, "v", "w", p, p) @ basis
        found, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-found)
        values, m = found[order], basis @ turn[:, order]
        if m.shape[1] < p:  # vectors that depend on the others begin anew
            m = np.pad(m, ((0, 0), (0, p - m.shape[1])))
        ritz = again.select("id", "degree", _combined("v", m).alias("v"), _combined("w", m).alias("w"))
        rest = [F.sqrt(F.sum((F.col("w")[k] - float(values[k]) * F.col("v")[k]) ** 2)) for k in range(min(n, len(values)))]
        left = max(float(x) for x in ritz.agg(*rest).first())
        old, block = block, ritz.select("id", "degree", "v")
        if left < REST:
            break
        # Chebyshev's polynomial, small on [lower, upper] and steep above.
        upper = float(values[-1]) if len(values) > n else float(values[min(n, len(values)) - 1]) - 0.1
        upper = min(max(upper, lower + 1e-3), float(values[min(n, len(values)) - 1]) - 1e-12)
        middle, half = (upper + lower) / 2, (upper - lower) / 2
        before, now = "v", None
        table = block
        for step in range(DEGREE):
            applied = times(table.select("id", "degree", "v", *(["u"] if step else [])))
            y = [(F.col("w")[k] - middle * F.col("v")[k]) / half for k in range(p)]
            new = [y[k] if not step else 2 * y[k] - F.col("u")[k] for k in range(p)]
            table = applied.select("id", "degree", F.array(*new).alias("__v"), F.col("v").alias("u")).withColumnRenamed("__v", "v")
        fresh = F.array(*(F.col("v")[k] if k < len(values) else F.pmod(F.xxhash64("id", F.lit(k + 97)), F.lit(1 << 30)) / float(1 << 29) - 1 for k in range(p)))
        block = cut(table.select("id", "degree", fresh.alias("v")))
        dropped(old, again)
    else:
        raise ValueError("the eigenvectors don't settle")
    top = min(n, len(values))
    peaks = block.agg(*(F.max_by(F.col("v")[k], F.struct(F.abs(F.col("v")[k]), -F.col("id"))) for k in range(top))).first()
    signed = F.array(*(F.col("v")[k] * (1.0 if peaks[k] >= 0 else -1.0) for k in range(top)))
    return cut(block.select("id", "degree", signed.alias("v"))), values[:top]


def _dense(both: DataFrame, n: int, labelled: bool = False) -> DataFrame:
    """``id, degree, v``, or ``id, label``, by one task: for graphs of a checked size only."""
    kind = both.schema["src"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = pd.concat([*batches])
        if not len(e):
            return
        names = np.unique(e["src"])
        a = np.zeros((len(names), len(names)))
        a[np.searchsorted(names, e["src"]), np.searchsorted(names, e["dst"])] = e["weight"]
        degree = a.sum(axis=1)
        values, v = np.linalg.eigh(a / np.sqrt(np.outer(degree, degree)))
        v = _fixed_signs(v[:, np.argsort(-values, kind="stable")[:n]])
        yield pd.DataFrame({"id": names, "label": _labels(degree, v)} if labelled else {"id": names, "degree": degree, "v": list(v)})

    return cut(both.select("src", "dst", "weight").coalesce(1).mapInPandas(work, f"id {kind}, label int" if labelled else f"id {kind}, degree double, v array<double>"))


def _labels(degree: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The labels of :func:`labels`, for vertices as arrays in the order of their ids."""
    x = v / np.sqrt(degree)[:, None]
    x *= np.sqrt(len(x) / (x**2).sum(axis=0))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    turn, met = np.zeros((x.shape[1],) * 2), np.zeros(len(x))
    for k in range(x.shape[1]):
        turn[:, k] = x[np.round(met, 9).argmin()]
        met += np.abs(x @ turn[:, k])
    last = None
    for _ in range(MOST_TURNS):
        label = (x @ turn).argmax(axis=1)
        found = np.zeros_like(turn)
        np.add.at(found, label, x)
        u, s, vt = np.linalg.svd(found)
        if last is not None and abs(s.sum() - last) < 1e-12 * max(1.0, last):
            break
        last, turn = s.sum(), vt.T @ u.T
    return label


def labels(vectors: DataFrame, n: int, most_rounds: int = MOST_TURNS) -> DataFrame:
    """``id, label`` of ``id, degree, v``: the discrete labels nearest to a rotation of the vectors.

    Entries are divided by the root of the degree, columns scaled alike, rows made of unit length. The rotation begins with
    rows as far apart as they are found, the least id first.
    """
    plain = vectors.select("id", F.transform("v", lambda x: x / F.sqrt("degree")).alias("x"))
    sums = plain.agg(F.count("*"), *(F.sum(F.col("x")[k] ** 2) for k in range(n))).first()
    scaled = F.array(*(F.col("x")[k] * float(np.sqrt(sums[0] / sums[k + 1])) for k in range(n)))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x))
    rows = cut(plain.select("id", scaled.alias("x")).select("id", F.transform("x", lambda x: x / length).alias("x")))
    turn = np.zeros((n, n))
    turn[:, 0] = rows.agg(F.min_by("x", "id")).first()[0]
    met = F.lit(0.0)
    for k in range(1, n):
        met = met + F.abs(sum((F.col("x")[i] * float(turn[i, k - 1]) for i in range(n)), F.lit(0.0)))
        turn[:, k] = rows.agg(F.min_by("x", F.struct(F.round(met, 9), "id"))).first()[0]
    last = None
    for _ in range(most_rounds):
        scores = _combined("x", turn)
        best = F.array_position(scores, F.array_max(scores)) - 1
        table = rows.select("id", "x", best.cast("int").alias("label"))
        found = np.zeros((n, n))
        for r in table.groupBy("label").agg(*(F.sum(F.col("x")[k]).alias(f"s{k}") for k in range(n))).collect():
            found[r["label"]] = [r[f"s{k}"] for k in range(n)]
        u, s, vt = np.linalg.svd(found)
        if last is not None and abs(s.sum() - last) < 1e-12 * max(1.0, last):
            break
        last, turn = s.sum(), vt.T @ u.T
    return table.select("id", "label")


def spectral_parts(edges: DataFrame, n: int) -> DataFrame:
    """``id, label``: the graph ``src, dst, weight`` in n parts (fewer, if it has fewer vertices)."""
    both = cut(doubled(edges))
    size = both.select("src").distinct().count()
    n = min(n, size)
    if n < 2:
        return both.select(F.col("src").alias("id"), F.lit(0).alias("label")).distinct()
    return _dense(both, n, labelled=True) if size <= AT_ONCE else labels(eigenvectors(both, n)[0], n)
