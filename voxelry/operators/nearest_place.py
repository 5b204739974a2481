"""The nearest of given places for every place of an image, at any distance.

Squared distances are separable: along each column the places are shared out among its own, then along each row among the
columns' values. Both steps are lower envelopes of parabolas, in whole numbers: an element keeps the range of places where
it is least, a new one cuts those before it. An image's line is one row with an array of at most as many elements as it has
places; a task takes the lines of a batch of rows in step, element by element.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.operators.image import SLICE

#: Places of the lines that a task works on at once.
AT_ONCE = 1 << 19


def _least_from(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """The first place from which b (``at, g, idx``, further on) is nearer than a; on equal distance, the smaller ``idx`` is."""
    rise = b[1] + b[0] * b[0] - a[1] - a[0] * a[0]
    step = 2 * (b[0] - a[0])
    whole, rest = np.divmod(rise, step)
    return np.where((rest == 0) & (b[2] < a[2]), whole, whole + 1)


def envelopes(at: np.ndarray, g: np.ndarray, idx: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """For each line (a row, its first ``counts`` parabolas in order of ``at``) the parabola that is least at 0, 1, ..., n - 1."""
    lines, most = at.shape
    held, low = np.zeros((lines, most), np.int64), np.zeros((lines, most), np.int64)
    size = np.zeros(lines, np.int64)
    for j in range(most):
        rows = np.flatnonzero(counts > j)
        while len(rows):
            top = size[rows] - 1
            e = held[rows, top]
            begin = _least_from((at[rows, e], g[rows, e], idx[rows, e]), (at[rows, j], g[rows, j], idx[rows, j])) if j else np.zeros(len(rows), np.int64)
            begin[top < 0] = 0
            gone = (top >= 0) & (begin <= low[rows, top])
            new = rows[~gone & (begin < n)]
            held[new, size[new]], low[new, size[new]] = j, begin[~gone & (begin < n)]
            size[new] += 1
            rows = rows[gone]
            size[rows] -= 1
    first = np.zeros((lines, n), np.int64)
    line, k = np.nonzero(np.arange(most) < size[:, None])
    first[line, low[line, k]] = k
    return held[np.arange(lines)[:, None], np.maximum.accumulate(first, axis=1)]


def nearest_place(places: DataFrame, shape: tuple[int, int], by: tuple[str, ...] = SLICE) -> DataFrame:
    """``by, y, x, idx, d2``: for every place of an image of ``shape`` the nearest of ``by, idx, y, x``; ties go to the smallest ``idx``.

    Places may lie anywhere in the image; a slice without any gives no rows. ``idx`` is a whole number.
    """
    kind = places.schema["idx"].dataType.simpleString()

    def along(points: DataFrame, line: str, axis: str, n: int) -> DataFrame:
        """Each line's places with the element that is least there; a line has one element at a place."""
        lines = points.groupBy(*by, line).agg(F.array_sort(F.collect_list(F.struct(F.col(axis).cast("long").alias("at"), "g", F.col("idx").cast("long").alias("idx")))).alias("p"))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts = np.diff(batch.column("p").offsets.to_numpy())
                step = max(1, AT_ONCE // max(n, int(counts.max(initial=1))))
                for k in range(0, batch.num_rows, step):
                    part = batch.slice(k, step)
                    m, flat = counts[k : k + step], part.column("p").flatten()
                    filled = np.arange(m.max()) < m[:, None]
                    at, g, idx = (np.zeros(filled.shape, np.int64) for _ in range(3))
                    for a, c in ((at, "at"), (g, "g"), (idx, "idx")):
                        a[filled] = flat.field(c).to_numpy()
                    best = envelopes(at, g, idx, m, n)
                    row = np.arange(len(m))[:, None]
                    place = np.arange(n, dtype=np.int64)
                    d2 = g[row, best] + (place - at[row, best]) ** 2
                    every = pa.array(np.repeat(np.arange(len(m)), n))
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c).take(every) for c in (*by, line)), pa.array(np.tile(place.astype(np.int32), len(m))), pa.array(idx[row, best].ravel()), pa.array(d2.ravel())], names=[*by, line, axis, "idx", "g"]
                    )

        keys = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by)
        return lines.mapInArrow(work, f"{keys}{', ' if by else ''}{line} int, {axis} int, idx long, g long")

    # Of places that are the same only the least can count.
    seeds = places.select(*by, "idx", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).groupBy(*by, "x", "y").agg(F.min("idx").alias("idx")).withColumn("g", F.lit(0).cast("long"))
    rows = along(along(seeds, "x", "y", shape[0]), "y", "x", shape[1])
    return rows.select(*by, "y", "x", F.col("idx").cast(kind).alias("idx"), F.col("g").alias("d2"))
