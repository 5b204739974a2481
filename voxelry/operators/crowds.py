"""Crowds of points: those of one small cell and like orientation, and the sums of their edges' weights.

Points of a crowd all lie within the radius of each other. The weights between two crowds are summed over all pairs of their
points within the radius, in tasks that take two blocks of points at a time, so pairs never become rows: what is written grows
with the space and the orientations taken, not with the square of the points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.operators.spatial import ZYX, beside, placed, tight_cells
from voxelry.storage import cut

#: Sorts of points (place and orientation) to a block, in the mean; pairs of sorts to a task; numbers to an array of pairs.
BLOCK, TASK_PAIRS, AT_A_TIME = 8192, 200_000_000, 1 << 22
#: Orientations of a crowd differ by less than this share of sigma.
SHARE = 1 / 3


def _weights(a: np.ndarray, b: np.ndarray, sigma: float) -> np.ndarray:
    """The weights of edges between orientations, as ``columns.orients_absdiff`` and ``neighbour_weight`` have them."""
    d = np.mod(b[None] - a[:, None], math.pi)
    return np.exp(-0.5 * (np.minimum(d, math.pi - d) / sigma) ** 2)


class _Block:
    """A block's sorts of points, in order of their places."""

    def __init__(self, rows: pa.StructArray):
        self.at = np.stack([rows.field(c).to_numpy(zero_copy_only=False) for c in ("pz", "py", "px")], axis=1)
        self.orient, self.n, crowd = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("orient", "n", "crowd"))
        first = np.flatnonzero(np.r_[True, (self.at[1:] != self.at[:-1]).any(axis=1)])
        self.places, self.place = self.at[first], np.repeat(np.arange(len(first)), np.diff(first, append=len(self.at)))
        self.crowds, self.crowd = np.unique(crowd, return_inverse=True)
        # Sorts of one orientation are of one crowd, as a block's are of one cell.
        self.kinds, kind_first, self.kind = np.unique(self.orient, return_index=True, return_inverse=True)
        self.kind_crowd = self.crowd[kind_first]

    def one_hot(self, of: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((len(of), n))
        out[np.arange(len(of)), of] = 1
        return out

    def counts(self) -> np.ndarray:
        """Points by place and orientation."""
        out = np.zeros((len(self.places), len(self.kinds)))
        out[self.place, self.kind] = self.n
        return out


def _near(p: np.ndarray, q: np.ndarray, r: float) -> np.ndarray:
    return sum(((p[:, k, None] - q[None, :, k]) ** 2 for k in range(3)), np.zeros((len(p), len(q)))) <= r * r


def _by_kind(a: _Block, b: _Block, r: float, sigma: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Weights and numbers of pairs by crowds, both ways where the blocks are the ``same``: orientations counted by place first."""
    left, right = a.counts(), b.counts()
    pairs = np.zeros((len(a.kinds), len(b.kinds)))
    step = max(1, AT_A_TIME // len(b.places))
    for k in range(0, len(a.places), step):
        pairs += left[k : k + step].T @ (_near(a.places[k : k + step], b.places, r).astype(float) @ right)
    if same:
        pairs[np.diag_indices(len(pairs))] -= left.sum(axis=0)
    to = a.one_hot(a.kind_crowd, len(a.crowds)).T, b.one_hot(b.kind_crowd, len(b.crowds))
    return to[0] @ (pairs * _weights(a.kinds, b.kinds, sigma)) @ to[1], to[0] @ pairs @ to[1]


def _by_sort(a: _Block, b: _Block, r: float, sigma: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_by_kind`, each pair of sorts by itself: for orientations that hardly repeat."""
    to = a.one_hot(a.crowd, len(a.crowds)).T, b.one_hot(b.crowd, len(b.crowds))
    weights, numbers = np.zeros((2, len(a.crowds), len(b.crowds)))
    step = max(1, AT_A_TIME // len(b.n))
    for k in range(0, len(a.n), step):
        rows = slice(k, k + step)
        pairs = _near(a.at[rows], b.at, r) * (a.n[rows, None] * b.n[None].astype(float))
        if same:
            here = np.arange(k, min(k + step, len(a.n)))
            pairs[here - k, here] -= a.n[rows]
        numbers += to[0][:, rows] @ (pairs @ to[1])
        pairs *= _weights(a.orient[rows], b.orient, sigma)
        weights += to[0][:, rows] @ (pairs @ to[1])
    return weights, numbers


def _between(a: _Block, b: _Block, r: float, sigma: float, same: bool) -> tuple[np.ndarray, ...]:
    """Two crowds each, the weight and the number of their pairs of points; each pair of points counts once."""
    by_kind = len(a.places) * len(b.kinds) * (len(b.places) + len(a.kinds)) < 20 * len(a.n) * len(b.n)
    weights, numbers = (_by_kind if by_kind else _by_sort)(a, b, r, sigma, same)
    if same:
        # An inner pair was met from both sides.
        weights, numbers = (np.triu(x) - np.diag(np.diag(x)) / 2 for x in (weights, numbers))
    i, j = np.nonzero(numbers)
    return a.crowds[i], b.crowds[j], weights[i, j], np.rint(numbers[i, j]).astype(np.int64)


def crowds(points: DataFrame, r: float, sigma: float) -> tuple[DataFrame, DataFrame]:
    """(``id, crowd``: each point's crowd, named by its least ``idx``; ``src, dst, weight, n``: the sums of the weights of the
    edges within and between crowds, and their number).

    ``points`` have ``idx`` once, ``z, y, x`` and ``orient``; those without a place or orientation are left out. Both tables are written.
    """
    cell = [f"c{c}" for c in ZYX]
    at = [f"p{c}" for c in ZYX]
    turned = F.coalesce(F.abs(F.col("orient").cast("double")) < F.lit(math.inf), F.lit(False))
    kinds = math.ceil(math.pi / (sigma * SHARE))
    kind = F.least(F.floor(F.pmod("orient", F.lit(math.pi)) * (kinds / math.pi)), F.lit(kinds - 1)).alias("kind")
    own = points.where(placed() & turned).select("idx", *(F.col(c).cast("double").alias(f"p{c}") for c in ZYX), *tight_cells(r), F.col("orient").cast("double").alias("orient"))
    own = own.select("*", kind)
    named = own.groupBy(*cell, "kind").agg(F.min("idx").alias("crowd"))
    members = cut(own.join(named, [*cell, "kind"]).select(F.col("idx").alias("id"), "crowd", *cell, *at, "orient"))
    sorts = members.groupBy(*cell, *at, "orient", "crowd").agg(F.count("*").alias("n"))
    sizes = members.groupBy(*cell).agg(F.count_distinct(*at, "orient").alias("sorts"))
    dealt = sorts.join(sizes, cell).withColumn("part", F.pmod(F.xxhash64(*at, "orient"), F.ceil(F.col("sorts") / BLOCK)))
    # In order, so that sums are the same however the rows come.
    blocks = cut(dealt.groupBy(*cell, "part").agg(F.sort_array(F.collect_list(F.struct(*at, "orient", "n", "crowd"))).alias("rows"), F.count("*").alias("size"), F.min("crowd").alias("low")))
    key = [*cell, "part"]
    place = F.struct(*key)
    left = blocks.select(place.alias("a"), F.col("size").alias("size_a"), beside()).select("a", "size_a", "cell.*")
    met = cut(left.join(blocks.select(*cell, place.alias("b"), F.col("size").alias("size_b")), cell).where("a <= b").select("a", "b", "size_a", "size_b"))
    work = met.agg(F.coalesce(F.sum(F.col("size_a").cast("double") * F.col("size_b")), F.lit(0.0))).first()[0]
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(work / TASK_PAIRS))
    side = lambda x: blocks.select(place.alias(x), F.col("rows").alias(f"rows_{x}"))
    pairs = met.select("a", "b").join(side("a"), "a").join(side("b"), "b").select((F.col("a") == F.col("b")).alias("same"), "rows_a", "rows_b", F.xxhash64("a", "b").alias("deal"))
    name = members.schema["crowd"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[], [], [], []]
            for same, a, b in zip(*(batch.column(c) for c in ("same", "rows_a", "rows_b")), strict=True):
                first = _Block(a.values)
                for out, x in zip(got, _between(first, first if same.as_py() else _Block(b.values), r, sigma, same.as_py()), strict=True):
                    out.append(x)
            u, v, w, n = (np.concatenate(x) if x else np.zeros(0) for x in got)
            kinds = (batch.column("rows_a").type.value_type.field("crowd").type,) * 2 + (pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((np.minimum(u, v), np.maximum(u, v), w, n), kinds, strict=True)], names=["src", "dst", "weight", "n"])

    found = pairs.repartition(tasks, "deal").drop("deal").mapInArrow(sums, f"src {name}, dst {name}, weight double, n long")
    return members.select("id", "crowd"), cut(found.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")))
