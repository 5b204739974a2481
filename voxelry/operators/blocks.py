"""Dense volumes as a table of blocks, and stencils on them with an exchange of rims.

A block (``vol, bz, by, bx``) holds the values of a box of fixed size as one array, line by line, with the box's place
and its volume's size. The table is bucketed by block, so a stencil moves no block: each sends the parts that lie within
``halo`` of other blocks there, and only these rims are shuffled. A chain of stencils (smoothing, gradient, ridge) is one
function over the block and its rim, whose reach is the sum of theirs, so it takes one exchange.

A block without any voxel is not there: it counts as zeros beside others and gets no result. Where a volume ends, the
function sees the array's end, as it would with the whole volume.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.operators.image import gaussian_kernel
from voxelry.storage import cut_buckets

KEY = ("vol", "bz", "by", "bx")
#: Where a block's box begins, its size, and the size of its volume.
PLACE = ("z0", "y0", "x0", "nz", "ny", "nx", "sz", "sy", "sx")
_PLACES = ", ".join(f"{c} int" for c in PLACE)
#: Voxels along each axis of a block.
SIZE = (64, 64, 64)


def _flat(batch: pa.RecordBatch, column: str, k: int) -> np.ndarray:
    return batch.column(column)[k].values.to_numpy()


def to_blocks(voxels: DataFrame, size: tuple[int, int, int] = SIZE, shape: tuple[int, int, int] | None = None, value: str = "v") -> DataFrame:
    """Blocks of ``vol, z, y, x`` and a value; places without a voxel are 0. Sizes are ``shape`` or reach to the last voxel."""
    own = voxels.select("vol", *(F.col(c).cast("int").alias(c) for c in "zyx"), F.col(value).cast("double").alias("v"))
    if shape is None:
        ends = own.groupBy("vol").agg(*((F.max(c) + 1).alias(f"s{c}") for c in "zyx"))
        own = own.join(ends, "vol")
    else:
        own = own.withColumns({f"s{c}": F.lit(n) for c, n in zip("zyx", shape, strict=True)})
    own = own.withColumns({f"b{c}": (F.col(c) / n).cast("int") for c, n in zip("zyx", size, strict=True)})
    kind = own.schema["vol"].dataType.simpleString()

    def one(table: pa.Table) -> pa.Table:
        first = {c: table.column(c)[0].as_py() for c in (*KEY, "sz", "sy", "sx")}
        start = [first[f"b{c}"] * n for c, n in zip("zyx", size, strict=True)]
        n = [min(n, first[f"s{c}"] - s) for c, n, s in zip("zyx", size, start, strict=True)]
        block = np.zeros(n)
        block[tuple(table.column(c).to_numpy() - s for c, s in zip("zyx", start, strict=True))] = table.column("v").to_numpy()
        numbers = (*(first[c] for c in KEY[1:]), *start, *n, *(first[c] for c in PLACE[6:]))
        return pa.Table.from_arrays([table.column("vol").slice(0, 1), *(pa.array([v], pa.int32()) for v in numbers), pa.array([block.ravel()], pa.list_(pa.float64()))], names=[*KEY, *PLACE, "v"])

    blocks = own.groupBy(*KEY).applyInArrow(one, f"vol {kind}, bz int, by int, bx int, {_PLACES}, v array<double>")
    return cut_buckets(blocks, *KEY)


def rims(blocks: DataFrame, halo: tuple[int, int, int], size: tuple[int, int, int] = SIZE) -> DataFrame:
    """What each block has within ``halo`` of another's box: ``vol, bz, by, bx`` of the other, place, size and values."""
    kind = blocks.schema["vol"].dataType.simpleString()

    def along(axis: int, start: int, n: int, total: int) -> list[tuple[int, int, int]]:
        """Blocks along an axis that the box reaches into, with the part [a, b) of the box that they get."""
        out = []
        for b in range(max(0, (start - halo[axis]) // size[axis]), min(-(-total // size[axis]), (start + n - 1 + halo[axis]) // size[axis] + 1)):
            low, high = b * size[axis] - halo[axis], min((b + 1) * size[axis], total) + halo[axis]
            if max(low, start) < min(high, start + n):
                out.append((b, max(low, start), min(high, start + n)))
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                vol, bz, by, bx, z0, y0, x0, nz, ny, nx, sz, sy, sx = (batch.column(c)[k].as_py() for c in (*KEY, *PLACE))
                own = _flat(batch, "v", k).reshape(nz, ny, nx)
                rows = []
                for tz, a, b in along(0, z0, nz, sz):
                    for ty, c, d in along(1, y0, ny, sy):
                        for tx, e, f in along(2, x0, nx, sx):
                            if (tz, ty, tx) != (bz, by, bx):
                                rows.append((vol, tz, ty, tx, a, c, e, b - a, d - c, f - e, own[a - z0 : b - z0, c - y0 : d - y0, e - x0 : f - x0].ravel()))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("vol").type), *(pa.array(c, pa.int32()) for c in columns[1:10]), pa.array(columns[10], pa.list_(pa.float64()))], names=[*KEY, *PLACE[:6], "v"])

    return blocks.mapInArrow(work, f"vol {kind}, bz int, by int, bx int, {', '.join(f'{c} int' for c in PLACE[:6])}, v array<double>")


def stencil(blocks: DataFrame, f: Callable[[np.ndarray], dict[str, np.ndarray]], outputs: tuple[str, ...], halo: tuple[int, int, int], size: tuple[int, int, int] = SIZE) -> DataFrame:
    """Blocks with ``outputs``, what ``f`` gives of each block with its rim, cut to the block; ``f`` must not reach beyond ``halo``."""
    kind = blocks.schema["vol"].dataType.simpleString()
    parts = rims(blocks, halo, size).groupBy(*KEY).agg(F.collect_list(F.struct(*PLACE[:6], "v")).alias("rim"))
    both = blocks.join(parts, list(KEY), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                place = {c: batch.column(c)[k].as_py() for c in PLACE}
                low = [max(0, place[f"{c}0"] - h) for c, h in zip("zyx", halo, strict=True)]
                high = [min(place[f"s{c}"], place[f"{c}0"] + place[f"n{c}"] + h) for c, h in zip("zyx", halo, strict=True)]
                wide = np.zeros([b - a for a, b in zip(low, high, strict=True)])

                def at(z: int, y: int, x: int, nz: int, ny: int, nx: int, low: list[int] = low) -> tuple[slice, ...]:
                    return tuple(slice(a - o, a - o + n) for a, o, n in ((z, low[0], nz), (y, low[1], ny), (x, low[2], nx)))

                core = at(*(place[c] for c in PLACE[:6]))
                wide[core] = _flat(batch, "v", k).reshape([place[f"n{c}"] for c in "zyx"])
                rim = batch.column("rim")[k]
                for part in rim.values if rim.is_valid else ():
                    box = [part[c].as_py() for c in PLACE[:6]]
                    wide[at(*box)] = part["v"].values.to_numpy().reshape(box[3:])
                found = f(wide)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(k, 1) for c in (*KEY, *PLACE)] + [pa.array([np.ascontiguousarray(found[c][core]).ravel()], pa.list_(pa.float64())) for c in outputs], names=[*KEY, *PLACE, *outputs]
                )

    return both.mapInArrow(work, f"vol {kind}, bz int, by int, bx int, {_PLACES}, {', '.join(f'{c} array<double>' for c in outputs)}")


def to_voxels(blocks: DataFrame, *values: str) -> DataFrame:
    """A row for each place: ``vol, z, y, x`` and the values."""
    cells = blocks.select("vol", *PLACE[:6], F.posexplode(F.arrays_zip(*values)).alias("k", "at"))
    axis = lambda c, e: (F.col(f"{c}0") + F.expr(e)).cast("int").alias(c)
    return cells.select("vol", axis("z", "k div (ny * nx)"), axis("y", "k div nx % ny"), axis("x", "k % nx"), *(F.col(f"at.{c}").alias(c) for c in values))


def smoothed(a: np.ndarray, sigma: float, axes: tuple[int, ...] = (0, 1, 2)) -> np.ndarray:
    """Gaussian smoothing along axes; beyond the array's end, the value there holds."""
    for axis in axes if sigma else ():
        kernel = gaussian_kernel(sigma)
        reach, n = kernel[-1][0], a.shape[axis]
        padded = np.pad(a, [(reach, reach) if k == axis else (0, 0) for k in range(a.ndim)], mode="edge")
        out = np.zeros_like(a)
        for k, w in kernel:
            out += w * np.take(padded, range(reach + k, reach + k + n), axis)
        a = out
    return a


def slope(a: np.ndarray, axis: int) -> np.ndarray:
    """Central differences, one-sided at the array's ends; along a single place there is none (NaN)."""
    return np.gradient(a, axis=axis) if a.shape[axis] > 1 else np.full(a.shape, np.nan)


def ridges(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Saliency and orientation of bright ridges in each slice, as :func:`voxelry.operators.image.ridge` has them."""
    gx, gy = slope(a, 2), slope(a, 1)
    xx, xy, yy = slope(gx, 2), slope(gx, 1), slope(gy, 1)
    trace = xx + yy
    split, cross = (xx * xx + xy * xy) - (yy * yy + xy * xy), trace * xy
    bright = trace < 0
    return np.where(bright, np.sqrt(split * split + 4 * cross * cross), 0.0), np.where(bright, 0.5 * np.arctan2(0.0 - 2 * cross, 0.0 - split), 0.0)


def _reach(sigma: float) -> int:
    return gaussian_kernel(sigma)[-1][0] if sigma else 0


def smooth_blocks(blocks: DataFrame, sigma: float, size: tuple[int, int, int] = SIZE, axes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Blocks smoothed along the axes (0, 1, 2 for z, y, x) as ``v``."""
    halo = tuple(_reach(sigma) if k in axes else 0 for k in range(3))
    return stencil(blocks, lambda a: {"v": smoothed(a, sigma, axes)}, ("v",), halo, size)


def gradient_blocks(blocks: DataFrame, sigma: float = 0.0, size: tuple[int, int, int] = SIZE) -> DataFrame:
    """Gradients ``gz, gy, gx`` of the blocks, smoothed before: both with one exchange."""

    def work(a: np.ndarray) -> dict[str, np.ndarray]:
        s = smoothed(a, sigma)
        return {f"g{c}": slope(s, k) for k, c in enumerate("zyx")}

    return stencil(blocks, work, ("gz", "gy", "gx"), (_reach(sigma) + 1,) * 3, size)


def ridge_blocks(blocks: DataFrame, sigma: float = 0.0, size: tuple[int, int, int] = SIZE) -> DataFrame:
    """Saliency ``s`` and orientation ``o`` of each slice's ridges after smoothing in three dimensions: one exchange."""

    def work(a: np.ndarray) -> dict[str, np.ndarray]:
        s, o = ridges(smoothed(a, sigma))
        return {"s": s, "o": o}

    return stencil(blocks, work, ("s", "o"), (_reach(sigma), _reach(sigma) + 2, _reach(sigma) + 2), size)
