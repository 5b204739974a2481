"""Volumes in MRC files: read as rows of slices or voxels, written from voxels.

The header (1024 bytes, 2014 format) gives sizes, the number type, cell lengths and the length of an extended header.
Headers are read first; then tasks read runs of slices side by side, each only the bytes of the rows asked for, so a
file may be of any size and a small box of a large volume costs little. Where tasks cannot open parts of files
themselves, Spark loads each file whole in one task.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Number types by mode.
MODES = {0: "i1", 1: "i2", 2: "f4", 4: "c8", 6: "u2", 12: "f2"}
HEADER = 1024
#: Where tasks read parts of files.
PARTIAL = frozenset(("file", "hdfs", "s3", "gs"))
#: Bytes that a run of slices has, about, and values that a row of a table holds at most, if a line has no more.
RUN, BAND = 1 << 26, 1 << 22
MOST_TASKS = 100_000


class Layout(NamedTuple):
    nz: int
    ny: int
    nx: int
    kind: np.dtype
    #: Bytes before the numbers.
    start: int
    #: Mean voxel size in angstrom.
    pixel: float


def layout(head: bytes) -> Layout:
    """What the header says."""
    order = "<"
    nx, ny, nz, mode = struct.unpack("<4i", head[:16])
    if mode not in MODES:
        order = ">"
        nx, ny, nz, mode = struct.unpack(">4i", head[:16])
    if mode not in MODES:
        raise ValueError(f"unknown number type {mode}")
    grid = struct.unpack(f"{order}3i", head[28:40])
    cell = struct.unpack(f"{order}3f", head[40:52])
    sizes = [c / g for c, g in zip(cell, grid, strict=True) if g]
    return Layout(nz, ny, nx, np.dtype(order + MODES[mode]), HEADER + struct.unpack(f"{order}i", head[92:96])[0], float(np.mean(sizes)) if sizes else 0.0)


def parse(content: bytes) -> tuple[np.ndarray, float]:
    """The volume (z, y, x) and the mean voxel size in angstrom."""
    at = layout(content)
    return np.frombuffer(content, at.kind, at.nx * at.ny * at.nz, at.start).reshape(at.nz, at.ny, at.nx), at.pixel


def stored(volume: np.ndarray) -> np.ndarray:
    """The volume in a type that the format has: int16, uint16, float32 or complex64."""
    kinds = {"i": "<i2", "b": "<i2", "u": "<u2", "f": "<f4", "c": "<c8"}
    return np.ascontiguousarray(volume, dtype=volume.dtype if volume.dtype == np.int8 else kinds[volume.dtype.kind])


def header(shape: tuple[int, int, int], kind: np.dtype, pixel: float, stats: tuple[float, float, float, float]) -> bytes:
    """The bytes before a volume's numbers: sizes, number type, voxel size, and least, greatest, mean and deviation."""
    mode = next(k for k, t in MODES.items() if np.dtype(t) == np.dtype(kind).newbyteorder("="))
    nz, ny, nx = shape
    low, high, mean, deviation = stats
    out = struct.pack("<10i6f3i3f2i", nx, ny, nz, mode, 0, 0, 0, nx, ny, nz, nx * pixel, ny * pixel, nz * pixel, 90, 90, 90, 1, 2, 3, low, high, mean, 1, 0)
    out = out.ljust(104, b"\0") + b"\0\0\0\0" + struct.pack("<i", 20140)
    out = out.ljust(208, b"\0") + b"MAP " + bytes([0x44, 0x44, 0, 0]) + struct.pack("<fi", deviation, 0)
    return out.ljust(HEADER, b"\0")


def encode(volume: np.ndarray, pixel: float = 1.0) -> bytes:
    """The bytes of a file with the volume and a voxel size."""
    v = stored(volume)
    real = np.abs(v) if v.dtype.kind == "c" else v
    stats = tuple(float(f(real)) if v.size else 0.0 for f in (np.min, np.max, np.mean, np.std))
    return header(v.shape, v.dtype, pixel, stats) + v.tobytes()


def count_files(spark: SparkSession, path: str) -> int:
    """The number of files at ``path``."""
    return spark.read.format("binaryFile").load(path).select("path").count()


def _opened(path: str):
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _part(path: str, at: int, n: int) -> bytes:
    with _opened(path) as f:
        f.seek(at)
        return f.read(n)


def _within(a: int | None, b: int | None, n: int) -> range:
    """The places of [a, b) among n."""
    return range(*slice(None if a is None else max(0, int(a)), None if b is None else int(b)).indices(n))


def _bands(vol: str, part: Callable[[int, int], bytes], at: Layout, zs: range, low, high) -> Iterator[pd.DataFrame]:
    """Rows of :func:`read_slices`, ``part`` giving bytes by place and length."""
    ys, xs = (_within(low[k], high[k], n) for k, n in ((1, at.ny), (2, at.nx)))
    lines = max(1, BAND // max(len(xs), 1))
    for z in zs:
        for y in ys[::lines]:
            ny = min(lines, ys.stop - y)
            data = part(at.start + (z * at.ny + y) * at.nx * at.kind.itemsize, ny * at.nx * at.kind.itemsize)
            v = np.frombuffer(data, at.kind, ny * at.nx).reshape(ny, at.nx)[:, xs.start : xs.stop]
            v = (v.real if v.dtype.kind == "c" else v).astype(float)
            yield pd.DataFrame({"vol": [vol], "pixel": [at.pixel], "z": [z], "y0": [y], "x0": [xs.start], "ny": [ny], "nx": [len(xs)], "v": [v.ravel()]})


def _files(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """The files at ``path`` and whether tasks can read parts of them."""
    files = spark.read.format("binaryFile").load(path)
    return files, {name.partition(":")[0] for name in files.inputFiles()} <= PARTIAL


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """``vol, pixel, nz, ny, nx`` of the files at ``path``, from their headers."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            heads = pdf["head"] if "head" in pdf else (_part(vol, 0, HEADER) for vol in pdf["path"])
            for vol, head in zip(pdf["path"], heads, strict=True):
                at = layout(head)
                yield pd.DataFrame({"vol": [vol], "pixel": [at.pixel], "nz": [at.nz], "ny": [at.ny], "nx": [at.nx]})

    files, partial = _files(spark, path)
    files = files.select("path") if partial else files.select("path", F.substring("content", 1, HEADER).alias("head"))
    return files.mapInPandas(work, "vol string, pixel double, nz int, ny int, nx int")


def read_slices(spark: SparkSession, path: str, low=(None, None, None), high=(None, None, None)) -> DataFrame:
    """``vol, pixel, z, y0, x0, ny, nx, v`` of the files at ``path``, within a box [low, high).

    ``v`` has the values of ``ny`` lines from ``y0`` on, line by line: a slice's or, of a large one, a part's.
    """

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for vol in pdf["path"]:
                at = layout(_part(vol, 0, HEADER))
                zs = _within(low[0], high[0], at.nz)
                first = list(zs[:: max(1, RUN // max(1, at.ny * at.nx * at.kind.itemsize))])
                yield pd.DataFrame({"vol": vol, "first": first, "last": [*first[1:], zs.stop][: len(first)]})

    def by_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for vol, first, last in zip(pdf["vol"], pdf["first"], pdf["last"], strict=True):
                with _opened(vol) as f:

                    def part(at: int, n: int) -> bytes:
                        f.seek(at)
                        return f.read(n)

                    yield from _bands(vol, part, layout(part(0, HEADER)), range(first, last), low, high)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for vol, content in zip(pdf["path"], pdf["content"], strict=True):
                at = layout(content)
                yield from _bands(vol, lambda a, n: content[a : a + n], at, _within(low[0], high[0], at.nz), low, high)

    schema = "vol string, pixel double, z int, y0 int, x0 int, ny int, nx int, v array<double>"
    files, partial = _files(spark, path)
    if not partial:
        return files.select("path", "content").mapInPandas(whole, schema)
    size = files.agg(F.sum("length")).first()[0] or 0
    planned = files.select("path").mapInPandas(runs, "vol string, first int, last int")
    return planned.repartition(min(size // RUN + 1, MOST_TASKS)).mapInPandas(by_part, schema)


def read_voxels(spark: SparkSession, path: str, low=(None, None, None), high=(None, None, None)) -> DataFrame:
    """``vol, z, y, x, v``: a row for each place, in the file's coordinates."""
    s = read_slices(spark, path, low, high)
    return s.select("vol", "z", "y0", "x0", "nx", F.posexplode("v").alias("k", "v")).select("vol", "z", (F.col("y0") + F.floor(F.col("k") / F.col("nx"))).cast("int").alias("y"), (F.col("x0") + F.col("k") % F.col("nx")).cast("int").alias("x"), "v")


def read_near(spark: SparkSession, path: str, points: DataFrame, margin: float = 0.0) -> DataFrame:
    """The voxels of the box around points, widened by a margin."""
    from voxelry.operators.points import points_range

    r = points_range(points, margin).first()
    return read_voxels(spark, path, tuple(r[f"lo_{c}"] for c in "zyx"), tuple(r[f"hi_{c}"] + 1 for c in "zyx"))


def write_volume(voxels: DataFrame, path: str, shape: tuple[int, int, int], pixel: float = 1.0, value: str = "v", kind: str = "float32") -> None:
    """Writes one volume (whole, unsigned or real numbers); places without a row are 0, those outside the shape are left out.

    Tasks write their numbers to their own bytes of the file: see :mod:`voxelry.sources.mrc_source`.
    """
    from voxelry.sources import mrc_source

    mrc_source.register(voxels.sparkSession)
    rows = voxels.select(*(F.col(c).cast("int").alias(c) for c in "zyx"), F.col(value).alias("v"))
    rows.write.format("mrc").option("shape", ",".join(map(str, shape))).option("pixel", str(pixel)).option("kind", kind).mode("overwrite").save(path)
