"""``spark.read.format("mrc")`` and ``df.write.format("mrc")``: volumes as a data source.

Reading gives a row for each place, ``vol, z, y, x, v``, from tasks that each open a run of slices; comparisons with
``z``, ``y`` and ``x`` in the query's filter choose the slices, lines and columns that are read at all. Writing takes the same
columns (or those without ``vol``, for one volume) from rows dealt and sorted in any way: each task writes its numbers to
their own bytes of a file beside the target, so nothing passes the driver but each task's sums, and a task that is run
again writes the same bytes again. At the end the header is written and the file gets its name; after a failure it goes.

Files are in a folder that all executors share (reading also from the stores that pyarrow opens). Options: ``path``;
to write, ``shape`` (nz,ny,nx), ``pixel``, ``kind`` (the numbers' type). Places without a row are 0; places must differ.

Use :func:`read_volumes` for a table that serves several queries: Spark 4.1 keeps a table's last pushed filters for a later
query that pushes none, so the table there always has a filter to push.
"""

from __future__ import annotations

import glob
import math
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from voxelry.sources.mrc import HEADER, Layout, _opened, header, layout, stored

SCHEMA = "vol string, z int, y int, x int, v double"
#: Bytes of a task's slices, about, and numbers of a batch of rows, about.
RUN, BATCH = 1 << 26, 1 << 18
AXES = ("z", "y", "x")


def local(path: str) -> str | None:
    """The place in the file system that the executors share, if it is there."""
    if re.match(r"[a-z0-9]+:", path) is None:
        return path
    return "/" + path.partition(":")[2].lstrip("/") if path.startswith("file:") else None


def files_at(path: str) -> list[str]:
    """The files of a folder, a pattern or a single name, as URIs."""
    here = local(path)
    if here is not None:
        names = glob.glob(f"{glob.escape(here)}/*.mrc") if os.path.isdir(here) else glob.glob(here)
        return [f"file://{os.path.abspath(n)}" for n in sorted(names)]
    system, name = fs.FileSystem.from_uri(path)
    info = system.get_file_info(name)
    scheme = path.partition(":")[0]
    found = system.get_file_info(fs.FileSelector(name)) if info.type == fs.FileType.Directory else [info]
    return sorted(f"{scheme}://{f.path.lstrip('/') if scheme != 'hdfs' else f.path}" for f in found if f.type == fs.FileType.File and f.path.endswith(".mrc"))


@dataclass
class Run(InputPartition):
    """A volume's slices first to last (not included), and the lines and columns wanted of them."""

    path: str
    at: Layout
    first: int
    last: int
    ys: tuple[int, int]
    xs: tuple[int, int]


class MrcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.box, self.none = options["path"], {c: [0, math.inf] for c in AXES}, False

    def pushFilters(self, filters: list[Filter]):
        """Comparisons of z, y and x with numbers narrow the box; all others stay with Spark."""
        kinds = {GreaterThanOrEqual: (1, 0), GreaterThan: (1, 1), LessThanOrEqual: (0, 1), LessThan: (0, 0), EqualTo: (1, 0)}
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) not in kinds or name not in self.box or not isinstance(f.value, int):
                yield f
                continue
            below, more = kinds[type(f)]
            box = self.box[name]
            if below:
                box[0] = max(box[0], f.value + more)
            else:
                box[1] = min(box[1], f.value + more)
            if isinstance(f, EqualTo):
                box[1] = min(box[1], f.value + 1)

    def partitions(self) -> list[Run]:
        runs = []
        for path in files_at(self.path):
            with _opened(path) as f:
                at = layout(f.read(HEADER))
            (z0, z1), ys, xs = ((int(low), int(min(high, n))) for (low, high), n in zip(self.box.values(), (at.nz, at.ny, at.nx), strict=True))
            if ys[0] >= ys[1] or xs[0] >= xs[1]:
                continue
            step = max(1, RUN // max(1, at.ny * at.nx * at.kind.itemsize))
            runs += [Run(path, at, z, min(z + step, z1), ys, xs) for z in range(z0, z1, step)]
        return runs

    def read(self, run: Run | None) -> Iterator[pa.RecordBatch]:
        if run is None:  # no file, or a filter that nothing meets
            return
        at, (y0, y1), (x0, x1) = run.at, run.ys, run.xs
        size, nx = at.kind.itemsize, x1 - x0
        # Whole lines at once, unless most of each line isn't wanted.
        whole = 2 * nx >= at.nx
        lines = max(1, BATCH // nx)
        with _opened(run.path) as f:

            def part(first: int, n: int) -> np.ndarray:
                f.seek(at.start + first * size)
                return np.frombuffer(f.read(n * size), at.kind, n)

            for z in range(run.first, run.last):
                for y in range(y0, y1, lines):
                    ny = min(lines, y1 - y)
                    if whole:
                        v = part((z * at.ny + y) * at.nx, ny * at.nx).reshape(ny, at.nx)[:, x0:x1]
                    else:
                        v = np.stack([part((z * at.ny + k) * at.nx + x0, nx) for k in range(y, y + ny)])
                    v = (v.real if v.dtype.kind == "c" else v).astype("<f8").ravel()
                    yy, xx = np.repeat(np.arange(y, y + ny, dtype=np.int32), nx), np.tile(np.arange(x0, x1, dtype=np.int32), ny)
                    columns = [pa.array([run.path] * len(v), pa.string()), pa.array(np.full(len(v), z, np.int32)), pa.array(yy), pa.array(xx), pa.array(v)]
                    yield pa.RecordBatch.from_arrays(columns, names=["vol", *AXES, "v"])


@dataclass
class Sums(WriterCommitMessage):
    """By volume: number, least, greatest, sum and sum of squares of what a task wrote."""

    by: dict = field(default_factory=dict)


class MrcWriter(DataSourceArrowWriter):
    def __init__(self, options, schema, overwrite: bool):
        self.columns, self.overwrite = schema.names, overwrite
        if not {*AXES, "v"} <= set(self.columns):
            raise ValueError("a volume needs the columns z, y, x and v")
        self.path = local(options["path"])
        if self.path is None:
            raise ValueError("volumes are written to folders that the executors share as files")
        self.shape = tuple(int(n) for n in options["shape"].split(","))
        self.pixel, self.kind = float(options.get("pixel", "1")), stored(np.zeros((1, 1, 1), options.get("kind", "float32"))).dtype
        self.run = uuid.uuid4().hex

    def name(self, vol: str | None) -> str:
        return self.path if vol is None else f"{self.path}/{vol}.mrc"

    def waiting(self, vol: str | None) -> str:
        """The file until all is written: in the same folder, so that it only changes its name."""
        folder, _, name = self.name(vol).rpartition("/")
        return f"{folder}/.{name}.{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sums:
        nz, ny, nx = self.shape
        by: dict[str | None, list] = {}
        size = self.kind.itemsize
        for batch in iterator:
            z, y, x = (batch.column(self.columns.index(c)).to_numpy(zero_copy_only=False) for c in AXES)
            v = batch.column(self.columns.index("v")).to_numpy(zero_copy_only=False).astype(self.kind)
            inside = (z >= 0) & (z < nz) & (y >= 0) & (y < ny) & (x >= 0) & (x < nx)
            place = (z.astype(np.int64) * ny + y) * nx + x
            if "vol" in self.columns:
                coded = batch.column(self.columns.index("vol")).cast(pa.string()).dictionary_encode()
                names, code = coded.dictionary.to_pylist(), coded.indices.fill_null(len(coded.dictionary)).to_numpy()
                names.append(None)
            else:
                names, code = [None], np.zeros(batch.num_rows, np.int64)
            # By volume and place, so that a volume's rows are one range, however many volumes a batch has.
            rows = np.flatnonzero(inside)
            rows = rows[np.lexsort((place[rows], code[rows]))]
            starts = np.flatnonzero(np.diff(code[rows], prepend=-1))
            for first, last in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
                vol, own = names[code[rows[first]]], rows[first:last]
                place_of, value = place[own], v[own]
                os.makedirs(os.path.dirname(self.waiting(vol)) or ".", exist_ok=True)
                handle = os.open(self.waiting(vol), os.O_WRONLY | os.O_CREAT)
                try:
                    ends = np.flatnonzero(np.diff(place_of) != 1) + 1
                    for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(place_of)], strict=True):
                        os.pwrite(handle, value[a:b].tobytes(), HEADER + int(place_of[a]) * size)
                finally:
                    os.close(handle)
                real = np.abs(value).astype(float) if self.kind.kind == "c" else value.astype(float)
                old = by.get(vol, [0, math.inf, -math.inf, 0.0, 0.0])
                by[vol] = [old[0] + len(real), min(old[1], real.min()), max(old[2], real.max()), old[3] + real.sum(), old[4] + (real * real).sum()]
        return Sums(by)

    def commit(self, messages: list[Sums]) -> None:
        total: dict[str | None, list] = {}
        for message in messages:
            for vol, (n, low, high, s, s2) in (message.by if message else {}).items():
                old = total.get(vol, [0, math.inf, -math.inf, 0.0, 0.0])
                total[vol] = [old[0] + n, min(old[1], low), max(old[2], high), old[3] + s, old[4] + s2]
        if not total and "vol" not in self.columns:
            open(self.waiting(None), "wb").close()
            total[None] = [0, 0.0, 0.0, 0.0, 0.0]
        size = math.prod(self.shape)
        for vol, (n, low, high, s, s2) in total.items():
            low, high = (min(low, 0.0), max(high, 0.0)) if n < size else (low, high)
            mean = s / size if size else 0.0
            head = header(self.shape, self.kind, self.pixel, (low, high, mean, math.sqrt(max(s2 / size - mean * mean, 0.0)) if size else 0.0))
            with open(self.waiting(vol), "r+b") as f:
                f.write(head)
                f.truncate(HEADER + size * self.kind.itemsize)
            if not self.overwrite and os.path.exists(self.name(vol)):
                os.unlink(self.waiting(vol))
                raise FileExistsError(self.name(vol))
            os.replace(self.waiting(vol), self.name(vol))

    def abort(self, messages: list[Sums]) -> None:
        folder = self.path if "vol" in self.columns else os.path.dirname(self.path) or "."
        for left in glob.glob(f"{glob.escape(folder)}/.*.{self.run}"):
            os.unlink(left)


class MrcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mrc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MrcReader:
        return MrcReader(self.options)

    def writer(self, schema, overwrite: bool) -> MrcWriter:
        return MrcWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("mrc")`` known to a session, and has Spark hand filters to sources like it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MrcSource)


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """``vol, z, y, x, v`` of the volumes at ``path``."""
    register(spark)
    return spark.read.format("mrc").load(path).where("z >= 0")
