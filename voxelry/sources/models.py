"""Binary models of points, objects and contours: ``spark.read.format("pointmodel")`` and writing them.

A file begins with ``IMODV1.2`` and a fixed part; then come chunks of a name of four letters and, in most, a length:
``OBJT`` (an object, of fixed length), ``CONT`` (a contour: the number of its points, flags, then x, y, z of each), ``MESH`` (vertices
and a list), others, ``IEOF``. Numbers are big-endian. Files are read side by side, each chunk by chunk, so a task holds
one contour's points at a time; what isn't a contour is passed over. A file that ends early gives its whole contours, and
then a row with ``problem`` and no numbers; with option ``clipped`` = ``fail`` (the default) it is an error.

Written are rows ``vol, object, contour, x, y, z`` in the order of a task's rows; all rows of a model must be in one
task, those of a contour together and objects in order, as :func:`write_models` deals and sorts them. Contours are open
(not joined at their ends). Gaps in the numbers of objects and contours become empty ones, so numbers stay as they are.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from voxelry.sources.mrc import _opened
from voxelry.sources.mrc_source import local
from voxelry.sources.points import read_points

SCHEMA = "vol string, object int, contour int, x double, y double, z double, problem string"
COLUMNS = ("object", "contour", "x", "y", "z")
#: Fixed values of the format: how a file begins, bytes of its first part and of an object, the flag of open contours.
BEGIN, FIRST, OBJECT, OPEN_CONTOUR = b"IMODV1.2", 232, 176, 1 << 3


class Clipped(ValueError):
    pass


def _taken(f: BinaryIO, n: int, what: str) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise Clipped(f"the model ends within {what}")
    return data


def contours(f: BinaryIO) -> Iterator[tuple[int, int, np.ndarray]]:
    """Object and contour, both from 1, and the points (x, y, z) of each contour."""
    if _taken(f, len(BEGIN), "its first letters") != BEGIN:
        raise ValueError("not a model of points")
    _taken(f, FIRST, "its first part")
    number = contour = 0
    while True:
        name = f.read(4)
        if name == b"IEOF":
            return
        if len(name) < 4:
            raise Clipped("the model has no end" if not name else "the model ends within a chunk's name")
        if name == b"OBJT":
            _taken(f, OBJECT, "an object")
            number, contour = number + 1, 0
        elif name == b"CONT":
            n, _, _, _ = struct.unpack(">4i", _taken(f, 16, "a contour"))
            contour += 1
            yield number, contour, np.frombuffer(_taken(f, 12 * n, "a contour's points"), ">f4").reshape(n, 3)
        elif name == b"MESH":
            vertices, entries, _, _, _ = struct.unpack(">3i2h", _taken(f, 16, "a mesh"))
            _taken(f, 12 * vertices + 4 * entries, "a mesh's numbers")
        else:
            _taken(f, struct.unpack(">i", _taken(f, 4, "a chunk's length"))[0], "a chunk")


def _text(s: str, n: int) -> bytes:
    return s.encode()[: n - 1].ljust(n, b"\0")


def first_part(objects: int, name: str = "") -> bytes:
    """The bytes before the objects."""
    numbers = struct.pack(">4iI4i", 0, 0, 0, objects, 1 << 13, 1, 1, 0, 255) + struct.pack(">6f", 0, 0, 0, 1, 1, 1)
    return BEGIN + (_text(name, 128) + numbers + struct.pack(">5i", 0, 0, 0, 3, 128) + struct.pack(">f2i3f", 1, 0, 0, 0, 0, 0)).ljust(FIRST, b"\0")


def encoded_object(own: list[np.ndarray], name: str = "") -> bytes:
    """An object of open contours, each an array of (x, y, z)."""
    head = _text(name, 64) + bytes(64) + struct.pack(">iIii", len(own), OPEN_CONTOUR, 0, 1) + struct.pack(">3fi", 0, 1, 0, 0) + bytes((1, 3, 1, 1, 0, 0, 0, 0)) + struct.pack(">2i", 0, 0)
    return b"OBJT" + head + b"".join(b"CONT" + struct.pack(">iIii", len(p), 0, 0, 0) + p.astype(">f4").tobytes() for p in own)


@dataclass
class File(InputPartition):
    path: str


class ModelReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.clipped = options["path"], options.get("clipped", "fail")

    def partitions(self) -> list[File]:
        here = local(self.path)
        if here is None:
            return [File(self.path)]
        names = glob.glob(f"{glob.escape(here)}/*.mod") if os.path.isdir(here) else glob.glob(here)
        return [File(f"file://{os.path.abspath(n)}") for n in sorted(names)]

    def read(self, part: File | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return

        def rows(n: int, **given) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string())
            names = ("vol", *COLUMNS, "problem")
            return pa.RecordBatch.from_arrays([pa.array(given[c], k) if c in given else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=list(names))

        with _opened(part.path) as f:
            try:
                for number, contour, p in contours(f):
                    n = len(p)
                    yield rows(n, vol=[part.path] * n, object=[number] * n, contour=[contour] * n, **{c: p[:, k].astype("<f8") for k, c in enumerate("xyz")})
            except Clipped as e:
                if self.clipped == "fail":
                    raise Clipped(f"{part.path}: {e}") from None
                yield rows(1, vol=[part.path], problem=[str(e)])


@dataclass
class Written(WriterCommitMessage):
    names: list = field(default_factory=list)


class ModelWriter(DataSourceArrowWriter):
    def __init__(self, options, schema, overwrite: bool):
        self.columns, self.overwrite, self.path, self.run = schema.names, overwrite, local(options["path"]), uuid.uuid4().hex
        if self.path is None:
            raise ValueError("models are written to folders that the executors share as files")
        if not {"vol", *COLUMNS} <= set(self.columns):
            raise ValueError(f"a model needs the columns vol, {', '.join(COLUMNS)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done: list[tuple[str, str]] = []
        vol, number, own, objects, f = None, 0, [], 0, None

        def ended_object(to: int) -> None:
            nonlocal number, own, objects
            while number < to:
                if number:
                    f.write(encoded_object(own))
                    objects += 1
                number, own = number + 1, []

        def ended() -> None:
            if f is not None:
                ended_object(number + 1)
                f.write(b"IEOF")
                f.seek(0)
                f.write(first_part(objects))
                f.close()

        os.makedirs(self.path, exist_ok=True)
        for batch in iterator:
            columns = {c: batch.column(self.columns.index(c)) for c in ("vol", *COLUMNS)}
            vols = columns["vol"].cast(pa.string()).to_pylist()
            obj, cont = (columns[c].to_numpy(zero_copy_only=False).astype(int) for c in ("object", "contour"))
            xyz = np.stack([columns[c].to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], axis=1)
            keys = list(zip(vols, obj.tolist(), cont.tolist(), strict=True))
            starts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                name, o, c = keys[a]
                if name != vol:
                    ended()
                    vol, number, own, objects = name, 0, [], 0
                    temporary, final = f"{self.path}/.{vol}.{self.run}.{uuid.uuid4().hex}", f"{self.path}/{vol}.mod"
                    done.append((temporary, final))
                    f = open(temporary, "wb")  # noqa: SIM115  closed by ended()
                    f.write(first_part(0))
                ended_object(o)
                own += [np.empty((0, 3))] * (c - len(own))
                own[c - 1] = np.concatenate((own[c - 1], xyz[a:b]))
        ended()
        return Written(done)

    def commit(self, messages: list[Written]) -> None:
        for message in messages:
            for temporary, final in message.names if message else ():
                if not self.overwrite and os.path.exists(final):
                    raise FileExistsError(final)
                os.replace(temporary, final)

    def abort(self, messages: list[Written]) -> None:
        for left in glob.glob(f"{glob.escape(self.path)}/.*.{self.run}.*"):
            os.unlink(left)


class ModelSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pointmodel"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ModelReader:
        return ModelReader(self.options)

    def writer(self, schema, overwrite: bool) -> ModelWriter:
        return ModelWriter(self.options, schema, overwrite)


def read_models(spark: SparkSession, path: str, clipped: str = "fail") -> DataFrame:
    """``vol, object, contour, x, y, z, problem`` of the models at ``path``."""
    spark.dataSource.register(ModelSource)
    return spark.read.format("pointmodel").option("clipped", clipped).load(path)


def read_model(spark: SparkSession, path: str, z_type: str = "int") -> DataFrame:
    """``object, contour, x, y, z`` of a model, binary or in text lines."""
    begins = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, len(BEGIN)).alias("b")).where(F.col("b") == F.lit(BEGIN))
    if begins.isEmpty():
        return read_points(spark, path, z_type)
    return read_models(spark, path).select("object", "contour", "x", "y", F.col("z").cast(z_type).alias("z"))


def write_models(points: DataFrame, path: str, *order: str) -> None:
    """Writes a model for each ``vol``: its objects' contours, points by ``order``. A model without points is an error."""
    if points.isEmpty():
        raise ValueError("the model has no points")
    points.sparkSession.dataSource.register(ModelSource)
    dealt = points.repartition("vol").sortWithinPartitions("vol", "object", "contour", *order)
    dealt.select("vol", *(F.col(c).cast("int" if c in ("object", "contour") else "double").alias(c) for c in COLUMNS)).write.format("pointmodel").mode("overwrite").save(path)
