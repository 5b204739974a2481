"""Blocks with rims, volume and model files as data sources."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from tests.oracle import connect, same
from voxelry.operators import blocks, image
from voxelry.plans import volumes
from voxelry.sources import models, mrc, mrc_source


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(volumes.ORACLE))
def test_same_as_sql(spark, sf, duck, name):
    same(volumes.QUERIES[name](spark, sf), duck, volumes.ORACLE[name])


def image_rows(spark, shape, vols=2, seed=0):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(vols, *shape)).round(3)
    return data, spark.createDataFrame([(v, *map(int, p), float(data[(v, *p)])) for v in range(vols) for p in np.ndindex(shape)], "vol int, z int, y int, x int, v double")


@pytest.mark.parametrize("size", [(3, 4, 5), (2, 2, 2), (64, 64, 64)])
def test_blocks_equal_rows_and_whole_arrays(spark, size):
    """Also where a rim reaches over several blocks."""
    shape = (5, 7, 11)
    data, rows = image_rows(spark, shape)
    b = blocks.to_blocks(rows, size)
    assert b.count() == 2 * np.prod([-(-n // s) for n, s in zip(shape, size, strict=True)])
    at = lambda df, c: {(r.vol, r.z, r.y, r.x): r[c] for r in df.collect()}
    assert at(blocks.to_voxels(b, "v"), "v") == {(v, *p): data[(v, *p)] for v in range(2) for p in np.ndindex(shape)}
    by_rows = at(image.gaussian(rows, 0.8, axes=("z", "y", "x"), by=("vol",)), "v")
    by_blocks = at(blocks.to_voxels(blocks.smooth_blocks(b, 0.8, size), "v"), "v")
    assert by_rows.keys() == by_blocks.keys() and all(abs(by_rows[k] - by_blocks[k]) < 1e-9 for k in by_rows)
    ridge = blocks.to_voxels(blocks.ridge_blocks(b, 0.8, size), "s", "o")
    by_row_ridge = image.ridge3d(rows, 0.8, by=("vol", "z"))
    a, c = at(ridge, "s"), at(by_row_ridge, "s")
    assert all(abs(a[k] - c[k]) < 1e-9 for k in c)
    g = at(blocks.to_voxels(blocks.gradient_blocks(b, 0.8, size), "gz", "gy", "gx"), "gz")
    whole = np.stack([np.gradient(blocks.smoothed(d, 0.8), axis=0) for d in data])
    assert all(abs(g[k] - whole[k]) < 1e-9 for k in g)


def test_only_rims_are_shuffled(spark):
    """Blocks stay where they are; what is shuffled are the voxels within the halo of other blocks."""
    _, rows = image_rows(spark, (8, 12, 16), 1)
    size, halo = (4, 6, 8), (1, 2, 1)
    b = blocks.to_blocks(rows, size)
    moved = blocks.rims(b, halo, size).select(F.sum(F.size("v"))).first()[0]
    wide = [(4 + 1) * 2, (6 + 2) * 2, (8 + 1) * 2]
    assert moved == np.prod(wide) - 8 * 12 * 16
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = blocks.smooth_blocks(b, 0.4, size)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_blocks_of_sparse_volumes(spark):
    rows = spark.createDataFrame([("a", 0, 0, 0, 4.0), ("b", 5, 0, 0, 2.0)], "vol string, z int, y int, x int, v double")
    b = blocks.to_blocks(rows, (2, 2, 2), (6, 1, 1))
    got = {(r.vol, r.z): r.v for r in blocks.to_voxels(blocks.stencil(b, lambda a: {"v": a + a.sum()}, ("v",), (2, 2, 2), (2, 2, 2)), "v").collect()}
    assert got == {("a", 0): 8.0, ("a", 1): 4.0, ("b", 4): 2.0, ("b", 5): 4.0}
    assert blocks.to_voxels(blocks.smooth_blocks(blocks.to_blocks(rows.limit(0)), 1.0), "v").count() == 0
    with pytest.raises(Exception, match="(?i)ansi|exception|error"):
        blocks.stencil(b, lambda a: {"other": a}, ("v",), (0, 0, 0), (2, 2, 2)).count()


@pytest.mark.parametrize("kind", ["int16", "uint16", "float32", "int8"])
def test_volume_source_round_trip(spark, tmp_path, kind):
    mrc_source.register(spark)
    rng = np.random.default_rng(1)
    data = rng.integers(0, 90, (3, 5, 4, 6))
    rows = [(f"v{v}", *map(int, p), float(data[(v, *p)])) for v in range(3) for p in np.ndindex(data.shape[1:]) if data[(v, *p)]]
    df = spark.createDataFrame(rows, "vol string, z int, y int, x int, v double").repartition(7)
    folder = str(tmp_path / "out")
    df.write.format("mrc").option("shape", "5,4,6").option("pixel", "3.5").option("kind", kind).mode("overwrite").save(folder)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["v0.mrc", "v1.mrc", "v2.mrc"]
    for v in range(3):
        content = (tmp_path / "out" / f"v{v}.mrc").read_bytes()
        got, pixel = mrc.parse(content)
        assert (got == data[v]).all() and pixel == pytest.approx(3.5)
        assert np.frombuffer(content, "<f4", 3, 76) == pytest.approx([data[v].min(), data[v].max(), data[v].mean()])
    got = mrc_source.read_volumes(spark, folder)
    assert got.count() == 3 * 120 and got.select(F.sum("v")).first()[0] == data.sum()
    box = got.where("z between 2 and 3 and y = 1 and x > 2 and v > 5 and vol like '%v1.mrc'")
    assert {(r.z, r.x, r.v) for r in box.collect()} == {(z, x, data[1, z, 1, x]) for z in (2, 3) for x in range(3, 6) if data[1, z, 1, x] > 5}
    assert got.where("z > 7").count() == 0 and got.where("z = 1 or y = 2").count() == 3 * (24 + 5 * 6 - 6)
    assert got.count() == 3 * 120
    with pytest.raises(Exception, match="FileExists"):
        df.write.format("mrc").option("shape", "5,4,6").mode("append").save(folder)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".")]


def test_volume_source_reads_only_the_box(tmp_path, monkeypatch):
    """Bytes are counted: the header and the lines of the box, or the columns where most of a line isn't wanted."""
    v = np.arange(10 * 8 * 100, dtype="float32").reshape(10, 8, 100)
    path = tmp_path / "a.mrc"
    path.write_bytes(mrc.encode(v))
    read: list[int] = []

    class Counted(io.FileIO):
        def read(self, n=-1):
            data = super().read(n)
            read.append(len(data))
            return data

    monkeypatch.setattr(mrc_source, "_opened", lambda p: Counted(path))
    for filters, left, shape, of_lines in (
        ([GreaterThanOrEqual(("z",), 3), LessThanOrEqual(("z",), 5)], 0, (3, 8, 100), 100),
        ([GreaterThan(("z",), 3), LessThan(("y",), 2), In(("x",), (1, 2))], 1, (6, 2, 100), 100),
        ([EqualTo(("z",), 9), EqualTo(("x",), 7), EqualTo(("vol",), "a")], 1, (1, 8, 1), 1),
        ([EqualTo(("z",), 30)], 0, (0, 0, 0), 1),
    ):
        reader = mrc_source.MrcReader({"path": str(path)})
        assert len(list(reader.pushFilters(filters))) == left
        read.clear()
        rows = sum(b.num_rows for run in reader.partitions() for b in reader.read(run))
        assert rows == np.prod(shape) and sum(read) == mrc.HEADER + shape[0] * shape[1] * of_lines * 4
    assert list(mrc_source.MrcReader({"path": str(tmp_path / "none.mrc")}).partitions()) == []


def test_written_parts_do_not_touch_each_other(spark, tmp_path):
    """Rows in any order and dealt in any way, and a task run twice, give the same file."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("z int, y int, x int, v double")
    writer = mrc_source.MrcWriter({"path": str(tmp_path / "a.mrc"), "shape": "2,3,4"}, schema, True)
    data = np.arange(24.0)
    place = np.random.default_rng(0).permutation(24)

    def batch(k):
        return pa.RecordBatch.from_arrays([pa.array((k // 12).astype("int32")), pa.array((k // 4 % 3).astype("int32")), pa.array((k % 4).astype("int32")), pa.array(data[k])], names=["z", "y", "x", "v"])

    first, second = [batch(place[:5]), batch(place[5:13])], [batch(place[13:])]
    writer.write(iter(first))
    writer.commit([writer.write(iter(first)), writer.write(iter(second)), None])
    assert (mrc.parse((tmp_path / "a.mrc").read_bytes())[0].ravel() == data).all()
    writer.write(iter(first))
    writer.abort([])
    assert [p.name for p in tmp_path.iterdir()] == ["a.mrc"]


CONTOURS = {1: [[(1, 2, 3), (4, 5, 6)], [], [(7, 8, 9)]], 2: [], 3: [[(0.5, 0.25, 1)]]}


def encoded(clip=None, mesh=True):
    """A model by the format's description, written here apart from the library's encoder."""
    import struct

    out = b"IMODV1.2" + b"name".ljust(128, b"\0") + bytes(12) + struct.pack(">i", len(CONTOURS)) + bytes(232 - 128 - 16)
    for own in CONTOURS.values():
        out += b"OBJT" + b"o".ljust(64, b"\0") + bytes(64) + struct.pack(">i", len(own)) + bytes(44)
        for p in own:
            out += b"CONT" + struct.pack(">4i", len(p), 0, 0, 0) + b"".join(struct.pack(">3f", *q) for q in p)
        if mesh:
            out += b"MESH" + struct.pack(">3i2h", 2, 3, 0, 0, 0) + bytes(24 + 12) + b"IMAT" + struct.pack(">i", 16) + bytes(16)
    out += b"MINX" + struct.pack(">i", 72) + bytes(72) + b"IEOF"
    return out[:clip]


ROWS = {(o, c, *map(float, p)) for o, own in CONTOURS.items() for c, points in enumerate(own, 1) for p in points}


def test_binary_models(spark, tmp_path):
    (tmp_path / "a.mod").write_bytes(encoded())
    (tmp_path / "b.mod").write_bytes(encoded(mesh=False))
    got = models.read_models(spark, str(tmp_path))
    for name in "ab":
        assert {tuple(r)[1:6] for r in got.where(f"vol like '%{name}.mod'").collect()} == ROWS
    assert models.read_model(spark, str(tmp_path / "a.mod")).dtypes[-1] == ("z", "int")
    (tmp_path / "t.txt").write_text("1 2 3.5 4 5\n")
    assert [tuple(r) for r in models.read_model(spark, str(tmp_path / "t.txt")).collect()] == [(1, 2, 3.5, 4.0, 5)]
    (tmp_path / "c.mod").write_bytes(b"no model at all")
    with pytest.raises(Exception, match="not a model"):
        models.read_models(spark, str(tmp_path / "c.mod")).count()


def test_clipped_models(spark, tmp_path):
    """Wherever a file ends, its whole contours come and the rest is reported."""
    whole = encoded()
    first = whole.index(b"CONT") + 20 + 24
    for k, clip in enumerate((5, 100, 300, first - 1, first, first + 2, len(whole) - 50, len(whole) - 4)):
        (tmp_path / f"{k}.mod").write_bytes(whole[:clip])
        rows = models.read_models(spark, str(tmp_path / f"{k}.mod"), "keep").collect()
        assert [bool(r.problem) for r in rows] == [False] * (len(rows) - 1) + [True] and rows[-1].object is None
        assert {tuple(r)[1:6] for r in rows[:-1]} == ({p for p in ROWS if p[:2] == (1, 1)} if first <= clip < first + 9 else ROWS if clip > first + 9 else set())
        with pytest.raises(Exception, match="ends within|no end"):
            models.read_models(spark, str(tmp_path / f"{k}.mod")).count()


def test_models_round_trip(spark, tmp_path):
    rows = [(v, *p) for v in ("a", "b") for p in ROWS] + [("c", 2, 5, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "vol string, object int, contour int, x double, y double, z double")
    models.write_models(df, str(tmp_path / "m"), "x")
    got = models.read_models(spark, str(tmp_path / "m")).collect()
    assert {(r.vol.rpartition("/")[2][0], *tuple(r)[1:6]) for r in got} == set(rows) and not any(r.problem for r in got)
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == ["a.mod", "b.mod", "c.mod"]
    with pytest.raises(ValueError):
        models.write_models(df.limit(0), str(tmp_path / "n"))
