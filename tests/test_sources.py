import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelry.sources import mrc, points, state


@pytest.mark.parametrize("kind", ["int8", "int16", "uint16", "float32", "int64", "float64", "complex64"])
def test_volume_round_trip(kind):
    v = (np.arange(60).reshape(3, 4, 5) % 50).astype(kind)
    data, pixel = mrc.parse(mrc.encode(v, 2.5))
    assert data.shape == (3, 4, 5) and pixel == pytest.approx(2.5) and np.array_equal(np.real(data), np.real(v))
    with pytest.raises(ValueError):
        mrc.parse(b"\xff" * 2000)


def test_reads_clipped_voxels(spark, tmp_path):
    v = np.arange(60, dtype="float32").reshape(3, 4, 5)
    (tmp_path / "a.mrc").write_bytes(mrc.encode(v, 1.0))
    got = {(r.z, r.y, r.x): r.v for r in mrc.read_voxels(spark, str(tmp_path / "a.mrc"), (1, None, 2), (None, 3, None)).collect()}
    assert got == {(z, y, x): float(v[z, y, x]) for z in (1, 2) for y in range(3) for x in range(2, 5)}
    near = spark.createDataFrame([(0, 1, 1, 1), (1, 2, 1, 3)], "idx int, z int, y int, x int")
    assert mrc.read_near(spark, str(tmp_path / "a.mrc"), near).count() == 2 * 1 * 3
    out = str(tmp_path / "b.mrc")
    mrc.write_volume(mrc.read_voxels(spark, str(tmp_path / "a.mrc")), out, (3, 4, 5), 1.5)
    data, pixel = mrc.parse(open(out, "rb").read())
    assert np.array_equal(data, v) and pixel == pytest.approx(1.5)


@pytest.mark.parametrize("partial", [True, False])
def test_reads_parts_of_files(spark, tmp_path, monkeypatch, partial):
    """Runs of slices and bands of lines, by parts and from whole files, clipped or not, give the files' numbers."""
    monkeypatch.setattr(mrc, "RUN", 90)
    monkeypatch.setattr(mrc, "BAND", 11)
    if not partial:
        monkeypatch.setattr(mrc, "PARTIAL", frozenset())
    many = {}
    for k, (name, kind) in enumerate((("a b", "int16"), ("c", "float32"), ("d", "complex64"))):
        v = (np.arange(7 * 5 * (4 + k)).reshape(7, 5, 4 + k) % 90).astype(kind)
        (tmp_path / f"{name}.mrc").write_bytes(mrc.encode(v, k + 1.0))
        many[f"{name}.mrc"] = v
    at = {r.vol.rpartition("/")[2]: (r.nz, r.ny, r.nx, r.pixel) for r in mrc.read_layouts(spark, str(tmp_path)).collect()}
    assert at == {name: (*v.shape, pytest.approx(k + 1.0)) for k, (name, v) in enumerate(many.items())}
    for low, high in (((None,) * 3, (None,) * 3), ((2, 1, 1), (6, 4, 3)), ((-3, 0, 0), (1, 99, 99)), ((9, 0, 0), (12, 2, 2)), ((0, 3, 0), (2, 3, 2))):
        got = {(r.vol.rpartition("/")[2], r.z, r.y, r.x): r.v for r in mrc.read_voxels(spark, str(tmp_path), low, high).collect()}
        inside = lambda p: all((a is None or i >= a) and (b is None or i < b) for i, a, b in zip(p, low, high, strict=True))  # noqa: B023,E731
        assert got == {(name, *p): float(v[p].real) for name, v in many.items() for p in np.ndindex(v.shape) if inside(p)}
    (tmp_path / "short.mrc").write_bytes(mrc.encode(many["c.mrc"])[:-4])
    with pytest.raises(Exception, match="buffer is smaller"):
        mrc.read_voxels(spark, str(tmp_path / "short.mrc")).collect()


def test_points_round_trip(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1 1 3.5 4 2\n  2 1   7 8.25 3.9 \n\n")
    df = points.read_points(spark, str(tmp_path / "p.txt"))
    assert {tuple(r) for r in df.collect()} == {(1, 1, 3.5, 4.0, 2), (2, 1, 7.0, 8.25, 3)}
    points.write_points(df, str(tmp_path / "out"))
    assert {tuple(r) for r in points.read_points(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in df.collect()}
    with pytest.raises(ValueError):
        points.write_points(df.limit(0), str(tmp_path / "no"))
    (tmp_path / "bad.txt").write_text("1 2 3\n")
    with pytest.raises(Exception, match="five columns"):
        points.read_points(spark, str(tmp_path / "bad.txt")).collect()


def test_model_of_clouds(spark):
    df = spark.createDataFrame([("b", 1, 0, 0, 0), ("b", 2, 0, 0, 9), ("a", 1, 0, 0, 0)], "label string, idx int, z int, y int, x int")
    model = points.clouds_to_model(points.number_objects(df), 5.0)
    assert {(r.object, r.contour) for r in model.collect()} == {(1, 1), (2, 1), (2, 2)}


def test_state(spark, tmp_path):
    path = str(tmp_path / "state")
    state.save(spark, path, {"mode": "run", "extend": 30}, {"guide": spark.range(3), "detect": spark.range(5)})
    state.save(spark, path, {"mode": "again"}, {"detect": spark.range(2).withColumn("z", F.lit(1))})
    assert state.load_args(spark, path) == {"mode": "again"}
    assert state.load_step(spark, path, "guide").count() == 3 and state.load_step(spark, path, "detect").columns == ["id", "z"]
