"""The programs on a small volume with two dark sheets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelry.plans import pipelines

NZ, NY, NX = 10, 40, 48


@pytest.fixture(scope="module")
def volume(spark):
    rng = np.random.default_rng(0)
    y = np.arange(NY)[None, :, None]
    v = 10 - 6 * np.exp(-((y - 16) ** 2) / 3.0) - 6 * np.exp(-((y - 24) ** 2) / 3.0) + rng.normal(0, 0.3, (NZ, NY, NX))
    rows = [(z, yy, x, float(v[z, yy, x])) for z, yy, x in np.ndindex(NZ, NY, NX)]
    return spark.createDataFrame(rows, "z int, y int, x int, v double").cache()


@pytest.fixture(scope="module")
def segmented(spark, volume):
    model = spark.createDataFrame([(k, z, 20, x) for z in (1, NZ - 2) for k, x in enumerate(range(5, NX - 5, 3))], "idx long, z int, y int, x int")
    args = pipelines.SegmentArgs(extend=10, neigh_thresh=2, detect_smooth=1, detect_tv=4, detect_filt=3.5, components_min=0.2, fit_lengrids=(4, 12), fit_popsize=8, fit_maxiter=4, meshrefine_spacing=4)
    return pipelines.segment(volume, model, (NY, NX), args, reference=(4.0, -50.0, 24.0), by_region=True)


def test_finds_both_sheets(segmented):
    by = {r.label: r for r in segmented.results.groupBy("label").agg(F.count("*").alias("n"), F.expr("percentile(y, 0.5)").alias("y"), F.avg("ny").alias("ny")).collect()}
    assert set(by) == {1, 2}
    assert abs(by[1].y - 16) <= 1.5 and abs(by[2].y - 24) <= 1.5
    assert by[1].ny > 0.8 and by[2].ny < -0.8
    d = segmented.distances.groupBy("label").agg(F.expr("percentile(dist_nm, 0.5)").alias("d")).collect()
    assert all(6 <= r.d <= 10 for r in d) and len(d) == 2
    assert all(r.area_nm2 > 50 for r in segmented.areas.collect())


def test_samples_and_membranogram(segmented, volume):
    surface = segmented.results.where("label = 1").select("idx", "z", "y", "x", "nz", "ny", "nx")
    kept = pipelines.sampling_localmax(surface, volume, 1.0, (1, 4, 1), 3.0)
    p = np.array([(r.z, r.y, r.x) for r in kept.collect()])
    d2 = ((p[:, None] - p[None]) ** 2).sum(axis=2) + 1e9 * np.eye(len(p))
    assert len(p) > 3 and d2.min() > 9
    assert set(r["class"] for r in pipelines.sampling_classify(kept, volume, 1.0, (1, 4, 2)).collect()) <= {0, 1}
    assert pipelines.sampling_excluded(surface, 1.0, 6.0).count() < surface.count() / 5
    strided = pipelines.sampling_strided(surface, 1.0, 5.0, 3.0, seed=1)
    assert 0 < strided.count() < surface.count() / 8
    assert pipelines.sampling_boxes(strided, volume, 1.0, (0, 2, 1)).select("idx").distinct().count() == strided.count()
    view = pipelines.membranogram(surface, volume, [0.0, 1.0], outside="min")
    r = view.agg(F.count("*"), F.min("v"), F.max("v")).first()
    assert r[0] == surface.count() and r[1] == pytest.approx(0) and r[2] == pytest.approx(1)
