"""Kernels without SQL, against numpy, closed forms and invariants."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelry.functions import splines
from voxelry.functions.columns import orients_absdiff
from voxelry.operators import division, evolution, image, matching, mesh, paths, points, spatial, surface, vote
from voxelry.operators import graph
from voxelry.operators.graph import connected_components


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def image_rows(a, z=0):
    return [(z, y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]


VOX = "z int, y int, x int, v double"


def test_stick_votes_are_sums_over_places():
    rng = np.random.default_rng(0)
    s, o, sigma, n = rng.random((8, 10)), rng.uniform(-1.5, 1.5, (8, 10)), 2.0, (8, 10)
    u = np.zeros(n, complex)
    for (ty, tx), (sy, sx) in itertools.product(np.ndindex(n), np.ndindex(n)):
        dy, dx = ((ty - sy + 4) % 8) - 4, ((tx - sx + 5) % 10) - 5
        r2 = dx * dx + dy * dy
        if r2 >= 1:
            w = np.exp(2j * math.atan2(dy, dx))
            f = math.exp(-r2 / (2 * sigma**2)) / 16
            for k, b in enumerate((1, 4, 6, 4, 1)):
                u[ty, tx] += b * f * w**k * s[sy, sx] * np.exp(-2j * (k - 1) * o[sy, sx])
    got = vote.stick(s, o, sigma)
    assert np.allclose(got[0], abs(u))


def test_vote_by_slice(spark):
    rng = np.random.default_rng(1)
    s, o = rng.random((2, 6, 7)), rng.random((2, 6, 7))
    df = frame(spark, [(z, y, x, float(s[z, y, x]), float(o[z, y, x])) for z, y, x in np.ndindex(2, 6, 7)], "z int, y int, x int, s double, o double")
    for kind in ("stick", "ball"):
        out = np.zeros((2, 6, 7))
        for r in vote.vote(df, 2.0, (6, 7), kind).collect():
            out[r.z, r.y, r.x] = r.s
        for z in (0, 1):
            expected = vote.stick(s[z], o[z], 2.0)[0] if kind == "stick" else vote.ball(s[z], o[z], 2.0)
            assert np.allclose(out[z], expected)


@pytest.mark.parametrize("angle", [0, 45, 90, 135])
def test_ridge_orientation_of_lines(spark, angle):
    y, x = np.mgrid[-10:11, -10:11]
    t = math.radians(angle)
    a = np.exp(-((y * math.cos(t) - x * math.sin(t)) ** 2) / 4)
    r = image.ridge(frame(spark, image_rows(a), VOX)).where("y = 10 and x = 10").first()
    assert r.s > 0
    assert min(abs(r.o - t) % math.pi, math.pi - abs(r.o - t) % math.pi) < 1e-6


def test_nms_keeps_the_crest(spark):
    y, x = np.mgrid[0:9, 0:9]
    a = np.exp(-((y - 4) ** 2) / 4.0)
    rows = [(0, int(i), int(j), float(a[i, j]), 0.0) for i, j in np.ndindex(9, 9)]
    kept = image.non_maximum_suppression(frame(spark, rows, "z int, y int, x int, s double, o double")).collect()
    assert {(r.y, r.x) for r in kept} == {(4, j) for j in range(1, 8)}


def test_gaussian_keeps_constants_and_zero_sigma(spark):
    df = frame(spark, image_rows(np.full((5, 6), 3.0)), VOX)
    assert image.gaussian(df, 0) is df
    assert all(abs(r.v - 3) < 1e-12 for r in image.gaussian(df, 1.5).collect())


def test_flat_images_are_unchanged(spark):
    df = frame(spark, image_rows(np.full((3, 3), 2.0)), VOX)
    assert {r.v for r in image.scale_zscore(df).collect()} == {2.0} == {r.v for r in image.scale_minmax(df).collect()}


def test_value_filter_is_numpys_quantile(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 50, (3, 80)).astype(float)
    df = frame(spark, [(z, 0, x, float(v[z, x])) for z, x in np.ndindex(3, 80)], VOX)
    guide = frame(spark, [(z, k) for z in range(3) for k in range(7)], "z int, k int")
    got = {r.z: r["count"] for r in image.slice_value_filter(df, guide, 3.0).groupBy("z").count().collect()}
    assert got == {z: int((v[z] >= np.quantile(v[z], 1 - 21 / 80)).sum()) for z in range(3)}


def test_orientations(spark):
    got = [r[0] for r in frame(spark, [(0.1, 3.1), (3.1, 0.1), (0.0, math.pi / 2)], "a double, b double").select(orients_absdiff(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(got[1]) and got[0] == pytest.approx(math.pi - 3.0) and got[2] == pytest.approx(math.pi / 2)


@pytest.mark.parametrize("at_once", [0, 100_000])
def test_components_of_random_graphs(spark, monkeypatch, at_once):
    monkeypatch.setattr(graph, "AT_ONCE", at_once)
    rng = random.Random(5)
    for n, m in ((40, 25), (60, 90), (30, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(5)]
        root = list(range(n))

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
        got = {r.id: r.component for r in connected_components(frame(spark, edges, "src long, dst long")).collect()}
        assert got == {k: top(k) for k in {v for e in edges if e[0] != e[1] for v in e}}


def cloud(spark, p):
    return frame(spark, [(k, *map(float, q), int(k * 7 % 13)) for k, q in enumerate(p)], "idx long, z double, y double, x double, v int")


@pytest.mark.parametrize("at_once", [0, 40, 200_000])
def test_exclusion_is_the_greedy_sweep(spark, monkeypatch, at_once):
    monkeypatch.setattr(spatial, "AT_ONCE", at_once)
    rng = np.random.default_rng(6)
    p = rng.integers(0, 12, (80, 3))
    left, kept = sorted(range(80), key=lambda k: (-(k * 7 % 13), k)), []
    while left:
        k = left[0]
        kept.append(k)
        left = [j for j in left if ((p[j] - p[k]) ** 2).sum() > 9]
    assert {r.idx for r in spatial.exclusion(cloud(spark, p), 3.0).collect()} == set(kept)


def test_samples_keep_their_values_when_dealt_anew(spark):
    v = spark.range(1000).select((F.col("id") / 100).cast("int").alias("z"), (F.col("id") / 10 % 10).cast("int").alias("y"), (F.col("id") % 10).cast("int").alias("x"), F.col("id").cast("double").alias("v"))
    p = spark.range(300).select("id", (F.col("id") % 9).cast("double").alias("z"), (F.col("id") % 8 + 0.5).alias("y"), (F.col("id") % 7 + 0.25).alias("x"))
    p = p.unionByName(p.where("id < 5")).unionByName(p.where("id = 7").withColumn("z", F.lit(20.0))).repartition(7, F.xxhash64("id"))
    got = spatial.trilinear(p, v).collect()
    assert len(got) == 306 and sum(r.sample == 0 and r.z == 20 for r in got) == 1
    assert all(abs(r.sample - (100 * r.z + 10 * r.y + r.x)) < 1e-9 for r in got if r.z < 20)


def test_evolution_goes_on_from_its_state():
    rng = np.random.default_rng(9)
    sheet = np.array([[z, 10 + rng.integers(-1, 2), x] for z in range(12) for x in range(40)], float)
    guide = np.array([[z, 10, x] for z in range(12) for x in range(40)], float)
    one, factor = evolution.evolution_of(sheet, guide, (4.0, 12.0), downscale=3.0, r=2.0)
    assert factor == 3.0 and one.r2 == (2 / 3) ** 2  # rows of cells begin at slices 0, 4, 8 and 11: the least gap is 3
    assert evolution.evolution_of(sheet, guide, (4.0, 12.0), downscale=9.0)[1] == 3.0
    wide, factor = evolution.downscaled([[np.array([[z, 0.0, 0.0]])] for z in (0, 2, 5)], 3.0)
    assert factor == 2.0 and [c[0][0][0] for c in wide] == [0, 1, 2]
    assert one.uniform(3).max() == 3 and (one.middle(True)[:, 0] == 0).all() and (one.middle(True)[:, -1] == one.sizes[:, -1] - 1).all()
    one.run(8, max_iter=4)
    state = one.state()
    again = evolution.Evolution.from_state(state)
    one.run(max_iter=9)
    again.run(max_iter=9)
    assert one.log == again.log and len(one.log) == 10 and one.fronts == again.fronts
    picked, surface = one.surfaces(again.pop[:1])[0]
    assert picked.shape[1] == surface.shape[1] == 3


def test_exclusion_includes_its_radius(spark):
    assert spatial.exclusion(cloud(spark, [(0, 0, 0), (0, 0, 3), (0, 0, 6)]), 3.0).count() in (1, 2)
    assert spatial.exclusion(cloud(spark, [(0, 0, 0), (0, 0, 3)]), 3.0).count() == 1


def test_nearest_widens_until_found(spark):
    a = frame(spark, [(0, 0, 0, 0), (1, 0, 0, 500)], "id long, z int, y int, x int")
    b = frame(spark, [(7, 0, 3, 4), (8, 0, 0, 400)], "id long, z int, y int, x int")
    assert {(r.a_id, r.b_id, r.d2) for r in spatial.nearest(a, b, 2.0).collect()} == {(0, 7, 25.0), (1, 8, 10000.0)}


def test_trilinear(spark):
    v = np.arange(27.0).reshape(3, 3, 3)
    vox = frame(spark, [(*map(int, k), float(v[k])) for k in np.ndindex(3, 3, 3)], VOX)
    s = frame(spark, [(0, 0.5, 1.25, 1.75), (1, 2.0, 2.0, 2.0), (2, 5.0, 0.0, 0.0)], "i int, z double, y double, x double")
    got = {r.i: r.sample for r in spatial.trilinear(s, vox).collect()}
    assert got == pytest.approx({0: 0.5 * 9 + 1.25 * 3 + 1.75, 1: 26.0, 2: 0.0})
    with pytest.raises(Exception, match="outside"):
        spatial.trilinear(s, vox, outside="raise").collect()


def test_spline_goes_through_its_points():
    p = np.array([[0, 0], [1, 2], [3, 3], [4, 1], [6, 0.0]])
    assert np.allclose(splines.Curve(p)(splines.centripetal(p)), p)
    with pytest.raises(ValueError):
        splines.Curve(p[:1])
    y, x = np.mgrid[0:5, 0:7].astype(float)
    net = np.stack([y, x, 2 * y], axis=-1)
    assert splines.Surface(net).area() == pytest.approx(24 * math.sqrt(5), rel=1e-3)


def test_contours_match_in_reverse():
    a = np.array([[0, 0], [0, 1], [0, 2], [0, 3.0]])
    best, pairs = paths.match_contours(a, a[::-1] + [1, 0])
    assert np.allclose(best, a + [1, 0]) and pairs == [(k, k) for k in range(4)]
    square = np.array([[0, 0], [0, 1], [1, 1], [1, 0.0]])
    assert np.allclose(paths.match_contours(square, np.roll(square, 2, axis=0), closed=True)[0], square)


def test_interpolation_along_z(spark):
    df = frame(spark, [(1, k, z, y, k) for k in range(4) for z, y in ((0, 0), (4, 8))], "object int, idx long, z int, y int, x int")
    got = {(r.z, r.y, r.x) for r in paths.interpolate_along_z(df).collect()}
    assert got == {(float(z), 2.0 * z, float(k)) for z in range(5) for k in range(4)}


def test_bridges_and_simplified_paths(spark):
    rows = [(k, 0, 0, k, 0.0) for k in range(10)] + [(20, 0, 5, 5, 0.0)]
    c = frame(spark, rows, "idx long, z int, y int, x int, orient double")
    got = sorted(r.idx for r in paths.bridge_gaps(c, c.where("idx in (2, 7)"), 1.5).collect())
    assert got == list(range(2, 8))
    blob = frame(spark, [(k, 0, y, x) for k, (y, x) in enumerate([(0, 0), (0, 1), (1, 1), (0, 2), (0, 3)])], "idx long, z int, y int, x int")
    assert sorted(r.idx for r in paths.simplify_by_path(blob).collect()) == [0, 1, 3, 4]


def test_regions_beside_a_line(spark):
    line = frame(spark, [(k, 0, 10, 10 + k, 1.0, 0.0) for k in range(12)], "idx long, z int, y int, x int, ny double, nx double")
    got = {(r.y, r.x): r.side for r in paths.regions_beside_contour(line, (3.0, 2.0)).collect()}
    assert got[(13, 15)] == 1 and got[(8, 15)] == -1 and (7, 15) not in got and (10, 15) not in got
    assert not any(x < 10 or x > 21 for _, x in got)
    assert any(x < 10 for _, x in {(r.y, r.x) for r in paths.regions_beside_contour(line, (3.0, 2.0), cut_end=False).collect()})


def test_fixed_means(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([np.abs(rng.normal(0, 0.1, 400)), math.pi / 2 - np.abs(rng.normal(0, 0.1, 300))])
    limit = matching.fixed_mean_threshold(frame(spark, [(float(v),) for v in x], "d double"), "d")
    assert 0.2 < limit < 1.2
    assert matching.fixed_mean_threshold(frame(spark, [], "d double"), "d") is None


def test_classes_follow_their_templates(spark):
    rn, rt = (0, 4), 3
    t = matching.class_templates(spatial.box_offsets(rn, rt), rn, rt)
    rng = np.random.default_rng(9)
    rows = [(k, i, j, float(t[k % 2][i, j] + rng.normal(0, 0.1))) for k in range(40) for i, j in np.ndindex(t[0].shape)]
    got = {r.idx: r["class"] for r in matching.classify_boxes(frame(spark, rows, "idx long, i int, j int, value double"), rn, rt).collect()}
    assert got == {k: k % 2 for k in range(40)}


def test_normals_of_a_plane_and_a_sphere():
    y, x = np.mgrid[0:12, 0:12].astype(float)
    p = np.column_stack([(0.5 * y + 2).ravel(), y.ravel(), x.ravel()])
    n = mesh.point_normals(p, 3.0, np.array([-100.0, 0, 0]))
    assert np.allclose(n, np.array([1, -0.5, 0]) / math.sqrt(1.25), atol=1e-6)
    k = np.arange(400)
    t, f = np.arccos(1 - 2 * (k + 0.5) / 400), math.pi * (1 + 5**0.5) * k
    s = 20 * np.column_stack([np.cos(t), np.sin(t) * np.sin(f), np.sin(t) * np.cos(f)])
    out = mesh.point_normals(s, 6.0)
    dots = (out * s).sum(axis=1) / 20
    assert (abs(dots) > 0.95).all() and (np.sign(dots) == np.sign(dots[0])).all()


def test_hull_holds_its_points(spark):
    rng = np.random.default_rng(10)
    p = rng.random((200, 3))
    f = mesh.hull_facets(p)
    assert (p @ f[:, :3].T + f[:, 3] < 1e-7).all()
    cube = np.array(list(itertools.product((0, 1), repeat=3)), float)
    f = mesh.hull_facets(np.concatenate([cube, rng.random((50, 3))]))
    assert np.allclose(sorted({tuple(np.round(a, 6) + 0.0) for a in f}), sorted([(-1, 0, 0, 0), (0, -1, 0, 0), (0, 0, -1, 0), (0, 0, 1, -1), (0, 1, 0, -1), (1, 0, 0, -1)]))
    with pytest.raises(ValueError):
        mesh.hull_facets(np.zeros((9, 3)))


def test_subdivision_keeps_a_plane(spark):
    v = frame(spark, [(k, 0.0, float(k // 3), float(k % 3)) for k in range(9)], "vid long, z double, y double, x double")
    t = frame(spark, [(2 * k + s, *q) for k, c in enumerate((0, 1, 3, 4)) for s, q in enumerate(((c, c + 1, c + 3), (c + 1, c + 4, c + 3)))], "tid long, a long, b long, c long")
    nv, nt = mesh.subdivide(v, t)
    got = nv.collect()
    assert nt.count() == 32 and len(got) == 25 and len({r.vid for r in got}) == 25
    assert all(r.z == 0 and -1e-9 <= r.y <= 2 + 1e-9 for r in got)


def test_front_is_not_dominated(spark):
    rng = random.Random(11)
    rows = [(k, rng.randrange(30), rng.randrange(30)) for k in range(200)]
    got = {r.id for r in surface.pareto_front(frame(spark, rows, "id int, f1 int, f2 int")).collect()}
    assert got == {a for a, x, y in rows if not any(p <= x and q <= y and (p, q) != (x, y) for _, p, q in rows)}


def test_selection_and_ranks():
    fit = [(1.0, 5), (2.0, 3), (3.0, 1), (3.0, 4), (4.0, 6)]
    assert evolution.ranks(fit).tolist() == [0, 0, 0, 1, 2]
    assert set(evolution.select(fit, 3)) == {0, 1, 2}


def test_evolution_finds_a_sheet():
    rng = np.random.default_rng(12)
    z, x = (a.ravel() for a in np.mgrid[0:10, 0:40])
    sheet = np.column_stack([z, 20 + np.zeros_like(z), x]).astype(float)
    noise = np.column_stack([rng.integers(0, 10, 30), rng.integers(10, 30, 30), rng.integers(0, 40, 30)]).astype(float)
    guide = sheet[np.lexsort((sheet[:, 2], sheet[:, 0]))]
    fit, e = evolution.robust_surface(np.concatenate([sheet, noise]), guide, (4.0, 12.0), pop_size=12, max_iter=12, seed=3)
    assert e.log[-1] <= e.log[0] and np.median(abs(fit[:, 1] - 20)) <= 1
    assert evolution.surface_area(sheet, guide, (4.0, 12.0)) == pytest.approx(9 * 39, rel=0.05)


def test_division_splits_by_orientation(spark):
    rows = [(k, 0.0, 0.0, float(k), 0.0 if k < 20 else 1.5) for k in range(40)]
    p = frame(spark, rows, "idx long, z double, y double, x double, orient double")
    parts = {r.idx: r.part for r in division.divide(p, 1.5).collect()}
    assert len(parts) == 40 and len(set(parts.values())) == 2
    with pytest.raises(ValueError):
        division.one_component(p, 1.5, 100)
    two = division.two_components(p, 1.5, 3)
    assert {r.part for r in two.collect()} == {1, 2}


def test_reference_point_is_beside_the_cloud(spark):
    p = frame(spark, [(k, 0.0, 0.0, float(k)) for k in range(10)] + [(10 + k, 1.0, 0.0, float(k)) for k in range(10)], "idx long, z double, y double, x double")
    ref = points.reference_point(p, 5.0)
    assert abs(abs(ref[1]) - 5) < 1e-6


def test_erosion_counts_the_outside_as_set(spark):
    px = frame(spark, [(0, y, x) for y in range(3) for x in range(3)], "z int, y int, x int")
    assert image.erode(px).count() == 1
    assert image.erode(px, shape=(3, 3)).count() == 9


def test_box_mask_leaves_a_range_out():
    assert {n for n, _, _ in spatial.box_offsets((-2, 3), 1, (0, 1))} == {-2, -1, 2, 3}


def test_outline_of_a_block_and_of_the_longer_of_two(spark):
    def outline(mask):
        rows = frame(spark, [(0, *map(int, p)) for p in np.argwhere(mask)], "z int, y int, x int")
        return np.array([(r.y, r.x) for r in image.component_contour(rows, erode_first=False).orderBy("idx").collect()])

    line = outline(np.ones((3, 4), bool))
    assert np.allclose(line[0], line[-1]) and len(line) == 15 and np.abs(np.diff(line, axis=0)).max() <= 1
    assert {tuple(p) for p in line} == {(-0.5, float(x)) for x in range(4)} | {(2.5, float(x)) for x in range(4)} | {(float(y), -0.5) for y in range(3)} | {(float(y), 3.5) for y in range(3)}
    m = np.zeros((6, 12), bool)
    m[1, 1], m[1:5, 4:10], m[2, 6] = True, True, False
    outer = outline(m)
    assert len(outer) == 21 and outer[:, 1].min() == 3.5
    px = frame(spark, [(z, y, x) for z in (0, 1) for y in range(6) for x in range(7)], "z int, y int, x int")
    got = image.component_contour(px).groupBy("z").count().collect()
    assert {(r.z, r["count"]) for r in got} == {(0, 2 * (4 + 5) + 1), (1, 2 * (4 + 5) + 1)}
    assert image.component_contour(px, erode_first=False).where("y < 0").count() > 0


def test_components_across_slices(spark):
    px = frame(spark, [(0, 0, 0, 0), (1, 1, 1, 0), (2, 2, 1, 1), (3, 2, 5, 5), (4, 2, 5, 6)], "id long, z int, y int, x int")
    axes = ("z", "y", "x")
    assert {(r.id, r.size) for r in image.largest_image_components(px, 1, 2, axes, ()).collect()} == {(0, 3), (1, 3), (2, 3)}
    assert {(r.id, r.size) for r in image.largest_image_components(px, 1, 1, axes, ()).collect()} == {(3, 2), (4, 2)}


def test_slices_are_spread(spark):
    assert image.spread_slices(frame(spark, [(z,) for z in range(3, 14)], "z int"), 3) == [3, 8, 13]


def test_cubic_spline_is_exact_for_cubics_inside(spark):
    from voxelry.operators import membranogram as mg

    z, y, x = np.mgrid[0:30, 0:30, 0:30].astype(float)
    f = lambda a, b, c: a * b - 0.02 * c**3 + 0.5 * b**2
    c = mg.spline_coefficients(f(z, y, x))
    at = np.array([[14.25, 15.5, 14.75], [15.0, 14.0, 15.0]])
    assert np.allclose(mg.cubic(c, at), f(*at.T), atol=1e-3)
    vox = frame(spark, [(a, b, d, float(a + 2 * b)) for a in range(3) for b in range(4) for d in range(5)], "z int, y int, x int, v double")
    p = frame(spark, [(7, 1.0, 1.0, 2.0, 0.0, 1.0, 0.0)], "idx long, z double, y double, x double, nz double, ny double, nx double")
    assert mg.sample_cubic(p, vox, 0.5).first().sample == pytest.approx(1 + 2 * 1.5, abs=0.1)


def test_cubic_samples_by_cubes_equal_those_of_the_whole_volume(spark, monkeypatch):
    from voxelry.operators import membranogram as mg

    monkeypatch.setattr(mg, "CUBE", 30)
    monkeypatch.setattr(mg, "AT_ONCE", 7)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3, 8, 130))
    vox = frame(spark, [(a + 2, b - 4, d, float(v[a, b, d])) for a, b, d in np.ndindex(v.shape)], "z int, y int, x int, v double")
    at = rng.uniform((0, -8, -40), (8, 8, 170), (90, 3))
    rows = [(k, *map(float, q), 0.0, 1.0, 0.0) for k, q in enumerate(at)]
    p = frame(spark, [*rows, (90, 1.0, 1.0, 1.0, None, None, None)], "idx long, z double, y double, x double, nz double, ny double, nx double")
    got = {r.idx: r.sample for r in mg.sample_cubic(p, vox, 0.5).collect()}
    want = mg.cubic(mg.spline_coefficients(v), at + (0, 0.5, 0) - (2, -4, 0))
    assert len(got) == 91 and (got[90] is None or np.isnan(got[90]))
    assert np.allclose([got[k] for k in range(90)], want, atol=1e-10)
    assert mg.sample_cubic(p, vox.limit(0), 0.5).where("sample is null").count() == 91


def test_embedding_unrolls_a_cylinder(spark):
    from voxelry.operators import membranogram as mg

    a, h = (v.ravel() for v in np.meshgrid(np.linspace(0, 2, 30), np.arange(20), indexing="ij"))
    p = np.column_stack([h, 15 * np.sin(a), 15 * np.cos(a)])
    e = mg.tangent_embedding(p, 12)
    fit = np.linalg.lstsq(np.column_stack([e, np.ones(len(e))]), np.column_stack([a, h]), rcond=None)
    assert (1 - fit[1] / (np.column_stack([a, h]) - [a.mean(), h.mean()]).var(axis=0) / len(a) > 0.98).all()
    df = frame(spark, [(k, int(q[0]), float(q[1]), float(q[2])) for k, q in enumerate(p)], "idx long, z int, y double, x double")
    assert mg.embed(df, 2, 8).count() == len(p)


def test_principal_components_of_boxes(spark):
    from voxelry.operators import membranogram as mg

    rows = [(k, i, j, float(k * (i + 1) + j)) for k in range(6) for i in range(2) for j in range(3)]
    got = mg.box_components(frame(spark, rows, "idx long, i int, j int, value double")).collect()
    c = np.array([r.components for r in sorted(got)])
    assert abs(np.corrcoef(c[:, 0], np.arange(6))[0, 1]) > 0.999


@pytest.mark.parametrize("few", [3, 100_000])
def test_exact_quantiles(spark, few):
    rng = np.random.default_rng(13)
    v = np.concatenate([rng.normal(0, 1, 900), np.full(300, 0.25), [1e6, -1e6]])
    df = frame(spark, [(float(x),) for x in v] + [(None,)], "v double")
    qs = (0.0, 0.02, 0.37, 0.5, 0.98, 1.0)
    assert np.allclose(image.exact_quantiles(df, "v", qs, few, 16), np.quantile(v, qs))
    assert image.exact_quantiles(df.limit(0), "v", (0.5,)) == [None]
