"""What the fourth round's findings asked for, in the small."""

import math

import numpy as np
import pytest

from voxelry.operators import communities, crowds, division

R, SIGMA = 12.0, math.pi / 4
CLOUD = "idx long, z double, y double, x double, orient double"


def weight(a, b):
    d = (b - a) % math.pi
    return math.exp(-0.5 * (min(d, math.pi - d) / SIGMA) ** 2)


def all_edges(rows):
    """Each pair of points within the radius, with its weight."""
    return [(p[0], q[0], weight(p[4], q[4])) for k, p in enumerate(rows) for q in rows[k + 1 :] if sum((a - b) ** 2 for a, b in zip(p[1:4], q[1:4], strict=True)) <= R * R]


def points_of(kind, n=260):
    rng = np.random.default_rng(14)
    if kind == "grid":  # few places and orientations, with points on top of each other
        at, orient = rng.integers(-14, 15, (n, 3)), rng.integers(0, 31, n) / 10.0
        at[n // 2 :, 0], orient[-20:], at[-20:] = 3, 0.7, at[-1]
    else:
        at, orient = rng.normal(0, 9, (n, 3)), rng.uniform(-4, 4, n)
    return [(1000 - k, *map(float, at[k]), float(orient[k])) for k in range(n)]


@pytest.mark.parametrize("kind", ["grid", "free"])
@pytest.mark.parametrize("block", [8192, 7])
def test_sums_between_crowds_are_those_of_all_edges(spark, monkeypatch, kind, block):
    monkeypatch.setattr(crowds, "BLOCK", block)
    rows = points_of(kind)
    odd = [(5000, None, 0.0, 0.0, 1.0), (5001, 0.0, math.inf, 0.0, 1.0), (5002, 0.0, 0.0, 0.0, None), (5003, 0.0, 0.0, 0.0, math.nan)]
    members, sums = crowds.crowds(spark.createDataFrame(rows + odd, CLOUD), R, SIGMA)
    of = {r["id"]: r["crowd"] for r in members.collect()}
    assert of.keys() == {r[0] for r in rows} and all(of[c] == c and c <= v for v, c in of.items())
    place = {r[0]: np.array(r[1:4]) for r in rows}
    orient = {r[0]: r[4] for r in rows}
    for v, c in of.items():
        assert ((place[v] - place[c]) ** 2).sum() <= R * R and weight(orient[v], orient[c]) > 0.9
    expected = {}
    for a, b, w in all_edges(rows):
        e = expected.setdefault((min(of[a], of[b]), max(of[a], of[b])), [0.0, 0])
        e[0], e[1] = e[0] + w, e[1] + 1
    got = {(r["src"], r["dst"]): (r["weight"], r["n"]) for r in sums.collect()}
    assert got.keys() == expected.keys()
    assert all(got[k][1] == expected[k][1] and got[k][0] == pytest.approx(expected[k][0], rel=1e-12) for k in expected)


def test_both_ways_of_summing_agree(monkeypatch):
    rng = np.random.default_rng(15)

    def block(n, shift):
        at = rng.integers(0, 7, (n, 3)) + [0, 0, shift]
        kind = rng.integers(0, 9, n)
        rows = sorted({(*map(float, p), k / 3.0, int(k // 4) + 10 * shift) for p, k in zip(at, kind.tolist(), strict=True)})
        return crowds._Block(crowds.pa.array([{"pz": z, "py": y, "px": x, "orient": o, "n": 1 + i % 3, "crowd": c} for i, (z, y, x, o, c) in enumerate(rows)]))

    a, b = block(70, 0), block(50, 7)
    for step in (1 << 22, 64):
        monkeypatch.setattr(crowds, "AT_A_TIME", step)
        for other, same in ((b, False), (a, True)):
            for x, y in zip(crowds._by_kind(a, other, 6.0, SIGMA, same), crowds._by_sort(a, other, 6.0, SIGMA, same), strict=True):
                assert x == pytest.approx(y, rel=1e-12) and x.sum() > 0


def heaps(copies):
    """Two heaps within a radius of each other in each of two places; every second one has other orientations."""
    rng = np.random.default_rng(16)
    rows = []
    for k, (x, o) in enumerate(((0, 0.2), (8, 1.7), (60, 0.2), (68, 1.7))):
        for p, d in zip(rng.integers(0, 4, (30, 3)), rng.uniform(-0.1, 0.1, 30), strict=True):
            rows += [(float(p[0]), float(p[1]), float(p[2] + x), float(o + d), k)] * copies
    # The two places hang together by a chain.
    rows += [(0.0, 0.0, float(x), 0.9, 9) for x in range(18, 60, 10)]
    return [(k, *r[:4]) for k, r in enumerate(rows)], [r[4] for r in rows]


@pytest.mark.parametrize("at_once", [200, 60])
def test_crowded_clouds_are_divided_without_a_table_of_edges(spark, monkeypatch, at_once):
    rows, heap = heaps(3)
    df = spark.createDataFrame(rows, CLOUD)
    edges = all_edges(rows)
    members, sums = crowds.crowds(df, R, SIGMA)
    monkeypatch.setattr(communities, "AT_ONCE", at_once)
    monkeypatch.setattr(division, "LISTED", 0)
    found, levels = communities.communities_of_groups(sums)
    label = {r["id"]: r["community"] for r in members.join(found.withColumnRenamed("id", "crowd"), "crowd").collect()}
    # Levels tell the modularity of the points' own graph.
    graph = spark.createDataFrame(edges, "src long, dst long, weight double")
    labels = spark.createDataFrame([*label.items()], "id long, community long")
    assert levels == sorted(levels) and levels[-1] == pytest.approx(communities.modularity(graph, labels))
    assert levels[-1] >= communities.communities(graph)[1][-1] - 0.02
    monkeypatch.setattr(division, "neighbor_edges", lambda *a, **k: pytest.fail("pairs of points were listed"))
    part = {r["idx"]: r["part"] for r in division.divide(df, R, SIGMA).collect()}
    assert part.keys() == {r[0] for r in rows} and set(part.values()) == {0, 1}
    assert all(len({part[k] for k, h in enumerate(heap) if h in two}) == 1 for two in ((0, 1), (2, 3)))
    assert part[0] != part[heap.index(2)]


def test_sums_do_not_grow_with_the_pairs(spark):
    few, many = (crowds.crowds(spark.createDataFrame(heaps(n)[0], CLOUD), R, SIGMA)[1].toPandas() for n in (1, 12))
    assert len(many) <= 1.2 * len(few) and many["n"].sum() > 100 * few["n"].sum()


def test_points_that_share_an_id_and_small_clouds_are_listed(spark, monkeypatch):
    rows = points_of("grid", 60)
    monkeypatch.setattr(division, "crowds", lambda *a: pytest.fail("few points are no crowd"))
    small = {tuple(r) for r in division.divide_points(spark.createDataFrame(rows, CLOUD), R).collect()}
    monkeypatch.setattr(division, "LISTED", 0)
    twice = {tuple(r) for r in division.divide_points(spark.createDataFrame(rows + rows[:1], CLOUD), R).collect()}
    assert {i for i, _ in small} == {i for i, _ in twice}
