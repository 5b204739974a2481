"""Communities, cuts, spanning forests and shortest paths against plain versions."""

import heapq
import random
from collections import defaultdict

import numpy as np
import pytest

from voxelry.operators import communities, division, forest, isolines, mesh, nearest_place, paths, shortest, spectral


def graph(spark, edges):
    return spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in edges], "src long, dst long, weight double")


def blobs(sizes, inside, across, seed):
    rnd = random.Random(seed)
    first = np.cumsum([0, *sizes])
    of = [g for g, n in enumerate(sizes) for _ in range(n)]
    edges = [(i, j, rnd.choice((1.0, 2.0))) for i in range(first[-1]) for j in range(i) if rnd.random() < (inside if of[i] == of[j] else across)]
    return edges + [(first[g], first[g + 1], 0.5) for g in range(len(sizes) - 1)], of


def plain_modularity(edges, label):
    inside, total, m2 = defaultdict(float), defaultdict(float), 2 * sum(w for *_, w in edges)
    for a, b, w in edges:
        total[label[a]] += w
        total[label[b]] += w
        if label[a] == label[b]:
            inside[label[a]] += 2 * w
    return sum(inside[c] / m2 - (total[c] / m2) ** 2 for c in total)


def plain_communities(edges):
    """Moves one by one to the best community, then contraction, until nothing gains; connected parts become communities of their own."""
    vertices = sorted({v for a, b, _ in edges for v in (a, b)})
    member = {v: v for v in vertices}
    now = list(edges)
    m2 = 2 * sum(w for *_, w in edges)
    while True:
        near, degree = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for a, b, w in now:
            degree[a] += w
            degree[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        label = {v: v for v in degree}
        total = dict(degree)
        moved = changed = True
        changed = False
        while moved:
            moved = False
            for v in sorted(degree):
                weights = defaultdict(float)
                for u, w in near[v].items():
                    weights[label[u]] += w
                total[label[v]] -= degree[v]
                best = max([label[v], *sorted(weights)], key=lambda c: (weights[c] / m2 * 2 - 2 * degree[v] * total[c] / m2**2, c == label[v]))
                if best != label[v]:
                    moved = changed = True
                label[v] = best
                total[best] += degree[v]
        member = {v: label[member[v]] for v in member}
        if not changed:
            return member
        now = [(label[a], label[b], w) for a, b, w in now]


def connected(vertices, edges):
    near = defaultdict(set)
    for a, b, _ in edges:
        if a in vertices and b in vertices:
            near[a].add(b)
            near[b].add(a)
    seen, todo = set(), [next(iter(vertices))]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += near[v]
    return seen == vertices


@pytest.mark.parametrize("kind", ["blobs", "cliques"])
def test_communities_are_as_good_as_plain_ones(spark, kind):
    """Also: modularity doesn't fall from level to level, and communities are connected."""
    if kind == "blobs":
        edges, _ = blobs((20, 15, 25, 12), 0.5, 0.01, 4)
    else:
        edges = [(6 * g + i, 6 * g + j, 1.0) for g in range(8) for i in range(6) for j in range(i)] + [(6 * g, 6 * ((g + 1) % 8) + 1, 1.0) for g in range(8)]
    found, levels = communities.communities(graph(spark, edges))
    label = {r.id: r.community for r in found.collect()}
    best = plain_modularity(edges, plain_communities(edges))
    assert plain_modularity(edges, label) >= best - 1e-9
    assert levels == sorted(levels) and levels[-1] == pytest.approx(plain_modularity(edges, label))
    assert communities.modularity(graph(spark, edges), found) == pytest.approx(levels[-1])
    for c in set(label.values()):
        assert connected({v for v in label if label[v] == c}, edges)


def test_communities_of_odd_graphs(spark):
    assert communities.communities(graph(spark, []))[0].count() == 0
    two = communities.communities(graph(spark, [(1, 2, 1.0), (1, 2, 1.0), (7, 7, 3.0)]))[0].collect()
    assert {r.id for r in two} == {1, 2} and len({r.community for r in two}) == 1


def test_moves_that_share_no_community_add_up(spark, monkeypatch):
    """When every round of many moves is refused, the careful ones lead to the same quality."""
    edges, _ = blobs((8, 8, 8), 0.7, 0.02, 9)
    real = communities._turn
    monkeypatch.setattr(communities, "_turn", lambda salt, by="id": communities.F.lit(True) if by == "id" else real(salt, by))
    found, levels = communities.communities(graph(spark, edges))
    label = {r.id: r.community for r in found.collect()}
    assert plain_modularity(edges, label) >= plain_modularity(edges, plain_communities(edges)) - 1e-9 and levels == sorted(levels)


@pytest.mark.parametrize("n", [2, 4])
def test_eigenvectors_equal_dense_ones(spark, n):
    edges, of = blobs((16, 14, 12, 10), 0.7, 0.01, 2)
    both = communities.doubled(graph(spark, edges))
    found, values = spectral.eigenvectors(both, n)
    size = len(of)
    a = np.zeros((size, size))
    for i, j, w in edges:
        a[i, j] += w
        a[j, i] += w
    degree = a.sum(axis=1)
    exact, v = np.linalg.eigh(a / np.sqrt(np.outer(degree, degree)))
    assert values == pytest.approx(exact[::-1][:n], abs=1e-8)
    got = np.array([r.v for r in sorted(found.collect())])
    assert np.abs(np.abs((got * v[:, ::-1][:, :n]).sum(axis=0)) - 1).max() < 1e-8
    dense = np.array([r.v for r in sorted(spectral._dense(both, n).collect())])
    assert np.abs(got - dense).max() < 1e-6


@pytest.mark.parametrize("at_once", [2000, 1])
def test_parts_are_the_blobs(spark, monkeypatch, at_once):
    monkeypatch.setattr(spectral, "AT_ONCE", at_once)
    edges, of = blobs((16, 14, 12), 0.7, 0.01, 5)
    label = {r.id: r.label for r in spectral.spectral_parts(graph(spark, edges), 3).collect()}
    assert len(label) == len(of) and len({(label[v], of[v]) for v in label}) == 3 == len(set(label.values()))


def test_division_numbers_parts_by_size(spark):
    edges, of = blobs((14, 30, 20), 0.6, 0.005, 6)
    part = {r.id: r.part for r in division.divide_graph(graph(spark, edges), 3).collect()}
    assert [part[v] for v in range(64)] == [{0: 2, 1: 0, 2: 1}[g] for g in of]
    few = {r.id: r.part for r in division.divide_graph(graph(spark, [(1, 2, 1.0)]), 4).collect()}
    assert few == {1: 0, 2: 0}


def test_forest_equals_kruskal(spark):
    """Edges, and signs as products along the tree, on graphs of several parts with many equal weights."""
    rnd = random.Random(1)
    edges = {(a, b): (rnd.randint(0, 3), rnd.choice((1, -1))) for a, b in (sorted(rnd.sample(range(60), 2)) for _ in range(110)) if a // 20 == b // 20}
    df = spark.createDataFrame([(b, a, float(w), s) for (a, b), (w, s) in edges.items()] + [(5, 5, 0.0, 1)], "src long, dst long, weight double, sign int")
    root = {v: v for e in edges for v in e}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    kept = set()
    for a, b in sorted(edges, key=lambda e: (edges[e][0], e)):
        if top(a) != top(b):
            root[top(a)] = top(b)
            kept.add((a, b))
    state, tree = forest.minimum_forest(df)
    assert {(r.src, r.dst) for r in tree.collect()} == kept
    got = {r.id: (r.root, r.sign) for r in state.collect()}
    assert got.keys() == root.keys() and all(got[r][0] == r and got[r][1] == 1 for r, _ in got.values())
    assert all((got[a][0] == got[b][0]) == (top(a) == top(b)) for a in root for b in root)
    assert all(got[a][1] * got[b][1] == edges[a, b][1] for a, b in kept)
    none = forest.minimum_forest(df.limit(0))
    assert none[0].count() == 0 and none[1].count() == 0


def rows_of(p, label=None):
    return [(1 if label is None else int(label[k]), k, *map(float, q)) for k, q in enumerate(p)]


@pytest.mark.parametrize("kind", ["sphere", "sheets"])
def test_normals_are_those_of_one_task(spark, kind):
    rng = np.random.default_rng(0)
    if kind == "sphere":
        p = rng.normal(size=(250, 3))
        p = 10 * p / np.linalg.norm(p, axis=1)[:, None]
        label, ref, r = np.ones(len(p)), (0.0, 0.0, 0.0), 4.0
    else:
        z, x = (a.ravel() for a in np.mgrid[0:8, 0:15])
        sheet = np.stack([z, 0.3 * np.sin(x / 3.0), x], axis=1)
        p, label, ref, r = np.concatenate((sheet, sheet + (0, 9, 0))), np.repeat([1, 2], len(sheet)), (0.0, -50.0, 0.0), 3.0
    df = spark.createDataFrame(rows_of(p, label), "label int, idx int, z double, y double, x double")
    got = {(q.label, q.idx): np.array([q.nz, q.ny, q.nx]) for q in forest.oriented_normals(df, r, ref).collect()}
    for at in np.unique(label):
        own = np.flatnonzero(label == at)
        whole = mesh.point_normals(p[own], r, np.array(ref))
        for k, n in zip(own, whole, strict=True):
            assert np.abs(got[int(at), k] - n).max() < 1e-6
    if kind == "sphere":
        assert all(n @ p[k] > 0 for (_, k), n in got.items())


def test_normals_of_few_points(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 90.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0)], "label int, idx int, z double, y double, x double")
    assert all((r.nz, r.ny, r.nx) == (0, 0, 1) for r in forest.oriented_normals(df, 2.0).collect())
    away = forest.oriented_normals(df, 2.0, (0.0, 0.0, 5.0)).collect()
    assert len(away) == 3 and all((r.nz, r.ny, r.nx) == (0, 0, -1) for r in away)
    assert forest.oriented_normals(df.limit(0), 2.0).count() == 0


def dijkstra(near, start):
    """The least (length, edges, vertex before) of every vertex reached."""
    best, todo = {}, [(0.0, 0, -1, start)]
    while todo:
        d, h, before, v = heapq.heappop(todo)
        if v not in best:
            best[v] = (d, h, before)
            for u, w in near[v]:
                if u not in best:
                    heapq.heappush(todo, (d + w, h + 1, v, u))
    return best


@pytest.mark.parametrize("seed", [0, 1])
def test_shortest_paths_equal_dijkstra(spark, seed):
    """With weights of 0 and many ties."""
    rnd = random.Random(seed)
    edges = [(a, b, rnd.choice((0.0, 1.0, 1.0, 2.5))) for a, b in {tuple(sorted(rnd.sample(range(k * 100, k * 100 + 25), 2))) for k in range(3) for _ in range(45)}]
    near = defaultdict(list)
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    starts = [min(v for v in near if v // 100 == k) for k in range(3)]
    exact = {v: t for s in starts for v, t in dijkstra(near, s).items()}
    ways = shortest.least_lengths(graph(spark, edges), spark.createDataFrame([(s,) for s in starts], "id long"))
    got = {r.id: (r.length, r.hops, -1 if r.before is None else r.before) for r in ways.collect()}
    assert got == exact
    ends = [max(v for v in exact if v // 100 == k) for k in range(3)]
    on = set()
    for v in ends:
        while v >= 0:
            on.add(v)
            v = exact[v][2]
    assert {r.id for r in shortest.paths(ways, spark.createDataFrame([(v,) for v in ends], "id long")).collect()} == on


def test_paths_of_single_points(spark):
    """A point without neighbours is its own path, and one that isn't gapped is none."""
    p = spark.createDataFrame([(1, 0, 0, 0, 0.1), (2, 0, 9, 9, 0.2), (3, 1, 0, 0, 0.3), (4, 1, 0, 1, 0.3)], "idx int, z int, y int, x int, orient double")
    assert {r.idx for r in paths.simplify_by_path(p).collect()} == {1, 2, 3, 4}
    assert {r.idx for r in paths.bridge_gaps(p, p.where("idx in (2, 3, 4)"), 1.5).collect()} == {2, 3, 4}
    assert paths.simplify_by_path(p.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 12, 60])
def test_nearest_place_equals_all_pairs(spark, n):
    rng = np.random.default_rng(n)
    shape = (13, 17)
    rows = [(s, k, int(rng.integers(13)), int(rng.integers(17))) for s in range(2) for k in rng.permutation(n).tolist()]
    df = spark.createDataFrame(rows + [(0, 999, rows[0][2], rows[0][3])], "z int, idx int, y int, x int")
    got = {(r.z, r.y, r.x): (r.d2, r.idx) for r in nearest_place.nearest_place(df, shape).collect()}
    assert got == {(s, y, x): min(((y - b) ** 2 + (x - c) ** 2, k) for t, k, b, c in rows if t == s) for s in range(2) for y in range(13) for x in range(17)}


def test_iso_line_of_a_disk(spark):
    """Of a cone's height: one closed line at the level's radius, counter-clockwise or clockwise all the way, in order."""
    n, radius = 24, 7.3
    y, x = np.mgrid[0:n, 0:n]
    v = 20 - np.hypot(y - 11.4, x - 11.7)
    df = spark.createDataFrame([(0, int(a), int(b), float(v[a, b])) for a, b in np.ndindex(n, n)], "z int, y int, x int, v double")
    line = sorted(isolines.iso_lines(df, 20 - radius).collect(), key=lambda r: r.place)
    assert all(r.closed and r.n == len(line) for r in line) and [r.place for r in line] == list(range(len(line)))
    p = np.array([(r.y, r.x) for r in line]) - (11.4, 11.7)
    assert np.abs(np.hypot(*p.T) - radius).max() < 0.03
    turn = np.angle(np.exp(1j * np.diff(np.unwrap(np.arctan2(p[:, 0], p[:, 1])))))
    assert abs(turn.sum()) > 2 * np.pi * 0.9 and (np.sign(turn) == np.sign(turn[0])).all() and np.hypot(*np.diff(p, axis=0).T).max() < 1.5


def test_open_iso_lines_and_saddles(spark):
    df = spark.createDataFrame([(0, y, x, float(x)) for y in range(5) for x in range(4)], "z int, y int, x int, v double")
    line = isolines.iso_lines(df, 1.25).orderBy("place").collect()
    assert [r.x for r in line] == [1.25] * 5 and not any(r.closed for r in line)
    assert [r.y for r in line] in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0])
    for middle, whole in ((3.0, True), (-3.0, False)):  # two high corners, joined or apart
        corners = [[4.0, -1.0], [-1.0, 4.0]] if whole else [[1.0, -4.0], [-4.0, 1.0]]
        saddle = spark.createDataFrame([(0, y, x, corners[y][x]) for y in range(2) for x in range(2)], "z int, y int, x int, v double")
        s = isolines.segments(saddle, 0.0).collect()
        near = [min(np.hypot((r.ay + r.by_) / 2 - y, (r.ax + r.bx) / 2 - x) for y, x in (((0, 1), (1, 0)) if whole else ((0, 0), (1, 1)))) for r in s]
        assert len(s) == 2 and max(near) < 0.5
    assert isolines.iso_lines(df, 99.0).count() == 0
