"""Lloyd's rounds on two trees, in exact integers.

The vectors lie in written blocks, each with a cover tree: a node has a centre (one of its vectors) and a radius, its
children cover it with half the radius and stand apart from each other by more than that. A round puts the centroids
into such a tree too and walks both: a pair of nodes goes when even its nearest vectors and centroids lie further apart
than the best centre seen is from all of the node. A node left with one centroid is assigned as a whole, by its count
and the sum of its vectors; the vectors of leaves are compared exactly with the centroids left. Tasks give sums by
cluster, which Spark adds; k centroids, and nothing else, pass the driver.

Defined results: a vector is kept if it has exactly ``dim`` components, none null or non-finite, and each scaled
component has a magnitude under 2 ** 27, so that squared distances fit a long (over 131,072 before scaling, a vector is
left out). Rows with equal ids are vectors of their own; starts with equal hashes are ordered by their components; a null id
starts no centroid. With fewer than k vectors to start from there are as many centroids, with none no rows. Sums
that pass a long are null. Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.storage import cut, dropped

#: Vectors of a block, vectors of a leaf, and the bound of scaled components.
BLOCK, LEAF, BOUND = 1024, 8, 1 << 27
_LONG = 1 << 63


class Tree(NamedTuple):
    """Vectors in the tree's order, and its nodes: ranges of vectors, centres, radii, first child, number of children."""

    points: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    children: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return (d * d).sum(axis=-1)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """A tree over int64 rows, and the order in which it has them."""
    n = len(points)
    x = points.astype(np.float64)
    square = (x * x).sum(axis=1)
    gaps = np.sqrt(np.maximum(square[:, None] + square - 2 * (x @ x.T), 0))
    order = np.arange(n)
    nodes = [[0, n, 0, 0.0, 0, 0]]
    at = 0
    while at < len(nodes):
        start, stop, centre = nodes[at][:3]
        own = order[start:stop]
        # Rounded up: a radius is a bound.
        radius = float(np.sqrt(squared(points[own], points[centre]).max())) * (1 + 1e-12)
        nodes[at][3] = radius
        if stop - start > leaf and radius > 0:
            nodes[at][4] = len(nodes)
            rest, here, child = own, start, centre
            while len(rest):
                near = gaps[child, rest] <= radius / 2
                near |= rest == child
                group, rest = rest[near], rest[~near]
                order[here : here + len(group)] = group
                nodes.append([here, here + len(group), child, 0.0, 0, 0])
                here += len(group)
                child = rest[0] if len(rest) else child
            nodes[at][5] = len(nodes) - nodes[at][4]
            if nodes[at][5] == 1:  # rounding of the gaps alone can bring this about: leave the node whole
                nodes.pop()
                nodes[at][4:] = 0, 0
        at += 1
    start, stop, centre, radius, first, children = (np.array(c) for c in zip(*nodes, strict=True))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return Tree(points[order], start, stop, place[centre], radius, first, children), order


def _fan(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each of the runs of length n."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + n, n)


def assigned(tree: Tree, centroids: Tree, names: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Whole nodes with their centroid, as (nodes, centroids), and the centroid of every vector.

    ``names`` has the centroids' numbers in their tree's order; of equally near ones the smallest number counts.
    """
    owner = np.full(len(tree.points), -1)
    whole: list[tuple[np.ndarray, np.ndarray]] = []
    upper = np.full(len(tree.start), np.inf)
    v, c = np.zeros(1, int), np.zeros(1, int)
    centres = centroids.points[centroids.centre]
    while len(v):
        d = np.sqrt(squared(tree.points[tree.centre[v]], centres[c]).astype(np.float64))
        np.minimum.at(upper, v, d + tree.radius[v])
        keep = (d - tree.radius[v] - centroids.radius[c]) * (1 - 1e-12) <= upper[v] * (1 + 1e-12)
        v, c = v[keep], c[keep]
        # Centroids' nodes are opened first; those of one centroid stand for it.
        inner = centroids.children[c] > 0
        open_v, open_c = np.repeat(v[inner], centroids.children[c[inner]]), _fan(centroids.first[c[inner]], centroids.children[c[inner]])
        waits = np.isin(v, v[inner])
        done = ~waits & ~inner
        held_v, held_c = v[waits & ~inner], c[waits & ~inner]
        dv, dc = v[done], c[done]
        # A closed node of several centroids (a leaf) stands for all of them.
        several = centroids.stop[dc] - centroids.start[dc]
        dv, dc = np.repeat(dv, several), _fan(centroids.start[dc], several)
        nodes, number = np.unique(dv, return_counts=True)
        single = np.isin(dv, nodes[number == 1])
        if single.any():
            whole.append((dv[single], names[dc[single]]))
            owner[_fan(tree.start[dv[single]], (tree.stop - tree.start)[dv[single]])] = np.repeat(names[dc[single]], (tree.stop - tree.start)[dv[single]])
        dv, dc = dv[~single], dc[~single]
        leaf = tree.children[dv] == 0
        if leaf.any():
            lv, lc = dv[leaf], dc[leaf]
            size = (tree.stop - tree.start)[lv]
            p, k = _fan(tree.start[lv], size), np.repeat(lc, size)
            best = np.lexsort((names[k], squared(tree.points[p], centroids.points[k]), p))
            firsts = best[np.concatenate(([True], p[best][1:] != p[best][:-1]))]
            owner[p[firsts]] = names[k[firsts]]
        lv, lc = dv[~leaf], dc[~leaf]
        kids = tree.children[lv]
        child = _fan(tree.first[lv], kids)
        upper[child] = np.repeat(upper[lv], kids)
        # Centroids go on as nodes again: the node of one centroid, made beside the tree.
        v, c = np.concatenate((open_v, held_v, child)), np.concatenate((open_c, held_c, np.repeat(lc, kids) + len(centroids.start) - len(names)))
    return whole, owner


def centroid_tree(centroids: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The centroids' tree, followed by a node for each single centroid, and the centroids' numbers in its order."""
    tree, order = cover_tree(centroids, 1)
    k = np.arange(len(order))
    ends = np.zeros(len(order), int)
    more = (k, k + 1, k, ends.astype(float), ends, ends)
    return Tree(tree.points, *(np.concatenate(pair) for pair in zip(tree[1:], more, strict=True))), order


def scaled(vectors: DataFrame, dim: int, by: int, id: str, vector: str) -> DataFrame:
    """``id, point``: the vectors kept, as whole numbers."""
    x = F.col(vector)
    fit = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double") * by) < BOUND))
    return vectors.where((F.size(x) == dim) & F.coalesce(fit, F.lit(False))).select(F.col(id).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * by).cast("int")).alias("point"))


_BLOCK = "ids array<long>, points binary, start binary, stop binary, centre binary, radius binary, first binary, children binary"


def blocks_of(points: DataFrame, dim: int) -> DataFrame:
    """Blocks of vectors with their trees."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def made(n: int) -> pa.RecordBatch:
            nonlocal waiting
            table = pa.Table.from_batches(waiting)
            waiting = table.slice(n).to_batches()
            table = table.slice(0, n)
            values = table.column(1).combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, dim)
            tree, order = cover_tree(values)
            ids = table.column(0).combine_chunks().take(pa.array(order))
            cells = [tree.points.astype("<i4"), *(a.astype("<f8" if k == 3 else "<i4") for k, a in enumerate(tree[1:]))]
            return pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), *(pa.array([a.tobytes()], pa.binary()) for a in cells)], names=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            while sum(b.num_rows for b in waiting) >= BLOCK:
                yield made(BLOCK)
        if waiting:
            yield made(BLOCK)

    return points.select("id", "point").mapInArrow(work, _BLOCK)


def _trees(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[list, Tree]]:
    for row in batch.to_pylist():
        whole = lambda c: np.frombuffer(row[c], "<i4").astype(np.int64)  # noqa: B023, E731
        yield row["ids"], Tree(whole("points").reshape(-1, dim), whole("start"), whole("stop"), whole("centre"), np.frombuffer(row["radius"], "<f8"), whole("first"), whole("children"))


def block_sums(tree: Tree, centroids: Tree, names: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
    """Adds a block's vectors to their clusters' counts and sums: whole nodes by their sums, the others one by one."""
    whole, owner = assigned(tree, centroids, names)
    running = np.concatenate((np.zeros((1, tree.points.shape[1]), np.int64), np.cumsum(tree.points, axis=0)))
    for nodes, owners in whole:
        np.add.at(counts, owners, (tree.stop - tree.start)[nodes])
        np.add.at(sums, owners, running[tree.stop[nodes]] - running[tree.start[nodes]])
        owner[_fan(tree.start[nodes], (tree.stop - tree.start)[nodes])] = -1
    single = owner >= 0
    np.add.at(counts, owner[single], 1)
    np.add.at(sums, owner[single], tree.points[single])


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of their vectors' means, empty ones as before."""
    k, dim = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, names = centroid_tree(centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for _, block in _trees(batch, dim):
                block_sums(block, tree, names, counts, sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(counts), pa.array(list(sums), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = blocks.mapInArrow(work, "cluster int, n long, sums array<long>").where("n > 0")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    out = centroids.copy()
    for r in parts.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(total("n").alias("n"), total("s").alias("s")).collect():
        out[r["cluster"], r["at"]] = int(r["s"]) // int(r["n"])
    return out


def distances(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance``: the nearest centroid of every vector and the squared distance to it."""
    dim = centroids.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, names = centroid_tree(centroids)
        for batch in batches:
            for ids, block in _trees(batch, dim):
                owner = assigned(block, tree, names)[1]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(owner, pa.int32()), pa.array(squared(block.points, centroids[owner]))], names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(work, "vec_id long, cluster int, distance long")


def _fits(total: int) -> int | None:
    return total if total < _LONG else None


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector kept."""
    spark = vectors.sparkSession
    points = scaled(vectors, dim, scale, id, vector)
    name: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = points.where("id is not null").orderBy(name, "point").limit(k).select("point").collect()
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, " + schema.partition(", ")[2])
    centroids = np.array([r["point"] for r in starts], np.int64)
    blocks = cut(blocks_of(points, dim))
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    found = cut(distances(blocks, centroids))
    dropped(blocks)
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(inertia.values())
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    clusters = spark.createDataFrame([(n, _fits(s), _fits(total), digest(centroids[n].tolist())) for n, s in sorted(inertia.items())], schema)
    # A row for each of the k clusters at most.
    return found.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024) -> str:
    """DuckDB's SQL for :func:`cluster_vectors`: every vector against every centroid, round by round."""
    near = "(select r, k, d from (select p.r, c.k, sum((p.x - c.x) * (p.x - c.x)) d from p join {c} c on p.pos = c.pos group by 1, 2) qualify row_number() over (partition by r order by d, k) = 1)"
    steps = []
    for n in range(rounds):
        steps.append(f"a{n} as materialized {near.format(c=f'c{n}')}")
        steps.append(f"""m{n} as materialized (select a.k, p.pos, sum(p.x) s, count(*) n from a{n} a join p on p.r = a.r group by 1, 2),
c{n + 1} as materialized (select k, pos, ((s - ((s % n) + n) % n) // n)::bigint x from m{n} union all select k, pos, x from c{n} where k not in (select k from m{n}))""")
    return f"""
with e as materialized (select row_number() over () r, vec_id, embedding from embeddings where len(embedding) = {dim}),
w as (select r, vec_id, unnest(generate_series(1, {dim})) pos, unnest(embedding)::double x from e),
p as materialized (select r, vec_id, pos, floor({scale} * x)::bigint x from w where r not in (select r from w where x is null or not isfinite(x))),
first as (select r, (row_number() over (order by sha256('{seed}:' || vec_id)) - 1)::int k from (select distinct r, vec_id from p) qualify k < {k}),
c0 as materialized (select first.k, p.pos, p.x from first join p on p.r = first.r),
{",".join(steps)},
a as materialized {near.format(c=f"c{rounds}")},
i as (select k, sum(d) s from a group by k),
h as (select k, sha256(string_agg(x::varchar, ',' order by pos)) h from c{rounds} group by k)
select e.vec_id, a.k cluster, a.d::bigint distance, i.s::bigint cluster_inertia, (select sum(s) from i)::bigint inertia, h.h centroid_sha256
from a join e on e.r = a.r join i on i.k = a.k join h on h.k = a.k
"""


ORACLE_SQL = oracle()
