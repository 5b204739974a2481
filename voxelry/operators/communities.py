"""Communities of a weighted graph by modularity, in rounds over tables: local moves, refinement, contraction.

A level moves vertices to the neighbouring community of most gain until none gains; splits each community into connected
parts, grown from single vertices that are well connected in it (the refinement); and makes each part a vertex of the next
level, which begins with the communities found. Levels end when no part has more than one vertex.

Modularity never falls. A round moves about half of the vertices that gain, all at once; where that costs modularity, the
round is done again with moves that touch no community in common, whose gains simply add up.

A graph of more than ``AT_ONCE`` edges, counted first, is made smaller before that, one job a level: about half of its
vertices join the one beside them of most gain, and what grew together is a vertex of the next level. The levels of a graph
of at most so many edges are left to one task, which does the same rounds on arrays. Vertices may also come in groups that stay
together, as sums of weights (:func:`communities_of_groups`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelry.storage import cut, dropped

#: Gains in modularity up to which a move is none.
LEAST = 1e-12
#: Edges, each counted both ways, up to which one task does all levels; share of vertices that a level must join to others to be worth it.
AT_ONCE, WORTH = 2_000_000, 0.02
#: Turns of a vertex that differ; then they begin again.
TURNS = 60


def single(edges: DataFrame) -> DataFrame:
    """Each edge once, from its lesser vertex, without loops; parallel edges add up."""
    ends = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    return edges.where("src <> dst").groupBy(*ends).agg(F.sum(F.col("weight").cast("double")).alias("weight"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each edge of :func:`single` both ways."""
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), "weight")
    return pairs.select(F.inline(F.array(way("src", "dst"), way("dst", "src"))))


def doubled(edges: DataFrame) -> DataFrame:
    """Each edge both ways, without loops; parallel edges add up."""
    return both_ways(single(edges))


def _turn(salt: int, by: str = "id") -> Column:
    return F.pmod(F.xxhash64(by, F.lit(salt % TURNS)), F.lit(2)) == 0


def _best_moves(both: DataFrame, state: DataFrame, m2: float) -> DataFrame:
    """``id, degree, loop, community, own`` (weight to the rest of its community) and ``target, gain``, its best move."""
    totals = state.groupBy("community").agg(F.sum("degree").alias("total"))
    near = both.join(state.select(F.col("id").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
    seen = near.join(totals, "community").select(F.col("src").alias("id"), F.struct("community", "w", "total").alias("c")).groupBy("id").agg(F.collect_list("c").alias("near"))
    # One row for each vertex and community beside it: as many as it has edges, at most.
    mine = state.join(totals, "community").join(seen, "id", "left")
    own = F.coalesce(F.aggregate(F.filter("near", lambda c: c["community"] == F.col("community")), F.lit(0.0), lambda a, c: a + c["w"]), F.lit(0.0))
    mine = mine.withColumn("own", own)
    gain = lambda c: 2 * (c["w"] - F.col("own")) / m2 - 2 * F.col("degree") * (c["total"] - F.col("total") + F.col("degree")) / (m2 * m2)
    options = F.transform(F.filter("near", lambda c: c["community"] != F.col("community")), lambda c: F.struct(gain(c).alias("gain"), (-c["community"]).alias("c")))
    best = F.array_max(options)
    return mine.select("id", "degree", "loop", "community", "own", (-best["c"]).alias("target"), F.coalesce(best["gain"], F.lit(0.0)).alias("gain"))


def _modularity(moves: DataFrame, m2: float) -> tuple[float, int]:
    """Modularity of the communities, and how many vertices would gain by a move."""
    by = moves.groupBy("community").agg(F.sum(F.col("own") + F.col("loop")).alias("inside"), F.sum("degree").alias("total"), F.count_if(F.col("gain") > LEAST).alias("n"))
    r = by.agg(F.sum(F.col("inside") / m2 - (F.col("total") / m2) ** 2), F.sum("n")).first()
    return float(r[0] or 0.0), int(r[1] or 0)


def _apart(moves: DataFrame) -> DataFrame:
    """Of the moves that gain, those that are the best one of both communities they touch, as ``id, target``."""
    gains = moves.where(F.col("gain") > LEAST)
    rank = F.struct("gain", F.xxhash64("id").alias("h"), "id")
    best = gains.select(F.explode(F.array("community", "target")).alias("c"), rank.alias("r")).groupBy("c").agg(F.max("r").alias("r"))
    return best.groupBy(F.col("r.id").alias("id")).count().where("count = 2").join(gains, "id").select("id", "target")


def _moved(both: DataFrame, state: DataFrame, m2: float) -> tuple[DataFrame, float]:
    """Local moves until no vertex gains: ``id, degree, loop, community`` and its modularity."""
    moves = cut(_best_moves(both, state, m2))
    quality, left = _modularity(moves, m2)
    k = 0
    while left:
        k += 1
        turn = (F.col("gain") > LEAST) & _turn(k)
        after = moves.select("id", "degree", "loop", F.when(turn, F.col("target")).otherwise(F.col("community")).alias("community"))
        new = cut(_best_moves(both, after, m2))
        found, n = _modularity(new, m2)
        if found < quality:
            dropped(new)
            chosen = _apart(moves).withColumnRenamed("target", "chosen")
            after = moves.join(chosen, "id", "left").select("id", "degree", "loop", F.coalesce("chosen", "community").alias("community"))
            new = cut(_best_moves(both, after, m2))
            found, n = _modularity(new, m2)
        dropped(moves)
        moves, quality, left = new, found, n
    return moves.select("id", "degree", "loop", "community"), quality


def _refined(both: DataFrame, state: DataFrame, m2: float) -> DataFrame:
    """``id, degree, loop, community, part``: connected parts of the communities; a part is named by its first vertex.

    Vertices that are still alone take turns to join the part beside them of most gain that doesn't move in the same round,
    if they and the part are well connected within the community.
    """
    side = lambda x: state.select(F.col("id").alias(x), F.col("community").alias(f"c_{x}"))
    inside = cut(both.join(side("src"), "src").join(side("dst"), "dst").where("c_src = c_dst").select("src", "dst", "weight"))
    totals = state.groupBy("community").agg(F.sum("degree").alias("whole"))
    to_rest = inside.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("rest"))
    now = cut(state.join(totals, "community").join(to_rest, "id", "left").select("id", "degree", "loop", "community", "whole", F.coalesce("rest", F.lit(0.0)).alias("rest"), F.col("id").alias("part")))
    still, k = 0, 0
    while still < 2:
        k += 1
        # A part's degree, size, and weight to the rest of its community.
        crossing = inside.join(now.select(F.col("id").alias("src"), F.col("part").alias("p")), "src").join(now.select(F.col("id").alias("dst"), F.col("part").alias("q")), "dst")
        outward = crossing.where("p <> q").groupBy(F.col("p").alias("part")).agg(F.sum("weight").alias("outward"))
        parts = now.groupBy("part").agg(F.sum("degree").alias("total"), F.count("*").alias("n"), F.first("whole").alias("whole")).join(outward, "part", "left")
        alone = F.col("n") == 1
        mover = alone & _turn(k, "part")
        well = F.coalesce("outward", F.lit(0.0)) >= F.col("total") * (F.col("whole") - F.col("total")) / m2
        parts = parts.select("part", "total", (well & ~mover).alias("open"), (well & mover).alias("moves"))
        movers = now.join(parts.where("moves"), "part").select("id", "degree")
        near = crossing.groupBy(F.col("src").alias("id"), F.col("q").alias("part")).agg(F.sum("weight").alias("w"))
        gain = 2 * F.col("w") / m2 - 2 * F.col("degree") * F.col("total") / (m2 * m2)
        joins = near.join(parts.where("open"), "part").join(movers, "id").withColumn("gain", gain).where(F.col("gain") > LEAST)
        best = joins.groupBy("id").agg(F.max(F.struct("gain", (-F.col("part")).alias("p"))).alias("b")).select("id", (-F.col("b.p")).alias("joined"))
        new = cut(now.join(best, "id", "left").select("id", "degree", "loop", "community", "whole", "rest", F.coalesce("joined", "part").alias("part"), F.col("joined").isNotNull().alias("moved")))
        still = still + 1 if new.where("moved").isEmpty() else 0
        dropped(now)
        now = new.drop("moved")
    dropped(inside)
    return now.select("id", "degree", "loop", "community", "part")


def _sums(at: np.ndarray, label: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights by vertex and label beside it, both ascending; each is summed in the order of the rows."""
    key, size = at * n + label, max(len(at), 1)
    if n * n * size < 1 << 63:
        # Whole numbers sort faster than their places do.
        key, order = np.divmod(np.sort(key * size + np.arange(len(key))), size)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] // n, key[first] % n, np.add.reduceat(weight[order], first) if len(first) else weight[:0]


def _first_best(v: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Of the rows of each ``v`` (ascending) the first one of greatest gain."""
    first = np.flatnonzero(np.diff(v, prepend=-1))
    if not len(first):
        return first
    most = np.repeat(np.maximum.reduceat(gain, first), np.diff(first, append=len(v)))
    top = np.flatnonzero(gain == most)
    return top[np.flatnonzero(np.diff(v[top], prepend=-1))]


def _ranges(start: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places from ``start[k]`` to ``start[k + 1]`` of each k of ``at``."""
    n = start[at + 1] - start[at]
    return np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())


class _Level:
    """A level's graph as arrays, with the rounds of :func:`_moved` and :func:`_refined`."""

    def __init__(self, src, dst, weight, degree, loop, community, m2: float, move, join, rank):
        self.src, self.dst, self.weight, self.degree, self.loop, self.community, self.m2 = src, dst, weight, degree, loop, community, m2
        # Turns as bits of a number for each vertex; the order of vertices by hash.
        self.move, self.join, self.rank, self.n = move, join, rank, len(degree)
        # A vertex's edges begin here; the communities last seen, and the weights of vertices to those beside them.
        self.start = np.searchsorted(src, np.arange(self.n + 1))
        self.seen, self.near = None, None

    def beside(self, community: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights by vertex and community beside it; only those beside a vertex that has moved are summed again."""
        if self.seen is None:
            self.near = _sums(self.src, community[self.dst], self.weight, self.n)
        elif len(moved := np.flatnonzero(community != self.seen)):
            again = np.zeros(self.n, bool)
            again[self.dst[_ranges(self.start, moved)]] = True
            use = _ranges(self.start, np.flatnonzero(again))
            keep = np.flatnonzero(~again[self.near[0]])
            both = [np.concatenate([x[keep], y]) for x, y in zip(self.near, _sums(self.src[use], community[self.dst[use]], self.weight[use], self.n), strict=True)]
            order = np.argsort(both[0], kind="stable")
            self.near = tuple(x[order] for x in both)
        self.seen = community
        return self.near

    def best(self, community: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Each vertex's best community and its gain there, if it gains, and the modularity."""
        total = np.bincount(community, self.degree, self.n)
        v, c, w = self.beside(community)
        count = np.bincount(v, minlength=self.n)
        each = lambda x: np.repeat(x, count)
        at_home = np.flatnonzero(c == each(community))
        own = np.zeros(self.n)
        own[v[at_home]] = w[at_home]
        degree = each(self.degree)
        found = 2 * (w - each(own)) / self.m2 - 2 * degree * (total[c] - each(total[community]) + degree) / (self.m2 * self.m2)
        found[at_home] = 0.0
        use = np.flatnonzero(found > LEAST)
        top = use[_first_best(v[use], found[use])]
        target, gain = community.copy(), np.zeros(self.n)
        target[v[top]], gain[v[top]] = c[top], found[top]
        inside = np.bincount(community, own + self.loop, self.n)
        return target, gain, float((inside / self.m2 - (total / self.m2) ** 2).sum())

    def apart(self, community: np.ndarray, target: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Vertices whose move is the best one of both communities it touches."""
        v = np.flatnonzero(gain > LEAST)
        v = v[np.lexsort((self.rank[v], gain[v]))]
        best = np.full(self.n, -1)
        place = np.arange(len(v))
        for c in (community[v], target[v]):
            np.maximum.at(best, c, place)
        return v[(best[community[v]] == place) & (best[target[v]] == place)]

    def moved(self) -> float:
        target, gain, quality = self.best(self.community)
        k = 0
        while (gain > LEAST).any():
            k += 1
            after = np.where((gain > LEAST) & (self.move >> (k % TURNS) & 1 == 1), target, self.community)
            new = self.best(after)
            if new[2] < quality:
                after = self.community.copy()
                chosen = self.apart(self.community, target, gain)
                after[chosen] = target[chosen]
                new = self.best(after)
            self.community = after
            target, gain, quality = new
        return quality

    def refined(self) -> np.ndarray:
        within = self.community[self.src] == self.community[self.dst]
        src, dst, weight = self.src[within], self.dst[within], self.weight[within]
        whole = np.bincount(self.community, self.degree, self.n)[self.community]
        part = np.arange(self.n)
        still = k = 0
        while still < 2:
            k += 1
            p, q = part[src], part[dst]
            outward = np.bincount(p[p != q], weight[p != q], self.n)
            total = np.bincount(part, self.degree, self.n)
            mover = (np.bincount(part, minlength=self.n) == 1) & (self.join >> (k % TURNS) & 1 == 1)
            well = outward >= total * (whole - total) / self.m2
            # A vertex that is alone bears its part's name.
            use = (well & mover)[p] & (well & ~mover)[q]
            v, c, w = _sums(src[use], q[use], weight[use], self.n)
            gain = 2 * w / self.m2 - 2 * self.degree[v] * total[c] / (self.m2 * self.m2)
            v, c, gain = (x[gain > LEAST] for x in (v, c, gain))
            top = _first_best(v, gain)
            part[v[top]] = c[top]
            still = 0 if len(top) else still + 1
        return part

    def contracted(self, part: np.ndarray) -> tuple[_Level, np.ndarray]:
        """The level of the parts, and each vertex's place there."""
        names, of = np.unique(part, return_inverse=True)
        n = len(names)
        v, c, w = _sums(of[self.src], of[self.dst], self.weight, n)
        degree, loop = (np.bincount(of, x, n) for x in (self.degree, self.loop))
        loop[v[v == c]] += w[v == c]
        # A community is named by the least of its parts, as those are the vertices now.
        least = np.full(self.n, n)
        np.minimum.at(least, self.community, of)
        community = least[self.community[names]]
        across = v != c
        return _Level(v[across], c[across], w[across], degree, loop, community, self.m2, self.move[names], self.join[names], self.rank[names]), of


def _at_once(pairs: DataFrame, state: DataFrame, most_levels: int) -> tuple[DataFrame, list[float]]:
    """(``id, community``, the modularity of each level) by one task: for graphs of a checked size only."""
    bits = lambda by: sum((F.shiftleft(_turn(k, by).cast("long"), k) for k in range(TURNS)), F.lit(0).cast("long"))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    vertices = state.withColumn("part", F.col("id")).select("id", F.col("community").alias("other"), F.col("degree").alias("weight"), "loop", bits("id").alias("move"), bits("part").alias("join"), F.xxhash64("id").alias("hash"))
    rows = pairs.select(F.col("src").alias("id"), F.col("dst").alias("other"), "weight", *none("double", "loop"), *none("long", "move", "join", "hash")).unionByName(vertices)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (batches := [*batches]):
            return
        table = pa.Table.from_batches(batches)
        kind = table.schema.field("id").type
        own = np.asarray(table["loop"].is_valid())
        at, other, weight = (table[c].to_numpy() for c in ("id", "other", "weight"))
        rest = table.filter(pa.array(own))
        ids, order = np.unique(at[own], return_index=True)
        if not len(ids):
            return
        degree, loop, move, join, hashed = (rest[c].to_numpy()[order] for c in ("weight", "loop", "move", "join", "hash"))
        community = np.searchsorted(ids, other[own][order])
        rank = np.argsort(np.lexsort((ids, hashed)))
        u, v, w = np.searchsorted(ids, at[~own]), np.searchsorted(ids, other[~own]), weight[~own]
        # Both ways and in order: the sums of a vertex are then the same, however the rows come.
        e = _sums(np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([w, w]), len(ids))
        m2 = float(degree.sum())
        level, member, qualities, found = _Level(*e, degree, loop, community, m2, move, join, rank), np.arange(len(ids)), [], None
        first = member
        for _ in range(most_levels):
            if m2 == 0:
                found = ids
                break
            qualities.append(level.moved())
            part = level.refined()
            if len(np.unique(part)) == level.n:
                found = ids[first[level.community[member]]]
                break
            first = first[np.unique(part)]
            level, of = level.contracted(part)
            member = of[member]
        else:
            raise ValueError("the levels of communities don't end")
        n, m = len(ids), len(qualities)
        pad = lambda x, left, right, t: pa.concat_arrays([pa.nulls(left, t), pa.array(x, t), pa.nulls(right, t)])
        yield pa.RecordBatch.from_arrays([pad(ids, 0, m, kind), pad(found, 0, m, kind), pad(np.arange(m), n, 0, pa.int32()), pad(qualities, n, 0, pa.float64())], names=["id", "community", "level", "quality"])

    kind = state.schema["id"].dataType.simpleString()
    done = cut(rows.repartition(1).mapInArrow(work, f"id {kind}, community {kind}, level int, quality double"))
    return done.where("level is null").select("id", "community"), [r["quality"] for r in done.where("level is not null").orderBy("level").collect()]


def _joined(both: DataFrame, state: DataFrame, m2: float, salt: int) -> DataFrame:
    """``id, part``: about half of the vertices join the one of the others beside them of most gain, where it has room.

    It gives at least half of what the best one of all beside them would give; else they wait. Each gains even after all
    that gain more by the same vertex have joined it, so modularity grows by every one.
    """
    turn = lambda x: _turn(salt, x)
    of = lambda x: state.select(F.col("id").alias(x), F.col("degree").alias(f"d_{x}"))
    seen = both.where(turn("src")).join(of("src"), "src").join(of("dst"), "dst")
    gain = lambda more: 2 * F.col("weight") / m2 - 2 * F.col("d_src") * (F.col("d_dst") + more) / (m2 * m2)
    option = F.struct(gain(F.lit(0.0)).alias("gain"), F.xxhash64("src", "dst").alias("h"), "dst", "d_src", "d_dst", "weight")
    best = seen.groupBy("src").agg(F.max(F.when(~turn("dst"), option)).alias("o"), F.max(gain(F.lit(0.0))).alias("most"))
    wish = cut(best.where("2 * o.gain >= most").select("src", "o.*"))
    before = Window.partitionBy("dst").orderBy(F.desc("gain"), "src").rowsBetween(Window.unboundedPreceding, -1)
    joins = wish.withColumn("before", F.coalesce(F.sum("d_src").over(before), F.lit(0.0))).where(gain(F.col("before")) > LEAST).select(F.col("src").alias("id"), F.col("dst").alias("joined"))
    out = cut(state.join(joins, "id", "left").select("id", F.coalesce("joined", "id").alias("part")))
    dropped(wish)
    return out


def communities(edges: DataFrame, most_levels: int = 50) -> tuple[DataFrame, list[float]]:
    """(``id, community`` of every vertex of ``src, dst, weight``, the modularity after each level's moves)."""
    return communities_of(cut(single(edges)), most_levels)


def communities_of(pairs: DataFrame, most_levels: int = 50) -> tuple[DataFrame, list[float]]:
    """As :func:`communities`, of a written table of :func:`single`."""
    state = both_ways(pairs).groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree")).withColumns({"loop": F.lit(0.0), "community": F.col("id")})
    return _leveled(pairs, state, most_levels)


def communities_of_groups(sums: DataFrame, most_levels: int = 50) -> tuple[DataFrame, list[float]]:
    """As :func:`communities_of`, of vertices that stay together in groups: a written table of the groups' sums of
    weights, each ``src <= dst`` once, where ``src = dst`` has the edges within a group. Modularity is that of the vertices' graph.
    """
    # An edge within a group counts both ways.
    loop = F.when(F.col("src") == F.col("dst"), 2 * F.col("weight")).otherwise(0.0)
    side = lambda c: F.struct(F.col(c).alias("id"), "weight", (loop / 2).alias("loop"))
    ends = sums.select(F.inline(F.array(side("src"), side("dst"))))
    state = ends.groupBy("id").agg(F.sum("weight").alias("degree"), F.sum("loop").alias("loop")).withColumn("community", F.col("id"))
    return _leveled(sums.where("src <> dst").select("src", "dst", "weight"), state, most_levels)


def _leveled(pairs: DataFrame, state: DataFrame, most_levels: int) -> tuple[DataFrame, list[float]]:
    """``id, community`` and the modularity of each level, of a graph's edges and its vertices ``id, degree, loop, community``."""
    if 2 * pairs.count() <= AT_ONCE:
        return _at_once(pairs, state, most_levels)
    state = cut(state)
    n, m2 = state.agg(F.count("*"), F.coalesce(F.sum("degree"), F.lit(0.0))).first()
    member = state.select("id", F.col("id").alias("node"))
    if m2 == 0:
        return member.select("id", F.col("node").alias("community")), []
    qualities: list[float] = []
    growing = True
    for level in range(most_levels):
        if level and 2 * pairs.count() <= AT_ONCE:
            found, rest = _at_once(pairs, state, most_levels)
            return cut(member.join(found.withColumnRenamed("id", "node"), "node").select("id", "community")), qualities + rest
        both = both_ways(pairs)
        if growing:
            refined = cut(state.join(_joined(both, state, m2, level + 1), "id").withColumn("community", F.col("part")))
            parts = refined.where("id = part").count()
            # Where few can join, whole rounds of moves go on.
            growing = n - parts >= WORTH * n
        if not growing:
            state, quality = _moved(both, state, m2)
            qualities.append(quality)
            refined = cut(_refined(both, state, m2))
            parts = refined.select("part").distinct().count()
        named = refined.select(F.col("id").alias("node"), "community", "part")
        if parts == n:
            return cut(member.join(named, "node").select("id", "community")), qualities
        member, n = cut(member.join(named, "node").select("id", F.col("part").alias("node"))), parts
        of = lambda x: refined.select(F.col("id").alias(x), F.col("part").alias(f"p_{x}"))  # noqa: B023, E731
        ends = F.least("p_src", "p_dst").alias("src"), F.greatest("p_src", "p_dst").alias("dst")
        across = cut(pairs.join(of("src"), "src").join(of("dst"), "dst").groupBy(*ends).agg(F.sum("weight").alias("weight")))
        # An edge within a part counts both ways.
        loops = across.where("src = dst").select(F.col("src").alias("part"), (2 * F.col("weight")).alias("more"))
        merged = refined.groupBy("part").agg(F.sum("degree").alias("degree"), F.sum("loop").alias("loop"), F.first("community").alias("old")).join(loops, "part", "left")
        # A community is named by the least of its parts, as those are the vertices now.
        names = merged.groupBy("old").agg(F.min("part").alias("community"))
        state = cut(merged.join(names, "old").select(F.col("part").alias("id"), "degree", (F.col("loop") + F.coalesce("more", F.lit(0.0))).alias("loop"), "community"))
        if level:
            dropped(pairs)
        pairs = across.where("src <> dst")
    raise ValueError("the levels of communities don't end")


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Modularity of ``id, community`` on a graph."""
    both = doubled(edges)
    of = lambda x: labels.select(F.col("id").alias(x), F.col("community").alias(f"c_{x}"))
    e = both.join(of("src"), "src").join(of("dst"), "dst")
    by = e.groupBy(F.col("c_src").alias("c")).agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("weight")).otherwise(0.0)).alias("inside"))
    m2 = float(by.agg(F.sum("total")).first()[0] or 0.0)
    return float(by.agg(F.sum(F.col("inside") / m2 - (F.col("total") / m2) ** 2)).first()[0]) if m2 else 0.0
