"""Robust surfaces through noisy clouds, by an evolution with two objectives.

The cloud of one component, in order along a guide, is divided into a grid; an individual picks a point of each cell,
and a spline surface through the picks is judged by the cloud it leaves uncovered and by its own excess over the cloud.
Generations alternate crossover and mutation and keep the best by non-dominated rank and crowding. A component is one
group of rows and evolves within one task; many components and volumes evolve beside each other. An evolution's state
is one text (JSON) that holds the grid, the cloud, the population and the log of fronts; it can be stored, looked into
and gone on with.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.functions.splines import Surface, wire_length


def _order(points: np.ndarray, guide: np.ndarray) -> np.ndarray:
    """Points by z, nearest guide point of the slice, and distance to it."""
    out = []
    for z in np.unique(points[:, 0]):
        own = points[points[:, 0] == z]
        line = guide[guide[:, 0] == z]
        line = line if len(line) else guide[np.abs(guide[:, 0] - z) == np.abs(guide[:, 0] - z).min()]
        d = ((own[:, None, 1:] - line[None, :, 1:]) ** 2).sum(axis=2)
        k = d.argmin(axis=1)
        out.append(own[np.lexsort((d[np.arange(len(own)), k], k))])
    return np.concatenate(out)


def cells(points: np.ndarray, guide: np.ndarray, lengths: tuple[float, float], shrink: float = 0.25, least: int = 3) -> list[list[np.ndarray]]:
    """The grid's cells of points: rows by z, columns along the guide; the side columns are narrower."""
    p = _order(points, guide)
    zs = np.unique(p[:, 0])
    along = np.mean([wire_length(guide[guide[:, 0] == z][::2, 1:]) for z in np.unique(guide[:, 0])])
    n_u = max(least, round(np.ptp(zs) / lengths[0]) + 1)
    n_v = max(least, round(along / lengths[1] + 2 * (1 - shrink)) + 1)
    n_u = min(n_u, len(zs))
    n_v = min(n_v, min(int((p[:, 0] == z).sum()) for z in zs))
    if n_u < 2 or n_v < 3:
        raise ValueError("the cloud is too small for a grid")
    first = [z[0] for z in np.array_split(zs[:-1], n_u - 1)] + [zs[-1]]
    out = []
    for z in first:
        own = p[p[:, 0] == z]
        side = max(1, int(len(own) / n_v * shrink))
        out.append([own[:side], *np.array_split(own[side:-side], n_v - 2), own[-side:]])
    return out


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the points of ``a`` to the nearest of ``b``, a block at a time."""
    out = np.empty(len(a))
    b2 = (b * b).sum(axis=1)
    for k in range(0, len(a), 1024):
        x = a[k : k + 1024]
        out[k : k + 1024] = np.maximum(((x * x).sum(axis=1)[:, None] + b2 - 2 * x @ b.T).min(axis=1), 0)
    return out


def _distinct(points: np.ndarray) -> np.ndarray:
    """Rounded points, each once, in the order in which they come first."""
    p, first = np.unique(np.rint(points), axis=0, return_index=True)
    return p[np.argsort(first, kind="stable")]


def downscaled(grid: list[list[np.ndarray]], downscale: float) -> tuple[list[list[np.ndarray]], float]:
    """The grid in units of ``downscale``, and that factor: 1 at least, and no more than the least gap in z between cells."""
    gaps = [grid[k + 1][0][:, 0].min() - grid[k][0][:, 0].max() for k in range(len(grid) - 1) if len(grid[k][0]) and len(grid[k + 1][0])]
    factor = float(max(1.0, min([max(downscale, 1.0), *gaps])))
    return [[_distinct(c / factor) if len(c) else c for c in row] for row in grid], factor


class Evolution:
    def __init__(self, grid: list[list[np.ndarray]], cloud: np.ndarray, counts: np.ndarray, r: float, seed: int = 0):
        self.grid, self.cloud, self.counts, self.r2 = grid, cloud, counts, r * r
        self.sizes = np.array([[len(c) for c in row] for row in grid])
        self.rng = np.random.default_rng(seed)
        self.pop: list[np.ndarray] = []
        self.fit: list[tuple[float, int]] = []
        #: Coverage loss of each generation, and its front: (coverage loss, excess, picks).
        self.log: list[float] = []
        self.fronts: list[list[tuple[float, int, list]]] = []

    def state(self) -> str:
        """All that is needed to go on, as JSON."""
        plain = {"grid": [[c.tolist() for c in row] for row in self.grid], "cloud": self.cloud.tolist(), "counts": self.counts.tolist(), "r2": self.r2, "rng": self.rng.bit_generator.state}
        return json.dumps(plain | {"pop": [p.tolist() for p in self.pop], "fit": self.fit, "log": self.log, "fronts": self.fronts})

    @classmethod
    def from_state(cls, state: str) -> Evolution:
        s = json.loads(state)
        points = lambda c: np.array(c, float).reshape(-1, 3)
        out = cls([[points(c) for c in row] for row in s["grid"]], points(s["cloud"]), np.array(s["counts"]), 0.0)
        out.r2, out.rng.bit_generator.state = s["r2"], s["rng"]
        out.pop, out.fit = [np.array(p, int) for p in s["pop"]], [tuple(f) for f in s["fit"]]
        out.log, out.fronts = s["log"], [[tuple(i) for i in front] for front in s["fronts"]]
        return out

    def net(self, picks: np.ndarray) -> np.ndarray:
        return np.array([[c[min(k, len(c) - 1)] if len(c) else row[0][0] for c, k in zip(row, ks, strict=True)] for row, ks in zip(self.grid, picks, strict=True)])

    def surface(self, picks: np.ndarray, factor: float = 1.0) -> np.ndarray:
        net = self.net(picks)
        n_u = max(2, int(factor * max(wire_length(net[:, j]) for j in range(net.shape[1]))))
        n_v = max(2, int(factor * max(wire_length(net[i]) for i in range(net.shape[0]))))
        return Surface(net)(np.linspace(0, 1, n_u), np.linspace(0, 1, n_v)).reshape(-1, 3)

    def fitness(self, picks: np.ndarray) -> tuple[float, int]:
        fit = self.surface(picks)
        return float((self.counts * np.minimum(_near(self.cloud, fit), self.r2)).sum()), int((_near(fit, self.cloud) > self.r2).sum())

    def random(self) -> np.ndarray:
        return (self.rng.random(self.sizes.shape) * np.maximum(self.sizes, 1)).astype(int)

    def uniform(self, index: int = 0) -> np.ndarray:
        """The point of this number in each cell, or the cell's last."""
        return np.clip(index, 0, np.maximum(self.sizes - 1, 0))

    def middle(self, pin_side: bool = False) -> np.ndarray:
        """The middle point of each cell; with ``pin_side`` the outer ones of the side columns."""
        out = np.maximum(self.sizes - 1, 0) // 2
        if pin_side:
            out[:, 0], out[:, -1] = 0, np.maximum(self.sizes[:, -1] - 1, 0)
        return out

    def surfaces(self, picks: list[np.ndarray], factor: float = 1.0) -> list[tuple[np.ndarray, np.ndarray]]:
        """The picked points and the surface of each individual."""
        return [(self.net(p).reshape(-1, 3), self.surface(p, factor)) for p in picks]

    def mutated(self, picks: np.ndarray) -> np.ndarray:
        out = picks.copy()
        at = tuple(self.rng.integers(n) for n in picks.shape)
        out[at] = self.rng.integers(max(1, self.sizes[at]))
        return out

    def crossed(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = a.ravel().copy(), b.ravel().copy()
        i, j = np.sort(self.rng.integers(0, x.size + 1, 2))
        x[i:j], y[i:j] = b.ravel()[i:j], a.ravel()[i:j]
        return x.reshape(a.shape), y.reshape(a.shape)

    def _logged(self) -> None:
        front = [k for k, r in enumerate(ranks(self.fit)) if r == 0]
        front.sort(key=lambda k: self.fit[k])
        self.fronts.append([(*self.fit[k], self.pop[k].tolist()) for k in front])
        self.log.append(self.fit[front[0]][0])

    def ratios(self) -> list[float]:
        """By how much each generation's coverage loss is less than the one's before, as a share."""
        return [1 - b / a if a else 0.0 for a, b in zip(self.log, self.log[1:], strict=False)]

    def run(self, pop_size: int = 80, tol: float = 0.005, back: int = 10, max_iter: int = 200) -> np.ndarray:
        """The individual with the least coverage loss of the last front; goes on from a population that is there."""
        size = -(-pop_size // 4) * 4
        if not self.pop:
            self.pop = [self.middle(), *(self.random() for _ in range(size - 1))]
            self.fit = [self.fitness(p) for p in self.pop]
            self._logged()
        size = len(self.pop)
        for gen in range(len(self.log) - 1, max_iter):
            parents = self._tournament(self.pop, self.fit)
            if gen % 2 == 0:
                children = [c for k in range(0, size, 2) for c in self.crossed(parents[k], parents[k + 1])]
            else:
                children = [self.mutated(p) for p in parents]
            pop, fit = self.pop + children, self.fit + [self.fitness(c) for c in children]
            keep = select(fit, size)
            self.pop, self.fit = [pop[k] for k in keep], [fit[k] for k in keep]
            self._logged()
            ratios = self.ratios()
            if len(ratios) > back and max(ratios[-back:]) < tol:
                break
        return np.array(self.fronts[-1][0][2], int)

    def _tournament(self, pop: list[np.ndarray], fit: list[tuple[float, int]]) -> list[np.ndarray]:
        """Winners of pairs: the one that dominates, else the one in the emptier place of its front, else either."""
        f, r = np.array(fit, float), ranks(fit)
        space = np.zeros(len(f))
        for k in range(r.max() + 1):
            own = np.flatnonzero(r == k)
            space[own] = crowding(f[own])
        a, b = self.rng.permutation(len(pop)), self.rng.permutation(len(pop))
        toss = self.rng.random(len(pop)) < 0.5

        def first(i: int, j: int, heads: bool) -> bool:
            for x, y, wins in ((i, j, True), (j, i, False)):
                if (f[x] <= f[y]).all() and (f[x] < f[y]).any():
                    return wins
            return heads if space[i] == space[j] else space[i] > space[j]

        return [pop[i if first(i, j, h) else j] for i, j, h in zip(a, b, toss, strict=True)]


def ranks(fit: list[tuple[float, int]]) -> np.ndarray:
    """The front of each: 0 for those that none dominates, 1 for those left then, and so on."""
    f = np.array(fit, float)
    beats = (f[:, None] <= f[None]).all(axis=2) & (f[:, None] < f[None]).any(axis=2)
    rank, left, k = np.zeros(len(f), int), np.ones(len(f), bool), 0
    while left.any():
        front = left & ~(beats & left[:, None]).any(axis=0)
        rank[front] = k
        left &= ~front
        k += 1
    return rank


def crowding(f: np.ndarray) -> np.ndarray:
    """Sums of the gaps between neighbours along each objective; ends are infinite."""
    out = np.zeros(len(f))
    for c in f.T:
        o = np.argsort(c, kind="stable")
        span = c[o[-1]] - c[o[0]] or 1.0
        out[o[[0, -1]]] = np.inf
        out[o[1:-1]] += (c[o[2:]] - c[o[:-2]]) / span
    return out


def select(fit: list[tuple[float, int]], n: int) -> list[int]:
    """The n best by front, and within the last one by crowding."""
    r, f, out = ranks(fit), np.array(fit, float), []
    for k in range(r.max() + 1):
        own = np.flatnonzero(r == k)
        if len(out) + len(own) > n:
            own = own[np.argsort(-crowding(f[own]), kind="stable")[: n - len(out)]]
        out += own.tolist()
        if len(out) == n:
            break
    return out


def evolution_of(points: np.ndarray, guide: np.ndarray, lengths=(50.0, 100.0), shrink: float = 0.25, r: float = 1.0, downscale: float = 1.0, seed: int = 0) -> tuple[Evolution, float]:
    """An evolution at its start, in units of the second result: the cloud and grid are rounded there, and so is ``r``."""
    grid, factor = downscaled(cells(points, guide, lengths, shrink), downscale)
    small, counts = np.unique(np.rint(points / factor), axis=0, return_counts=True)
    return Evolution(grid, small, counts, r / factor, seed), factor


def best_surface(evolution: Evolution, factor: float, z_range: tuple[float, float]) -> np.ndarray:
    """Rounded points of the best individual's surface at full size, over the cloud's whole range of z."""
    fit = evolution.surface(np.array(evolution.fronts[-1][0][2], int), 4.0 * factor) * factor
    lo, hi = fit[:, 0].min(), fit[:, 0].max()
    z0, z1 = z_range
    fit[:, 0] = z0 + (fit[:, 0] - lo) * ((z1 - z0) / (hi - lo) if hi > lo else 1)
    return np.unique(np.rint(fit), axis=0)


def robust_surface(points: np.ndarray, guide: np.ndarray, lengths=(50.0, 100.0), shrink: float = 0.25, r: float = 1.0, downscale: float = 1.0, pop_size: int = 80, tol: float = 0.005, max_iter: int = 200, seed: int = 0) -> tuple[np.ndarray, Evolution]:
    """Rounded points of the fitted surface and the evolution; lengths are in the points' units at any ``downscale``."""
    evolution, factor = evolution_of(points, guide, lengths, shrink, r, downscale, seed)
    evolution.run(pop_size, tol, max_iter=max_iter)
    return best_surface(evolution, factor, (points[:, 0].min(), points[:, 0].max())), evolution


def robust_states(points: DataFrame, guide: DataFrame, by: str = "label", lengths=(50.0, 100.0), shrink: float = 0.25, r: float = 1.0, downscale: float = 1.0, pop_size: int = 80, tol: float = 0.005, max_iter: int = 200, seed: int = 0) -> DataFrame:
    """``by, downscale, z_low, z_high, state`` of each component's evolution; lengths are in the points' units."""

    def one(key: tuple, cloud: pd.DataFrame, line: pd.DataFrame) -> pd.DataFrame:
        columns = ["z", "y", "x"]
        if not len(cloud) or not len(line):
            return pd.DataFrame({by: [], "downscale": [], "z_low": [], "z_high": [], "state": []})
        p = cloud[columns].to_numpy(float)
        evolution, factor = evolution_of(p, line.sort_values("idx")[columns].to_numpy(float), lengths, shrink, r, downscale, seed)
        evolution.run(pop_size, tol, max_iter=max_iter)
        return pd.DataFrame({by: [key[0]], "downscale": [factor], "z_low": [p[:, 0].min()], "z_high": [p[:, 0].max()], "state": [evolution.state()]})

    kind = points.schema[by].dataType.simpleString()
    return points.groupBy(by).cogroup(guide.groupBy(by)).applyInPandas(one, f"{by} {kind}, downscale double, z_low double, z_high double, state string")


def surfaces_of(states: DataFrame, by: str = "label") -> DataFrame:
    """``by, z, y, x`` of the best surface of each state."""

    def work(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                fit = best_surface(Evolution.from_state(row.state), row.downscale, (row.z_low, row.z_high))
                yield pd.DataFrame({by: getattr(row, by), **{c: fit[:, k].astype(int) for k, c in enumerate(("z", "y", "x"))}})

    return states.mapInPandas(work, f"{by} {states.schema[by].dataType.simpleString()}, z int, y int, x int")


def evolution_log(states: DataFrame, by: str = "label") -> DataFrame:
    """``by, gen, coverage, front_size, change_ratio``: the best of each generation's front."""
    log = F.from_json("state", "log array<double>").getField("log")
    sizes = F.from_json("state", "fronts array<array<string>>").getField("fronts")
    row = F.posexplode(F.arrays_zip(log.alias("coverage"), F.transform(sizes, F.size).alias("front_size"))).alias("gen", "g")
    rows = states.select(by, log.alias("all"), row)
    before = F.get("all", F.col("gen") - 1)
    return rows.select(by, "gen", F.col("g.coverage").alias("coverage"), F.col("g.front_size").alias("front_size"), F.when(before > 0, 1 - F.col("g.coverage") / before).alias("change_ratio"))


def robust_fit(points: DataFrame, guide: DataFrame, by: str = "label", **params) -> DataFrame:
    """``by, z, y, x`` of the surface fitted to each component; ``params`` are those of :func:`robust_states`."""
    return surfaces_of(robust_states(points, guide, by, **params), by)


def surface_area(points: np.ndarray, guide: np.ndarray, lengths: tuple[float, float]) -> float:
    """The area of the surface through the middle point of each cell, side columns pinned to their outer points."""
    grid = cells(points, guide, lengths)
    evolution = Evolution(grid, points, np.ones(len(points)), 1.0)
    net = evolution.net(evolution.middle(pin_side=True))
    return Surface(net).area()


def areas(points: DataFrame, guide: DataFrame, lengths: tuple[float, float], by: str = "label") -> DataFrame:
    """``by, area`` of each component."""

    def one(key: tuple, cloud: pd.DataFrame, line: pd.DataFrame) -> pd.DataFrame:
        if not len(cloud) or not len(line):
            return pd.DataFrame({by: [], "area": []})
        columns = ["z", "y", "x"]
        return pd.DataFrame({by: [key[0]], "area": [surface_area(cloud[columns].to_numpy(float), line.sort_values("idx")[columns].to_numpy(float), lengths)]})

    kind = points.schema[by].dataType.simpleString()
    return points.groupBy(by).cogroup(guide.groupBy(by)).applyInPandas(one, f"{by} {kind}, area double")
