"""Lines of equal value in images, to parts of a pixel, in order.

A cell is a square of four neighbouring places. Which of its corners lie above the level says, by a table of sixteen cases,
which sides a line enters and leaves by; where on a side is interpolated. The line has the higher values on its left, so one
cell's way out is the next one's way in: a segment's successor is found by the name of the side.

An image is cut into tiles; a task takes one at a time, with the places beside it, and joins its segments into pieces.
Lines within a tile are done then. Pieces that may go on in other tiles are put in order by pointer doubling over a table
of pieces: each learns the least name and the number of places ahead, over 1, 2, 4, ... steps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.operators.image import SLICE
from voxelry.storage import cut, dropped

#: Corners of a cell in turn, and the side between each and the next: 0 at y, 1 at x + 1, 2 at y + 1, 3 at x.
CORNERS = ((0, 0), (0, 1), (1, 1), (1, 0))
#: Cells along each side of a tile; one has the cells around place 0 in its middle.
TILE = 256


def ways(high: tuple[bool, ...], middle: bool) -> list[tuple[int, int]]:
    """Sides that lines enter and leave a cell by, with the high corners on their left; ``middle``: whether the cell's mean is high.

    With y downwards, the corners go round clockwise. A line leaves over a side where low turns to high and enters where
    high turns to low; of two lines, each goes round a corner: a low one if the middle is high, else a high one.
    """
    enters = [k for k in range(4) if high[k] and not high[(k + 1) % 4]]
    leaves = [k for k in range(4) if not high[k] and high[(k + 1) % 4]]
    if len(enters) < 2:
        return list(zip(enters, leaves, strict=True))
    return [(k, (k + 1) % 4 if middle else (k - 1) % 4) for k in enters]


def _in_tile(table: pa.Table, level: float, outside: float | None, tile: int) -> dict[str, np.ndarray]:
    """A tile's segments: names ``a, b`` (y, x, down), places ``pa, pb`` (y, x), and whether others may come before or follow in another tile."""
    y, x, v = (table.column(c).to_numpy().astype(t) for c, t in (("y", np.int64), ("x", np.int64), ("v", float)))
    low = [int(table.column(c)[0].as_py()) * tile - tile // 2 for c in ("ty", "tx")]
    # Cells of the tile that have a corner.
    y0, x0 = (max(o, int(c.min()) - 1) for o, c in zip(low, (y, x), strict=True))
    ny, nx = (min(o + tile - 1, int(c.max())) - s + 1 for o, c, s in zip(low, (y, x), (y0, x0), strict=True))
    values = np.full((ny + 1, nx + 1), np.nan)
    order = np.argsort(v, kind="stable")  # of values at one place, the greatest
    y, x, v = y[order], x[order], v[order]
    inside = (y >= y0) & (y <= y0 + ny) & (x >= x0) & (x <= x0 + nx)
    values[y[inside] - y0, x[inside] - x0] = v[inside]
    if outside is not None:
        values[np.isnan(values)] = outside
    c = [values[dy : ny + dy, dx : nx + dx] for dy, dx in CORNERS]
    total = c[0] + c[1] + c[2] + c[3]
    case = sum(((c[k] > level).astype(int) << k for k in range(4)), (total / 4 > level).astype(int) << 4)
    case[np.isnan(c).any(axis=0)] = 0
    ends = np.full((32, 2, 2), -1)
    for n in range(32):
        for k, pair in enumerate(ways(tuple(bool(n >> i & 1) for i in range(4)), n >= 16)):
            ends[n, k] = pair
    cy, cx = np.nonzero((case & 15 != 0) & (case & 15 != 15))
    found = ends[case[cy, cx]]
    at, way = np.nonzero(found[:, :, 0] >= 0)
    cy, cx, sides = cy[at], cx[at], found[at, way]
    corners = np.stack([k[cy, cx] for k in c])
    each = np.arange(len(cy))
    out = {}
    for name, place, may, side in (("a", "pa", "before", sides[:, 0]), ("b", "pb", "after", sides[:, 1])):
        v0, v1 = corners[side, each], corners[(side + 1) % 4, each]
        with np.errstate(invalid="ignore"):
            t = (level - v0) / (v1 - v0)
        # A side's name is the same from both cells: its first place, and whether it goes down.
        out[name] = np.stack([cy + y0 + (side == 2), cx + x0 + (side == 1), side % 2], axis=1).reshape(-1, 3)
        out[place] = np.stack([(cy + y0) + np.choose(side, [0.0, t, 1.0, 1 - t]), (cx + x0) + np.choose(side, [t, 1.0, 1 - t, 0.0])], axis=1).reshape(-1, 2)
        beyond_y, beyond_x = cy + y0 + np.choose(side, [-1, 0, 1, 0]) - low[0], cx + x0 + np.choose(side, [0, 1, 0, -1]) - low[1]
        out[may] = (beyond_y < 0) | (beyond_y >= tile) | (beyond_x < 0) | (beyond_x >= tile)
    return out


def _kinds(image: DataFrame, by: tuple[str, ...]) -> tuple[str, str]:
    """The types of the keys and of a side's name."""
    whole = {c: "bigint" if image.schema[c].dataType.simpleString() == "bigint" else "int" for c in "yx"}
    return "".join(f"`{c}` {image.schema[c].dataType.simpleString()}, " for c in by), f"struct<y:{whole['y']},x:{whole['x']},down:int>"


def _tiled(image: DataFrame, level: float, value: str, by: tuple[str, ...], outside: float | None, work: Callable, columns: str, parts: int | None) -> DataFrame:
    """What ``work`` makes of each tile's segments: arrays by name, one row for each of ``n``. ``parts``: partitions of tiles, else Spark's number."""
    tile = TILE
    keys, name = _kinds(image, by)
    kinds = [pa.int64() if k.endswith("bigint") else pa.int32() for k in name[7:-1].split(",")]
    rows = image.where(F.col(value).isNotNull()).select(*by, "y", "x", F.col(value).cast("double").alias("v"))
    # A place is a corner of cells in up to four tiles.
    of = lambda c, d: F.floor((F.col(c) - d + tile // 2) / F.lit(tile)).cast("long")
    tiles = F.explode(F.array_distinct(F.array(*(F.struct(of("y", dy).alias("ty"), of("x", dx).alias("tx")) for dy, dx in CORNERS)))).alias("t")
    dealt = rows.select(*by, "y", "x", "v", tiles).select(*by, "y", "x", "v", "t.ty", "t.tx")

    if parts:
        dealt = dealt.repartition(parts, *by, "ty", "tx")

    def one(table: pa.Table) -> pa.Table:
        found = work(_in_tile(table, level, outside, tile))
        n = len(next(iter(found.values())))
        first = pa.array(np.zeros(n, np.int64))
        out = [table.column(c).combine_chunks().take(first) for c in by]
        for column in found.values():
            missing = None
            if isinstance(column, tuple):
                column, missing = column
            if column.ndim == 2:
                column = pa.StructArray.from_arrays([pa.array(column[:, k]).cast(kinds[k]) for k in range(3)], names=["y", "x", "down"], mask=None if missing is None else pa.array(missing))
            out.append(pa.array(column) if isinstance(column, np.ndarray) else column)
        return pa.Table.from_arrays(out, names=[*by, *found])

    return dealt.groupBy(*by, "ty", "tx").applyInArrow(one, keys + columns.format(name=name))


def segments(image: DataFrame, level: float, value: str = "v", by: tuple[str, ...] = SLICE, outside: float | None = None, parts: int | None = None) -> DataFrame:
    """``by, a, b, ay, ax, by_, bx``: segments from side ``a`` to side ``b`` (names of sides) with their ends' places.

    Cells need four values; with ``outside``, places without one have that value. ``parts``: partitions that tiles are dealt to.
    """

    def work(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {"a": s["a"], "b": s["b"], "ay": s["pa"][:, 0], "ax": s["pa"][:, 1], "by_": s["pb"][:, 0], "bx": s["pb"][:, 1]}

    return _tiled(image, level, value, by, outside, work, "a {name}, b {name}, ay double, ax double, by_ double, bx double", parts)


def _first(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each one the first along ``before`` (itself at the first), and the steps from there; on a ring, some other one."""
    first, steps = before.copy(), (before != np.arange(len(before))).astype(np.int64)
    for _ in range(max(1, len(before)).bit_length()):
        steps, first = steps + steps[first], first[first]
    return first, steps


def _pieces(s: dict[str, np.ndarray]) -> dict:
    """A row for each place on a line: its side, its piece's first side, place and number there, and at the piece's first place what follows.

    ``done``: the piece is a whole line; ``line`` is its least side then. Else ``line`` is the piece's first side, and its
    row there has ``to``, the side that it goes on to (none at an end), with its place, and ``low``, the piece's least side, with ``low_at``.
    """
    m = len(s["a"])
    both = np.concatenate([s["a"], s["b"]])
    y0, x0 = both[:, :2].min(axis=0, initial=0)
    wide = int(both[:, 1].max(initial=0)) - x0 + 1
    code = ((both[:, 0] - y0) * wide + both[:, 1] - x0) * 2 + both[:, 2]
    order = np.argsort(code[:m])
    spot = np.minimum(np.searchsorted(code[:m][order], code[m:]), max(m - 1, 0))
    after = np.where(code[:m][order][spot] == code[m:], order[spot], -1) if m else np.zeros(0, np.int64)
    # A side that a line ends at is a place of its own.
    last = np.flatnonzero((after < 0) & ~s["after"])
    n = m + len(last)
    code = np.concatenate([code[:m], code[m:][last]])
    name, place = np.concatenate([s["a"], s["b"][last]]), np.concatenate([s["pa"], s["pb"][last]])
    after[last] = np.arange(m, n)
    before = np.arange(n)
    before[after[after >= 0]] = np.flatnonzero(after >= 0)
    start = before == np.arange(n)
    ring = ~start[_first(before)[0]]
    # A ring begins at its least side.
    least, ahead = code.copy(), before.copy()
    for _ in range(max(1, n).bit_length()):
        least, ahead = np.minimum(least, least[ahead]), ahead[ahead]
    begin = ring & (least == code)
    before[begin] = np.flatnonzero(begin)
    first, steps = _first(before)
    size = np.bincount(first, minlength=n)
    lowest = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(lowest, first, code)
    low = np.zeros(n, np.int64)
    is_low = code == lowest[first]
    low[first[is_low]] = np.flatnonzero(is_low)
    # The last segment of each piece, and whether it may go on.
    tail = np.zeros(n, np.int64)
    end = steps == size[first] - 1
    tail[first[end]] = np.flatnonzero(end)
    goes = np.concatenate([(after[:m] < 0) & s["after"], np.zeros(n - m, bool)])
    comes = np.concatenate([s["before"], np.zeros(n - m, bool)])
    open_end = goes[tail[first]]
    done = ring | ~(open_end | comes[first])
    at_first = ~done & (first == np.arange(n))
    nowhere = ~(at_first & open_end)
    follow = np.where(nowhere, 0, np.minimum(tail[first], max(m - 1, 0)))
    to, p = (s[c][follow] if m else np.zeros((n, k)) for c, k in (("b", 3), ("pb", 2)))
    line = np.where(done, low[first], first)
    return {"a": name, "y": place[:, 0], "x": place[:, 1], "line": name[line], "place": steps, "n": size[first], "closed": ring, "done": done, "first": at_first, "to": (to, nowhere), "to_y": p[:, 0], "to_x": p[:, 1], "low": name[low[first]], "low_at": steps[low[first]]}


def _joined(pieces: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by, head, line, closed, total, start``: each piece's line, its number of places, and the piece's first place on it.

    ``pieces``: ``by, head, to, n, low, low_at``; ``to`` is another's ``head`` or null.
    """
    now = cut(pieces.select(*by, "head", F.coalesce("to", "head").alias("to"), "low", F.col("to").isNull().alias("ended")))
    reached = -1
    while True:
        other = now.select(*by, F.col("head").alias("to"), F.col("to").alias("next"), F.col("low").alias("low2"), F.col("ended").alias("ended2"))
        new = cut(now.join(other, [*by, "to"]).select(*by, "head", F.col("next").alias("to"), F.least("low", "low2").alias("low"), (F.col("ended") | F.col("ended2")).alias("ended"), (F.col("low2") < F.col("low")).alias("lower")))
        # Of a line with an end, more pieces reach it in every round until all do; of one without, some learn of a lesser side.
        lower, n = new.agg(F.count_if("lower"), F.count_if("ended")).first()
        dropped(now)
        now = new
        if not lower and n == reached:
            break
        reached = n
    # On a ring, the piece with the least side comes first.
    mark = now.select(*by, "head", F.when(F.col("ended"), F.col("to")).otherwise(F.col("low")).alias("mark"), (~F.col("ended")).alias("closed"))
    own = cut(pieces.join(mark, [*by, "head"]))
    firsts = own.where(F.col("closed") & (F.col("low") == F.col("mark"))).select(*by, F.col("head").alias("to"), F.lit(True).alias("wraps"))
    ends = own.join(firsts, [*by, "to"], "left").select(*by, "head", "to", "n", (F.col("to").isNull() | F.coalesce("wraps", F.lit(False))).alias("last"))
    now = cut(ends.select(*by, "head", F.when(F.col("last"), F.col("head")).otherwise(F.col("to")).alias("to"), F.when(F.col("last"), 0).otherwise(F.col("n")).cast("long").alias("steps")))
    moved = True
    while moved:
        other = now.select(*by, F.col("head").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        new = cut(now.join(other, [*by, "to"]).select(*by, "head", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")))
        moved = not new.where("moved").isEmpty()
        dropped(now)
        now = new.drop("moved")
    lines = own.groupBy(*by, "mark").agg(F.sum("n").alias("total"), F.min("low").alias("line"), F.min_by("low_at", "low").alias("turn"))
    last = own.select(*by, F.col("head").alias("to"), F.col("n").alias("n_last"))
    placed = now.join(last, [*by, "to"]).join(own.select(*by, "head", "mark", "closed"), [*by, "head"]).join(lines, [*by, "mark"])
    start = F.col("total") - F.col("steps") - F.col("n_last") - F.when(F.col("closed"), F.col("turn")).otherwise(0)
    return placed.select(*by, "head", F.col("line").alias("whole"), F.col("closed").alias("ring"), "total", start.alias("start"))


def iso_lines(image: DataFrame, level: float, value: str = "v", by: tuple[str, ...] = SLICE, outside: float | None = None, parts: int | None = None) -> DataFrame:
    """``by, line, place, closed, n, y, x``: lines with their places in order from 0; ``line`` is named by its least side.

    A closed line begins at its least side and doesn't come back to it, an open one goes from end to end; ``n`` is its number of places.
    """
    columns = "a {name}, y double, x double, line {name}, place bigint, n bigint, closed boolean, done boolean, first boolean, to {name}, to_y double, to_x double, low {name}, low_at bigint"
    places = cut(_tiled(image, level, value, by, outside, _pieces, columns, parts))
    out = [*by, "line", "place", "closed", "n", "y", "x"]
    whole, rest = places.where("done").select(*out), places.where("not done")
    if rest.isEmpty():
        return whole
    heads = rest.where("first")
    # A piece may leave its tile and end there: that side is a piece of one place.
    none = heads.where("to is not null").join(heads.select(*by, F.col("line").alias("to")), [*by, "to"], "left_anti")
    ends = cut(none.select(*by, F.col("to").alias("line"), F.col("to_y").alias("y"), F.col("to_x").alias("x")))
    pieces = heads.select(*by, F.col("line").alias("head"), "to", "n", "low", "low_at")
    kind = pieces.schema["to"].dataType
    pieces = pieces.unionByName(ends.select(*by, F.col("line").alias("head"), F.lit(None).cast(kind).alias("to"), F.lit(1).cast("long").alias("n"), F.col("line").alias("low"), F.lit(0).cast("long").alias("low_at")))
    found = cut(_joined(cut(pieces), by))
    parts = rest.select(*by, F.col("line").alias("head"), "place", "y", "x").unionByName(ends.select(*by, F.col("line").alias("head"), F.lit(0).cast("long").alias("place"), "y", "x"))
    at = F.col("start") + F.col("place")
    joined = parts.join(found, [*by, "head"]).select(*by, F.col("whole").alias("line"), F.when(F.col("ring"), F.pmod(at, F.col("total"))).otherwise(at).alias("place"), F.col("ring").alias("closed"), F.col("total").alias("n"), "y", "x")
    return whole.unionByName(joined)
