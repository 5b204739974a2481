"""Images as voxels: rows of ``z, y, x`` and values.

An operator that works slice by slice takes ``by``, the columns that name a slice (for many volumes at once, the
volume and z). Dense images have a row for each place, sparse ones only for places that are not zero. All is Spark SQL;
windows run on a line of a slice, those of :func:`slice_value_filter` and of the border in
:func:`non_maximum_suppression` on a whole slice.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICE = ("z",)


def _per(df: DataFrame, by: tuple[str, ...], *aggs: Column) -> DataFrame:
    """Aggregates of each group, or of all rows, joined to every row."""
    if by:
        return df.join(df.groupBy(*by).agg(*aggs), list(by))
    totals = df.agg(*aggs)
    return df.withColumns({c: F.lit(v).cast(totals.schema[c].dataType) for c, v in totals.first().asDict().items()})


def scale_zscore(df: DataFrame, value: str = "v", by: tuple[str, ...] = ()) -> DataFrame:
    """``value`` minus its mean over its population deviation; unchanged where that is 0."""
    both = _per(df, by, F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    scaled = F.when(F.col("__s") == 0, F.col(value).cast("double")).otherwise((F.col(value) - F.col("__m")) / F.col("__s"))
    return both.withColumn(value, scaled).drop("__m", "__s")


def exact_quantiles(df: DataFrame, value: str, qs: tuple[float, ...], few: int = 10_000, buckets: int = 1024) -> list[float | None]:
    """Quantiles by linear interpolation of order statistics, without gathering the values.

    The range that holds a rank is counted in buckets, and the bucket that holds it is counted again, until few values
    are left or all are equal; only those reach the driver.
    """
    x = df.select(F.col(value).cast("double").alias("x")).where("x is not null")
    n, low, high = x.agg(F.count("*"), F.min("x"), F.max("x")).first()

    def at_rank(k: int) -> float:
        lo, hi, below, size = low, high, 0, n
        part = x
        while size > few and lo < hi:
            width = (hi - lo) / buckets
            cell = F.least(F.floor((F.col("x") - lo) / width), F.lit(buckets - 1)).alias("c")
            counts = part.groupBy(cell).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("c").collect()
            for r in counts:
                if below + r["n"] > k:
                    lo, hi, size = r["lo"], r["hi"], r["n"]
                    break
                below += r["n"]
            part = x.where((F.col("x") >= lo) & (F.col("x") <= hi))
        if lo == hi:
            return lo
        return sorted(r["x"] for r in part.collect())[k - below]

    out = []
    for q in qs:
        h = (n - 1) * q
        a = at_rank(math.floor(h)) if n else None
        out.append(a if not n or h == math.floor(h) else a + (at_rank(math.ceil(h)) - a) * (h - math.floor(h)))
    return out


def scale_minmax(df: DataFrame, value: str = "v", qrange=(0.0, 1.0), vrange=(0.0, 1.0), by: tuple[str, ...] = ()) -> DataFrame:
    """Clips ``value`` to two exact quantiles and maps those to ``vrange``, which may run downwards."""
    if by:
        both = _per(df, by, *(F.expr(f"percentile({value}, {q})").alias(n) for n, q in zip(("__lo", "__hi"), qrange, strict=True)))
    else:
        both = df.withColumns({n: F.lit(v).cast("double") for n, v in zip(("__lo", "__hi"), exact_quantiles(df, value, qrange), strict=True)})
    clipped = F.least(F.greatest(F.col(value).cast("double"), F.col("__lo")), F.col("__hi"))
    scaled = vrange[0] + (clipped - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * (vrange[1] - vrange[0])
    return both.withColumn(value, F.when(F.col("__hi") == F.col("__lo"), F.col(value).cast("double")).otherwise(scaled)).drop("__lo", "__hi")


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [(k - r, x / sum(w)) for k, x in enumerate(w)]


def gaussian(df: DataFrame, sigma: float, value: str = "v", axes: tuple[str, ...] = ("y", "x"), by: tuple[str, ...] = SLICE) -> DataFrame:
    """Smooths a dense image along each axis in turn; beyond an edge, the edge's value holds. Sigma 0 changes nothing."""
    if sigma == 0:
        return df
    kernel = gaussian_kernel(sigma)
    reach = kernel[-1][0]
    for axis in axes:
        line = Window.partitionBy(*(c for c in (*by, "z", "y", "x") if c != axis and c in df.columns)).orderBy(axis)
        ordered = F.collect_list(F.col(value).cast("double")).over(line.rowsBetween(-reach, reach))
        at = F.row_number().over(line)
        n = F.count("*").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        first = F.greatest(at - reach, F.lit(1))
        total = F.lit(0.0)
        for k, w in kernel:
            place = F.least(F.greatest(at + k, F.lit(1)), n)
            total = total + w * F.get(F.col("__near"), (place - F.col("__first")).cast("int"))
        df = df.withColumns({"__near": ordered, "__first": first}).withColumn(value, total).drop("__near", "__first")
    return df


def gradient(df: DataFrame, value: str, axis: str, out: str, by: tuple[str, ...] = SLICE) -> DataFrame:
    """Central differences along an axis, one-sided at its ends."""
    others = tuple(dict.fromkeys(c for c in (*by, "z", "y", "x") if c in df.columns and c != axis))
    line = Window.partitionBy(*others).orderBy(axis)
    before, after, here = F.lag(value).over(line), F.lead(value).over(line), F.col(value)
    one_sided = F.coalesce(after - here, here - before).cast("double")
    return df.withColumn(out, F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2.0).otherwise(one_sided))


def hessian(df: DataFrame, sigma: float = 0.0, value: str = "v", axes: tuple[str, ...] = ("x", "y"), by: tuple[str, ...] = SLICE) -> DataFrame:
    """Adds ``hxx, hxy, hyy`` (and with axes x, y, z the six of three dimensions): gradients of gradients."""
    df = gaussian(df, sigma, value, tuple(reversed(axes)), by)
    # All differences along one axis follow each other, so its lines are shuffled together once.
    for k, b in enumerate(axes):
        df = gradient(df, value, b, f"__{b}", by)
        for a in axes[: k + 1]:
            df = gradient(df, f"__{a}", b, f"h{a}{b}", by)
    return df.drop(*(f"__{a}" for a in axes))


def symmetric_image(df: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Adds ``h``, the Hessian's elements as a matrix."""
    name = lambda a, b: f"h{a}{b}" if axes.index(a) <= axes.index(b) else f"h{b}{a}"
    return df.withColumn("h", F.array(*(F.array(*(F.col(name(a, b)) for b in axes)) for a in axes)))


def ridge(df: DataFrame, sigma: float = 0.0, value: str = "v", by: tuple[str, ...] = SLICE) -> DataFrame:
    """Adds saliency ``s`` and orientation ``o`` of bright ridges, both 0 where the Hessian's trace isn't negative."""
    h = hessian(df, sigma, value, by=by)
    xx, xy, yy = (F.col(f"h{c}").cast("double") for c in ("xx", "xy", "yy"))
    trace = xx + yy
    h2xx, h2xy, h2yy = xx * xx + xy * xy, trace * xy, yy * yy + xy * xy
    split = h2xx - h2yy
    none = F.lit(0.0)
    s = F.when(trace < 0, F.sqrt(split * split + 4 * h2xy * h2xy)).otherwise(none)
    o = F.when(trace < 0, 0.5 * F.atan2(F.lit(0.0) - 2 * h2xy, F.lit(0.0) - split)).otherwise(none)
    return h.withColumns({"s": s, "o": o}).drop("hxx", "hxy", "hyy")


def ridge3d(df: DataFrame, sigma: float, value: str = "v", by: tuple[str, ...] = SLICE) -> DataFrame:
    """Smooths in three dimensions, then finds the ridges of each slice."""
    return ridge(gaussian(df, sigma, value, ("z", "y", "x"), by), 0.0, value, by)


#: (from, dx, dy): the direction whose range of normals starts there, in eighths of pi.
DIRECTIONS = ((0, 1, 0), (1, 1, 1), (3, 0, 1), (5, -1, 1), (7, -1, 0))


def non_maximum_suppression(df: DataFrame, value: str = "s", orient: str = "o", suppress: bool = True, by: tuple[str, ...] = SLICE, digits: int | None = None) -> DataFrame:
    """Places of a dense image that are greater than both neighbours along their normal, as ``by, y, x``.

    The image's border can't be a maximum. With ``suppress``, a place that some inner place exceeds along that place's
    normal is none either. ``digits`` rounds normals before they are sorted into the five ranges.
    """
    normal = F.pmod(F.col(orient) + math.pi / 2, F.lit(math.pi))
    normal = F.round(normal, digits) if digits is not None else normal
    dx, dy = F.lit(1), F.lit(0)
    for start, x, y in DIRECTIONS[1:]:
        dx, dy = (F.when(normal >= start * math.pi / 8, F.lit(v)).otherwise(old) for v, old in ((x, dx), (y, dy)))
    edge = Window.partitionBy(*by)
    inner = lambda c: (F.col(c) > F.min(c).over(edge)) & (F.col(c) < F.max(c).over(edge))
    img = df.select(*by, "y", "x", F.col(value).alias("s"), dx.alias("dx"), dy.alias("dy"), (inner("y") & inner("x")).alias("inner"))
    side = F.explode(F.array(F.lit(1), F.lit(-1))).alias("side")
    looks = img.where("inner").select(*by, F.col("y").alias("py"), F.col("x").alias("px"), F.col("s").alias("ps"), "dx", "dy", side).select(*by, "py", "px", "ps", (F.col("py") + F.col("side") * F.col("dy")).alias("y"), (F.col("px") + F.col("side") * F.col("dx")).alias("x"))
    beats = looks.join(img.select(*by, "y", "x", "s"), [*by, "y", "x"]).where("ps > s")
    best = beats.groupBy(*by, "py", "px").count().where("count = 2").select(*by, F.col("py").alias("y"), F.col("px").alias("x"))
    return best.join(beats.select(*by, "y", "x").distinct(), [*by, "y", "x"], "left_anti") if suppress else best


def pixels2points(df: DataFrame, value: str = "v") -> DataFrame:
    """Places that are not zero, with their order in the image as ``idx``; the order within a slice is a window's."""
    from voxelry.operators.points import ordinal

    return ordinal(df.where(F.col(value) != 0), "z", "y", "x").select(F.col("ord").alias("idx"), "z", "y", "x")


def sparsify(df: DataFrame, value: str = "v") -> DataFrame:
    return df.where(F.col(value) != 0)


def densify(df: DataFrame, shape: tuple[int, int, int], value: str = "v") -> DataFrame:
    """A row for each place of ``shape``; places without one get 0."""
    nz, ny, nx = shape
    grid = df.sparkSession.range(nz * ny * nx).select(*(F.expr(e).cast("int").alias(c) for c, e in (("z", f"id div {ny * nx}"), ("y", f"id div {nx} % {ny}"), ("x", f"id % {nx}"))))
    return grid.join(df.select("z", "y", "x", value), ["z", "y", "x"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def dilate(pixels: DataFrame, by: tuple[str, ...] = SLICE, full: bool = False) -> DataFrame:
    """Places (``by, y, x``) that are set or next to one that is; with ``full``, diagonally too."""
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if full or not (dy and dx)]
    step = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps))).alias("d")
    return pixels.select(*by, "y", "x", step).select(*by, (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x")).distinct()


def erode(pixels: DataFrame, by: tuple[str, ...] = SLICE, shape: tuple[int, int] | None = None) -> DataFrame:
    """Places that are set with all four neighbours; outside ``shape`` (ny, nx) counts as set."""
    steps = ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))
    step = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps))).alias("d")
    around = pixels.select(*by, "y", "x", step).select(*by, (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    need = F.lit(5)
    if shape:
        for c, n in zip(("y", "x"), shape, strict=True):
            need = need - (F.col(c) == 0).cast("int") - (F.col(c) == n - 1).cast("int")
    return around.groupBy(*by, "y", "x").count().where(F.col("count") >= need).drop("count").join(pixels, [*by, "y", "x"], "left_semi")


def close(pixels: DataFrame, by: tuple[str, ...] = SLICE) -> DataFrame:
    """Dilation, then erosion."""
    return erode(dilate(pixels, by), by)


def boundary(pixels: DataFrame, by: tuple[str, ...] = SLICE) -> DataFrame:
    """Set places with a neighbour that isn't."""
    return pixels.join(erode(pixels, by), [*by, "y", "x"], "left_anti")


def adjacent_pairs(pixels: DataFrame, connectivity: int = 2, axes: tuple[str, ...] = ("y", "x"), by: tuple[str, ...] = SLICE) -> DataFrame:
    """Pairs of neighbouring set places by ``id``: those that differ by one in at most ``connectivity`` axes.

    With axes z, y and x (and ``by`` without z), neighbours may lie in the next slice.
    """
    steps = [s for s in itertools.product((-1, 0, 1), repeat=len(axes)) if s > (0,) * len(axes) and sum(map(abs, s)) <= connectivity]
    step = F.explode(F.array(*(F.struct(*(F.lit(v).alias(a) for a, v in zip(axes, s, strict=True))) for s in steps))).alias("d")
    frm = pixels.select(*by, F.col("id").alias("src"), *axes, step).select(*by, "src", *((F.col(a) + F.col(f"d.{a}")).alias(a) for a in axes))
    return frm.join(pixels.select(*by, F.col("id").alias("dst"), *axes), [*by, *axes]).select("src", "dst")


def largest_image_components(pixels: DataFrame, n_keep: int = 1, connectivity: int = 2, axes: tuple[str, ...] = ("y", "x"), by: tuple[str, ...] = SLICE) -> DataFrame:
    """``pixels`` (with ``id``) of the largest components, with ``component``, ``size`` and ``place`` from 1."""
    from voxelry.operators.division import largest
    from voxelry.operators.graph import connected_components

    found = connected_components(adjacent_pairs(pixels, connectivity, axes, by))
    named = pixels.join(found, "id", "left").withColumn("component", F.coalesce("component", F.col("id").cast("long")))
    return largest(named, n_keep)


def component_contour(pixels: DataFrame, erode_first: bool = True, by: tuple[str, ...] = SLICE) -> DataFrame:
    """``by, idx, y, x``: the longest outline of each slice's set places, halfway between set places and those beside them.

    With ``erode_first``, places are eroded by one first. An outline ends where it begins.
    """
    from voxelry.operators.isolines import iso_lines
    from voxelry.storage import cut

    kept = erode(pixels.select(*by, "y", "x"), by) if erode_first else pixels.select(*by, "y", "x")
    lines = cut(iso_lines(kept.withColumn("v", F.lit(1.0)), 0.5, by=by, outside=0.0))
    first = lines.where("place = 0")
    longest = first.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), "line")).alias("best")).select(*by, F.col("best.line").alias("line"))
    again = first.select(*by, "line", F.col("n").alias("place"), "y", "x")
    return lines.select(*by, "line", "place", "y", "x").unionByName(again).join(longest, [*by, "line"], "left_semi").select(*by, F.col("place").alias("idx"), "y", "x")


def spread_slices(df: DataFrame, n: int) -> list[int]:
    """``n`` slices spread evenly over the range of z."""
    r = df.agg(F.min("z"), F.max("z")).first()
    return sorted({int(v) for v in np.linspace(r[0], r[1], n)}) if r[0] is not None else []


def slice_value_filter(df: DataFrame, guide: DataFrame, factor: float, value: str = "v", by: tuple[str, ...] = SLICE) -> DataFrame:
    """In each slice the strongest share of places, ``factor`` times the guide's number of points over the places' number.

    The threshold is the linear interpolation of two order statistics, and values equal to it stay.
    """
    ranked = Window.partitionBy(*by).orderBy(value, "y", "x")
    n = F.count("*").over(Window.partitionBy(*by))
    sizes = guide.groupBy(*by).agg(F.count("*").alias("__ng"))
    r = df.join(sizes, list(by)).withColumns({"__r": F.row_number().over(ranked) - 1, "__n": n})
    r = r.withColumn("__h", (F.col("__n") - 1) * (1 - F.least(F.lit(1.0), F.col("__ng") * float(factor) / F.col("__n"))))
    pick = lambda f: F.max(F.when(F.col("__r") == f("__h"), F.col(value)))
    t = r.groupBy(*by).agg(pick(F.floor).alias("__lo"), pick(F.ceil).alias("__hi"), F.max(F.col("__h") - F.floor("__h")).alias("__f"))
    t = t.select(*by, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")).alias("__t"))
    return df.join(t, list(by)).where(F.col(value) >= F.col("__t")).drop("__t")
