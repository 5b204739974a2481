"""Contours and sampling grids: points in order, with windows over that order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelry.functions.columns import norm


def split_at_gaps(points: DataFrame, most: float, by: tuple[str, ...] = ("object",), axes: tuple[str, ...] = ("y", "x"), order: str = "idx") -> DataFrame:
    """Adds ``contour``, from 1: a new one at each new z, and in a slice where two points are further apart than ``most``."""
    line = Window.partitionBy(*by).orderBy("z", order)
    step = norm(*(F.col(c).cast("double") - F.lag(c).over(line) for c in axes))
    new = F.lag("z").over(line).isNull() | (F.lag("z").over(line) != F.col("z")) | (step > most)
    marked = points.withColumn("__new", new.cast("long"))
    return marked.withColumn("contour", F.sum("__new").over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def gap_fill(points: DataFrame, by: tuple[str, ...] = ("x",), axes: tuple[str, ...] = ("y",)) -> DataFrame:
    """Points at every z between those of a track (``by``), linear in z between its neighbours."""
    line = Window.partitionBy(*by).orderBy("z")
    pair = points.select(*by, "z", *axes, F.lead("z").over(line).alias("__z2"), *(F.lead(c).over(line).alias(f"__{c}2") for c in axes))
    last = F.coalesce(F.col("__z2") - 1, F.col("z"))
    each = pair.select(*by, F.col("z").alias("__z1"), "__z2", *axes, *(f"__{c}2" for c in axes), F.explode(F.sequence("z", F.greatest(last, F.col("z")))).alias("z"))
    at = lambda c: F.when(F.col("__z2").isNull(), F.col(c).cast("double")).otherwise(((F.col("__z2") - F.col("z")) * F.col(c) + (F.col("z") - F.col("__z1")) * F.col(f"__{c}2")) / (F.col("__z2") - F.col("__z1"))).alias(c)
    return each.select(*by, "z", *(at(c) for c in axes))


def slices_with_points(points: DataFrame, least: int = 2) -> DataFrame:
    """Points of slices that have at least so many."""
    return points.join(points.groupBy("z").count().where(F.col("count") >= least).select("z"), "z", "left_semi")


def chord_parameters(points: DataFrame, by: tuple[str, ...] = ("z",), order: str = "idx", axes: tuple[str, ...] = ("y", "x"), exponent: float = 0.5) -> DataFrame:
    """Adds ``t`` from 0 to 1: the running sum of step lengths to the power ``exponent``, over its total."""
    line = Window.partitionBy(*by).orderBy(order)
    step = F.pow(norm(*(F.col(c).cast("double") - F.lag(c).over(line) for c in axes)), F.lit(exponent))
    run = points.withColumn("__s", F.coalesce(step, F.lit(0.0)))
    run = run.withColumn("__t", F.sum("__s").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.max("__t").over(Window.partitionBy(*by))
    return run.withColumn("t", F.when(total > 0, F.col("__t") / total).otherwise(F.lit(0.0))).drop("__s", "__t")


def knots(parameters: DataFrame, degree: int, by: tuple[str, ...] = ("z",), order: str = "idx") -> DataFrame:
    """``k, knot``: degree + 1 zeros, the means of ``degree`` parameters in a row, degree + 1 ones."""
    line = Window.partitionBy(*by).orderBy(order)
    inner = parameters.select(*by, F.row_number().over(line).alias("r"), F.count("*").over(Window.partitionBy(*by)).alias("n"), F.avg("t").over(line.rowsBetween(-(degree - 1), 0)).alias("knot"))
    inner = inner.where((F.col("r") >= degree + 1) & (F.col("r") < F.col("n")))
    middle = inner.select(*by, F.col("r").cast("long").alias("k"), "knot")
    counts = parameters.groupBy(*by).agg(F.count("*").alias("n"))
    ends = counts.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(degree))).alias("j"))
    start = ends.select(*by, F.col("j").cast("long").alias("k"), F.lit(0.0).alias("knot"))
    stop = ends.select(*by, (F.col("n") + F.col("j")).cast("long").alias("k"), F.lit(1.0).alias("knot"))
    return start.unionByName(middle).unionByName(stop)


def grid_rows(zs: DataFrame, n_uz: int, nz_each: int = 1) -> DataFrame:
    """``iu, z``: slices split into n_uz - 1 even bins but for the last ``nz_each``, which are a bin; the first ones of each."""
    order = Window.orderBy("z")
    ranked = zs.select("z").distinct().withColumns({"r": F.row_number().over(order), "n": F.count("*").over(Window.orderBy("z").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    last = ranked.where(F.col("r") > F.col("n") - nz_each).select(F.lit(n_uz - 1).alias("iu"), "z")
    rest = ranked.where(F.col("r") <= F.col("n") - nz_each).withColumn("iu", F.ntile(n_uz - 1).over(order) - 1)
    rest = rest.withColumn("k", F.row_number().over(Window.partitionBy("iu").orderBy("z"))).where(F.col("k") <= nz_each)
    return rest.select("iu", "z").unionByName(last)


def sampling_grid(points: DataFrame, n_uz: int, n_vxy: int, shrink_side: float = 0.25, nz_each: int = 1) -> DataFrame:
    """Points (ordered by ``idx`` in each slice) in cells ``iu, iv``; the first and last columns are narrower."""
    both = points.join(F.broadcast(grid_rows(points, n_uz, nz_each)), "z")
    line = Window.partitionBy("iu", "z").orderBy("idx")
    r = both.withColumns({"r": F.row_number().over(line), "n": F.count("*").over(Window.partitionBy("iu", "z"))})
    r = r.withColumn("side", F.greatest(F.lit(1), F.floor(F.col("n") / n_vxy * shrink_side)).cast("int"))
    ends = F.when(F.col("r") <= F.col("side"), 0).when(F.col("r") > F.col("n") - F.col("side"), n_vxy - 1)
    r = r.withColumn("end", ends)
    middle = r.where("end is null").withColumn("iv", F.ntile(n_vxy - 2).over(line))
    return r.where("end is not null").withColumn("iv", F.col("end")).unionByName(middle).drop("r", "n", "side", "end")


def grid_downscale(points: DataFrame, factor: float) -> DataFrame:
    """Points over ``factor``, rounded and counted, in order of first appearance."""
    from voxelry.operators.points import deduplicate

    return deduplicate(points.select("idx", *((F.col(c) / float(factor)).alias(c) for c in ("z", "y", "x"))), count=True)
