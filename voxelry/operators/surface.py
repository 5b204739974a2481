"""Fitness of surfaces, Pareto fronts and change logs; splines and evolution are in :mod:`voxelry.operators.evolution`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelry.operators.spatial import nearest_within

ZYX = ("z", "y", "x")


def surface_fitness(cloud: DataFrame, fit: DataFrame, r: float) -> DataFrame:
    """One row ``coverage, excess``: the cloud's counted squared distances to the fit, each at most r, and the fit's points further than r from the cloud."""
    a = cloud.select(F.col("idx").alias("id"), *ZYX)
    b = fit.select(F.col("idx").alias("id"), *ZYX)
    near = nearest_within(a, b, r).select(F.col("a_id").alias("idx"), "d2")
    n = F.col("n") if "n" in cloud.columns else F.lit(1)
    cover = cloud.join(near, "idx", "left").agg(F.sum(n * F.least(F.coalesce("d2", F.lit(float(r * r))), F.lit(float(r * r)))).alias("coverage"))
    far = b.join(nearest_within(b, a, r).select(F.col("a_id").alias("id")), "id", "left_anti").count()
    return cover.withColumn("excess", F.lit(far).cast("long"))


def pareto_front(rows: DataFrame, f1: str = "f1", f2: str = "f2") -> DataFrame:
    """Rows that no other one dominates (both objectives no greater, one smaller).

    For each f1 only the least f2 matters, so rows are combined by f1 first. A row is on the front if its f2 is below
    that of every smaller f1. The running minimum is taken in two steps, over ranges of f1 and within each, so no
    task sees all values.
    """
    least = rows.groupBy(f1).agg(F.min(f2).alias("__m"))
    box = least.agg(F.min(f1).alias("lo"), F.max(f1).alias("hi")).first()
    if box["lo"] is None:
        return rows
    width = max(1.0, (float(box["hi"]) - float(box["lo"]) + 1) / 256)
    cells = least.withColumn("__c", F.floor((F.col(f1) - F.lit(box["lo"])) / width))
    before_cell = Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cells.groupBy("__c").agg(F.min("__m").alias("__r")).select("__c", F.min("__r").over(before_cell).alias("__before"))
    inside = Window.partitionBy("__c").orderBy(f1).rowsBetween(Window.unboundedPreceding, -1)
    front = cells.join(F.broadcast(ranges), "__c").withColumn("__own", F.min("__m").over(inside))
    front = front.where((F.col("__before").isNull() | (F.col("__m") < F.col("__before"))) & (F.col("__own").isNull() | (F.col("__m") < F.col("__own"))))
    return rows.join(front.select(F.col(f1), F.col("__m").alias(f2)), [f1, f2], "left_semi")


def change_ratios(log: DataFrame) -> DataFrame:
    """``gen, coverage`` with ``change_ratio``, 1 minus the coverage over the generation before; null for the first."""
    before = F.lag("coverage").over(Window.orderBy("gen"))
    return log.withColumn("change_ratio", 1 - F.col("coverage") / before)
