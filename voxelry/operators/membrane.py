"""Detecting membrane-like places in a volume."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.functions.columns import orients_absdiff
from voxelry.operators import image, vote
from voxelry.storage import cut

ZYX = ["z", "y", "x"]


def _filled(shape_of: DataFrame, pixels: DataFrame, value: str = "v") -> DataFrame:
    """A dense image over the places of ``shape_of``: 1 where ``pixels`` has a row."""
    return shape_of.select(*ZYX).join(pixels.select(*ZYX, F.lit(1.0).alias(value)), ZYX, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def suppress_by_orientation(pixels: DataFrame, sigma: float, shape: tuple[int, int], most: float = math.pi / 4) -> DataFrame:
    """Places (``z, y, x, o``) whose orientation a strong vote of all changes by less than ``most``."""
    votes = vote.vote(pixels.withColumn("s", F.lit(1.0)), sigma, shape).select(*ZYX, F.col("o").alias("__o"))
    return pixels.join(votes, ZYX).where(orients_absdiff(F.col("o"), F.col("__o")) < most).drop("__o")


def detect(voxels: DataFrame, guide: DataFrame, bound: DataFrame, shape: tuple[int, int], sigma_smooth: float, sigma_vote: float, factor_filter: float = 3.0, factor_suppress: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Detected places ``z, y, x, o`` and those before the last filters, of a dense volume with dark membranes.

    Smoothed ridges of the negated, standardised volume are thinned, vote, are thinned again within the bound, and in
    each slice the strongest stay; those turned otherwise than their surroundings leave.
    """
    standard = image.scale_zscore(voxels.select(*ZYX, (-F.col("v")).alias("v")))
    ridges = cut(image.ridge3d(standard, sigma_smooth))
    inside = bound.select(*ZYX).distinct()
    thin = image.non_maximum_suppression(ridges).join(inside, ZYX, "left_semi")
    votes = cut(vote.vote(ridges.select(*ZYX, "o").join(thin, ZYX).withColumn("s", F.lit(1.0)), sigma_vote, shape))
    thinner = image.non_maximum_suppression(votes).join(inside, ZYX, "left_semi")
    strength = ridges.select(*ZYX, F.col("s").alias("__s")).join(votes, ZYX).select(*ZYX, (F.col("__s") * F.col("s")).alias("v"))
    first = cut(strength.join(thinner, ZYX, "left_semi"))
    strong = image.slice_value_filter(first, guide, factor_filter)
    turned = image.ridge(_filled(ridges, strong), sigma_smooth).select(*ZYX, "o").join(strong.select(*ZYX), ZYX, "left_semi")
    per_slice = guide.agg(F.count("*") / F.count_distinct("z")).first()[0] or 1.0
    return suppress_by_orientation(turned, max(factor_suppress * per_slice, 1.0), shape), first.select(*ZYX)
