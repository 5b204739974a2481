"""Column functions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def orients_absdiff(a: Column, b: Column) -> Column:
    """The angle between two orientations, between 0 and pi / 2."""
    d = F.pmod(b - a, F.lit(math.pi))
    return F.least(d, F.lit(math.pi) - d)


def half_even(c: Column) -> Column:
    """Rounds to the nearest integer, halves to the even one."""
    return F.rint(c.cast("double")).cast("int")


def distance2(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """The squared distance of two points."""
    total = F.lit(0)
    for p, q in zip(a, b, strict=True):
        total = total + (p - q) * (p - q)
    return total


def norm(*c: Column) -> Column:
    total = F.lit(0.0)
    for x in c:
        total = total + x * x
    return F.sqrt(total)


def cross(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """The cross product of two vectors, in the same order of axes."""
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def neighbour_weight(d_orient: Column, sigma: float = math.pi / 4) -> Column:
    """The weight of an edge between points whose orientations differ by ``d_orient``."""
    return F.exp(-0.5 * F.pow(d_orient / sigma, F.lit(2)))


def gaussian_pdf(x: Column, mean: float, sigma: float) -> Column:
    return F.exp(-0.5 * F.pow((x - mean) / sigma, F.lit(2))) / (sigma * math.sqrt(2 * math.pi))
