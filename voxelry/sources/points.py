"""Annotated points as text: object, contour, x, y, z in columns, one point a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelry.operators.contour import split_at_gaps


def read_points(spark: SparkSession, path: str, z_type: str = "int") -> DataFrame:
    """``object, contour, x, y, z``; a line that has not five columns is an error."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    ok = F.when(F.size("p") == 5, F.col("p")).otherwise(F.raise_error(F.lit("a line of points needs five columns")).cast("array<string>"))
    p = lines.select(ok.alias("p"))
    at = lambda k: F.get("p", F.lit(k)).cast("double")
    return p.select(at(0).cast("int").alias("object"), at(1).cast("int").alias("contour"), at(2).alias("x"), at(3).alias("y"), at(4).cast(z_type).alias("z"))


def write_points(model: DataFrame, path: str) -> None:
    """Writes ``object, contour, x, y, z`` as lines; an empty model is an error."""
    if model.isEmpty():
        raise ValueError("the model has no points")
    lines = model.select(F.format_string("%d %d %.2f %.2f %.2f", F.col("object").cast("int"), F.col("contour").cast("int"), *(F.col(c).cast("double") for c in ("x", "y", "z"))).alias("value"))
    lines.write.mode("overwrite").text(path)


def clouds_to_model(clouds: DataFrame, break_contour: float | None = None) -> DataFrame:
    """A model of clouds (``object, idx, z, y, x``): a contour for each slice, split at gaps wider than ``break_contour``."""
    most = float("inf") if break_contour is None else break_contour
    return split_at_gaps(clouds, most).select("object", F.col("contour").cast("int").alias("contour"), *(F.col(c).cast("double").alias(c) for c in "xy"), "z", "idx")


def number_objects(clouds: DataFrame, by: str = "label") -> DataFrame:
    """Clouds with ``object``, the number of their label from 1."""
    names = clouds.select(by).distinct().withColumn("object", F.row_number().over(Window.orderBy(by)))
    return clouds.join(F.broadcast(names), by)
