"""States of the programs: a folder with one table for each step, and the arguments as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def backup(spark: SparkSession, path: str) -> None:
    """Renames a state that is there to ``path~``; an older one of that name goes."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    here, there = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}~"))
    fs = here.getFileSystem(conf)
    if fs.exists(here):
        fs.delete(there, True)
        fs.rename(here, there)


def save(spark: SparkSession, path: str, args: dict, steps: dict[str, DataFrame]) -> None:
    """Writes the arguments and each step's table; steps written before stay unless given again."""
    spark.range(1).select(F.lit(json.dumps(args, sort_keys=True)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/args")
    for name, df in steps.items():
        df.write.mode("overwrite").parquet(f"{path}/steps/{name}")


def load_args(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/args").first()["value"])


def load_step(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/steps/{name}")
