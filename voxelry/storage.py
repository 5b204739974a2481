"""Places that the driver and all executors share, and cutting lineage there."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder of this process's tables, in the shared one; it is deleted when the process ends, if Spark still runs.
_RUN = f"voxelry-{uuid.uuid4().hex}"
_open: dict[str, tuple[SparkSession, str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _closed() -> None:
    for spark, path in _open.values():
        with contextlib.suppress(Exception):  # a stopped session has nothing to delete with
            _delete(spark, path)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all runs on one machine, a new local one.

    On a cluster, executors cannot read a local folder of the driver, so an unset folder is an error there.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="voxelry-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def new_folder(spark: SparkSession) -> str:
    """The name of a new folder in the shared one, deleted with this process's tables."""
    if not _open:
        atexit.register(_closed)
    path = f"{shared_dir(spark)}/{_RUN}/{uuid.uuid4().hex}"
    _open[spark.sparkContext.applicationId] = spark, path.rpartition("/")[0]
    return path


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder as Parquet and returns the table read back.

    The result has no lineage before the written files, so a lost executor costs no recomputation of what led here.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_buckets(df: DataFrame, *keys: str) -> DataFrame:
    """As :func:`cut`, with the rows bucketed by ``keys``: joins and groups by these keys don't shuffle the table again."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    name = f"voxelry_{path.rpartition('/')[2]}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt as the buckets are, so that a task writes its own buckets only.
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables made by :func:`cut`, when nothing reads them any more."""
    for table in tables:
        for path in {name.rpartition("/")[0] for name in table.inputFiles()}:
            _delete(table.sparkSession, path)
