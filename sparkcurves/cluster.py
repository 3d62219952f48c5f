"""What a job needs to know of the cluster it runs on."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def partition_count(spark: SparkSession) -> int:
    """Shuffle partitions as configured, but never fewer than the cluster has cores."""
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, spark.sparkContext.defaultParallelism)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint location, or in the warehouse where none is set.

    The folder goes when the driver's Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stored"
    folder = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    """Best effort: a session that is already stopped leaves its folders to their owner."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def landed(df: DataFrame) -> DataFrame:
    """Write a frame to shared storage and read it back.

    For results that several later steps use: they are computed once, survive the loss of
    executors, and come back with a known size, so that joins can be chosen by it.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
