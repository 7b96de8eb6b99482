"""The folder that a cluster's driver and executors share."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a session on one machine (tests) gets its own, on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _gone_at_exit(spark: SparkSession, path: str):
    """The path's file system, which deletes the path, if it is there by now, when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(at)
    return files


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there.  The files go when the application ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _gone_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_once(spark: SparkSession, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What `build` gives, written when this application first asks for the key and read from then on.

    The files go when the application ends.
    """
    path = f"{shared_dir(spark)}/once-{spark.sparkContext.applicationId}-{hashlib.sha256(key.encode()).hexdigest()[:24]}"
    files = _gone_at_exit(spark, path)
    if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
        _gone_at_exit(spark, path)
    return spark.read.parquet(path)


def dealt_once(spark: SparkSession, key: str, build: Callable[[int], DataFrame], n: Callable[[], int]) -> DataFrame:
    """What `build` gives when it is told n, written when this application first asks for the key: in n buckets by its column `root`, sorted by it.

    Joins, groups and windows by `root`, or by it and more, of tables with equally many buckets need no shuffle.
    `build` is to deal its rows over n partitions by `root`.  The files go when the application ends.
    """
    told = hashlib.sha256(f"{spark.sparkContext.applicationId} {key}".encode()).hexdigest()[:24]
    name, path = f"default.dealt_{told}", f"{shared_dir(spark)}/dealt-{told}"
    if not spark.catalog.tableExists(name):
        many = n()
        _gone_at_exit(spark, path)
        build(many).write.mode("overwrite").option("path", path).bucketBy(many, "root").sortBy("root").saveAsTable(name, format="parquet")
        _gone_at_exit(spark, path)
    return spark.table(name)
