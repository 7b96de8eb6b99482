"""Queries by name, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def joins_by_measured_size(spark: SparkSession) -> None:
    """Broadcast what turned out small while the query ran, not what its files promise.

    Files of exam tables are some fifty times smaller than their rows in memory: few values, many times.  A broadcast
    planned by the size of files sends millions of rows through the driver.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")


def compiled_stages(spark: SparkSession) -> None:
    """Stages whose generated method is over 8000 bytes of code run step by step: Java never compiles such a method, which made it the slowest way.

    Rules and model tables are wide rows of many expressions; step by step, each is a method of its own.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            joins_by_measured_size(spark)
            compiled_stages(spark)
            spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")  # the exam model lifts it for its own queries
            return f(spark, d)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return add
