"""Duplicates: which row of a key stays, and which are reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def best_wins(df: DataFrame, keys: list[str], score: Column, order: list[str | Column]) -> DataFrame:
    """The row of the highest score of each key; ties: the first."""
    return first_wins(df.withColumn("__score", score), keys, [F.col("__score").desc(), *order]).drop("__score")


def repeats(df: DataFrame, keys: list[str], order: list[str | Column], first_of: str) -> DataFrame:
    """Second and later rows of each key, with `first_of` of the first as first_<name> and their place as nth."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("nth", F.row_number().over(w).cast("bigint")).withColumn(f"first_{first_of}", F.first(first_of).over(w))
    return out.filter("nth > 1")


def unique_ids(df: DataFrame, id_col: str, order: list[str | Column], suffix: Column) -> DataFrame:
    """Ids that repeat get the suffix and their place, from the second row on."""
    w = Window.partitionBy(id_col).orderBy(*order)
    nth = F.row_number().over(w)
    return df.withColumn("new_id", F.when(nth == 1, F.col(id_col).cast("string")).otherwise(F.concat(F.col(id_col).cast("string"), suffix, nth.cast("string"))))


def repeated_content(df: DataFrame, keys: list[str], content: str, id_col: str) -> DataFrame:
    """Contents that occur more than once within a key: digest, number and smallest id."""
    return df.filter(F.col(content).isNotNull()).groupBy(*keys, F.sha2(content, 256).alias("digest")).agg(F.count("*").alias("copies"), F.min(id_col).alias("first_id")).filter("copies > 1")
