"""Catalogue of jobs: latest states, days, key figures, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: list[str | Column], take: list[str]) -> DataFrame:
    """The last row of each key, by a struct maximum: added up before it moves, so a busy key is no burden."""
    out = df.groupBy(key).agg(F.max(F.struct(*order, *take)).alias("__m"))
    return out.select(key, *(F.col("__m")[c].alias(c) for c in take))


def mean_positive(value: Column) -> Column:
    """Mean of the values above 0."""
    return F.avg(F.when(value > 0, value))


def searched(df: DataFrame, text: str, words: str, equal: dict[str, object]) -> DataFrame:
    """Rows whose columns equal what is given and whose text holds the words in any case."""
    cond = F.lower(text).contains(words.lower())
    for name, value in equal.items():
        cond = cond & (F.col(name) == value)
    return df.filter(cond)


def grouped_warnings(df: DataFrame, kind: str, severity_rank: Column, message: Column, order: list[str]) -> DataFrame:
    """Per kind: rows, first severity, first non-empty message; the gravest and most frequent first."""
    first = lambda c: F.min(F.when(c.isNotNull() & (c.cast("string") != ""), F.struct(*order, c.alias("x"))))["x"]
    return df.groupBy(kind).agg(F.count("*").alias("n"), first(severity_rank).alias("severity_rank"), first(message).alias("sample")).orderBy("severity_rank", F.col("n").desc(), kind)


def token_usage(df: DataFrame, key: str, model: str, counters: list[str]) -> DataFrame:
    """Calls, sums of counters and the sorted distinct models of each key."""
    return df.groupBy(key).agg(F.count("*").alias("calls"), *(F.sum(c).cast("bigint").alias(c) for c in counters), F.array_join(F.sort_array(F.collect_set(model)), ",").alias("models"))
