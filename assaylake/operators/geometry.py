"""Boxes on pages, as arithmetic on columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip(df: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes cut to the page."""
    zero = F.lit(0).cast("bigint")
    return df.withColumns({"x0": F.greatest("x0", zero), "y0": F.greatest("y0", zero), "x1": F.least("x1", F.lit(width).cast("bigint")), "y1": F.least("y1", F.lit(height).cast("bigint"))})


def area() -> Column:
    return F.greatest(F.col("x1") - F.col("x0"), F.lit(0)) * F.greatest(F.col("y1") - F.col("y0"), F.lit(0))


def from_percent(df: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes in percent of the page (x_pct, y_pct, w_pct, h_pct) as points."""
    return df.withColumns({"x0": F.col("x_pct") * width / 100, "y0": F.col("y_pct") * height / 100, "x1": (F.col("x_pct") + F.col("w_pct")) * width / 100, "y1": (F.col("y_pct") + F.col("h_pct")) * height / 100})


def reading_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """reading_order: place on the page by y0, then x0, then order."""
    return df.withColumn("reading_order", F.row_number().over(Window.partitionBy(*keys).orderBy("y0", "x0", *order)).cast("bigint"))


def best_crop(df: DataFrame, paddings: list[int], width: int, height: int) -> DataFrame:
    """(id, pad, score): the padding whose crop has most area after a cost that grows with its square; ties: the least."""
    pads = df.withColumn("pad", F.explode(F.array(*(F.lit(p).cast("bigint") for p in paddings))))
    moved = pads.withColumns({"x0": F.col("x0") - F.col("pad"), "y0": F.col("y0") - F.col("pad"), "x1": F.col("x1") + F.col("pad"), "y1": F.col("y1") + F.col("pad")})
    scored = clip(moved, width, height).withColumn("score", (area() - F.col("pad") * F.col("pad") * 10).cast("bigint"))
    best = scored.groupBy("id").agg(F.max(F.struct("score", (-F.col("pad")).alias("least"))).alias("m"))
    return best.select("id", (-F.col("m.least")).cast("bigint").alias("pad"), F.col("m.score").alias("score"))
