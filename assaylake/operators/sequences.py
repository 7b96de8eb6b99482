"""Operators over ordered rows: carried headers, gaps, runs, regions, look-ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import span


def carry_forward(df: DataFrame, keys: list[str], order: list[str], header: Column, name: str, skip: Column | None = None) -> DataFrame:
    """The latest header up to each row; rows that `skip` holds for get none and pass none on."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = header if skip is None else F.when(~skip, header)
    carried = F.last(seen, ignorenulls=True).over(w)
    return df.withColumn(name, carried if skip is None else F.when(~skip, carried))


def regions(df: DataFrame, keys: list[str], order: list[str], start: str, bottom: Column, least: int) -> DataFrame:
    """region_end: the next row's start, else the bottom; `least` below the start where that is no region."""
    w = Window.partitionBy(*keys).orderBy(*order)
    end = F.coalesce(F.lead(start).over(w), bottom)
    return df.withColumn("region_end", F.when(end <= F.col(start), F.col(start) + least).otherwise(end))


def runs(df: DataFrame, keys: list[str], order: list[str], restart: Column, name: str = "run") -> DataFrame:
    """Numbers runs of rows from 1; `restart` (may use lag over the same order) begins a new one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__new", F.coalesce(restart.cast("int"), F.lit(1))).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("__new")


def not_above_previous(number: str, keys: list[str], order: list[str]) -> Column:
    """Null on the first row, true where the number is no higher than the one before."""
    return F.col(number) <= F.lag(number).over(Window.partitionBy(*keys).orderBy(*order))


def gaps(df: DataFrame, keys: list[str], number: str, low: int | None = 1, widest: int = 100_000) -> DataFrame:
    """Numbers missing between `low` (None: the smallest) and the largest, with the known ones around them.

    Known numbers are sorted within their key and each looks at the one before, so no list of a key's
    numbers is built.  Of a gap of more than `widest` numbers only the first and the last are given.
    """
    known = df.select(*keys, F.col(number).cast("bigint").alias("n")).filter("n is not null").distinct()
    w = Window.partitionBy(*keys).orderBy("n")
    before = F.lag("n").over(w)
    known = known.withColumn("prev", before if low is None else F.coalesce(before, F.lit(low - 1)))
    known = known.filter("n - prev > 1")
    out = known.withColumn("missing", F.explode(span(F.col("prev") + 1, F.col("n") - 1, widest)))
    prev = F.col("prev") if low is None else F.when(F.col("prev") >= low, F.col("prev"))
    return out.select(*keys, "missing", prev.alias("prev_known"), F.col("n").alias("next_known"))


def known_around(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """prev_known and next_known: the nearest non-null values before and after each row."""
    # both frames grow by one row at a time; a frame that shrinks would be gone through anew for each row
    before = lambda *by: F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("prev_known", before(*order)).withColumn("next_known", before(*(F.col(c).desc() for c in order)))


def look_ahead(df: DataFrame, keys: list[str], order: list[str], value: Column, stop: Column, rows: int, name: str) -> DataFrame:
    """The first non-null value within the next rows, unless a row that `stop` holds for comes first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, rows)
    coming = F.collect_list(F.struct(value.alias("v"), F.coalesce(stop, F.lit(False)).alias("s"))).over(w)
    # at most `rows` elements
    state = F.aggregate(
        coming,
        F.struct(F.lit(None).cast("bigint").alias("v"), F.lit(False).alias("done")),
        lambda a, x: F.when(a["done"], a).otherwise(F.struct(F.when(~x["s"], x["v"]).cast("bigint").alias("v"), (x["s"] | x["v"].isNotNull()).alias("done"))),
    )
    return df.withColumn(name, state["v"])


def letters(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "letter") -> DataFrame:
    """a, b, c ... by position within the key; after z the place itself."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, F.when(rn <= 26, F.chr(F.lit(96) + rn)).otherwise(rn.cast("string")))


def tail_from(df: DataFrame, keys: list[str], position: str, marker: Column, more_than: int) -> DataFrame:
    """Drops rows from the first marked position on in keys of more than so many rows.

    The first marks are found by a grouping of their own, so a long key is no window.
    """
    marks = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(F.when(marker, F.col(position))).alias("__cut"))
    out = df.join(marks, keys)
    return out.filter((F.col("__n") <= more_than) | F.col("__cut").isNull() | (F.col(position) < F.col("__cut"))).drop("__n", "__cut")


def section_bounds(df: DataFrame, keys: list[str], position: str, section: Column) -> DataFrame:
    """(keys, section, first_position, end_position): each section from its first row to the next section's (null: the last)."""
    found = df.withColumn("section", section).filter("section is not null").groupBy(*keys, "section").agg(F.min(position).alias("first_position"))
    w = Window.partitionBy(*keys).orderBy("first_position", "section")
    return found.withColumn("end_position", F.lead("first_position").over(w))


def without_subtotals(values: Column) -> Column:
    """An array without last values that equal the sum of those before, again and again.

    [10, 10, 10, 30] -> [10, 10, 10]; a second equal value counts as a subtotal, too: [5, 5] -> [5].
    """
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    step = lambda a, _: F.when((F.size(a) > 1) & (F.element_at(a, -1) * 2 == total(a)), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)
    return F.aggregate(values, values, step)
