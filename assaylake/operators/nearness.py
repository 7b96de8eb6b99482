"""What stands near what on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far above a label an image may end, how far below its top it may begin, and how far their centres
#: may be apart, as a share of the page's width.
ABOVE, BELOW, ASIDE = 80.0, 20.0, 0.4
#: Labels of options that all have to be there, and how far apart those of a row may be.
LETTERS, ROW = "ABCD", 45.0
#: Height of a cell of the grid; what lies beyond the last cells is taken to them.
CELL, CELLS = 100.0, 64


def _cell(y: Column) -> Column:
    return F.greatest(F.lit(-1), F.least(F.lit(CELLS), F.floor(y / CELL))).cast("int")


def images_of_labels(labels: DataFrame, images: DataFrame, widths: DataFrame) -> DataFrame:
    """(root, page, label_id, asset_id): the first image that stands beside or above each label.

    labels(root, page, label_id, x0, x1, y0), images(root, page, pos, asset_id, x, y, width, height), widths(root, page, width).
    An image ends at most 80 points above a label's top and begins less than 20 below it, and their centres are less than 40 %
    of the page's width apart.  Both are dealt over a grid of cells, as wide as that and 100 points high, and a label
    meets only images of its own and neighbouring cells; the first by pos counts.
    """
    reach = F.col("width") * ASIDE
    wide = widths.select("root", "page", reach.alias("reach")).filter("reach > 0")
    column = lambda x: F.greatest(F.lit(-1), F.least(F.lit(8), F.floor(x / F.col("reach")))).cast("int")
    a = labels.join(wide, ["root", "page"]).withColumn("lx", (F.col("x0") + F.col("x1")) / 2)
    a = a.withColumn("row", F.explode(F.sequence(_cell(F.col("y0") - ABOVE), _cell(F.col("y0") + BELOW)))).withColumn("column", F.explode(F.sequence(column(F.col("lx")) - 1, column(F.col("lx")) + 1)))
    b = images.join(wide, ["root", "page"]).withColumn("ix", F.col("x") + F.col("width") / 2).withColumn("column", column(F.col("ix"))).filter("height >= 0")
    b = b.withColumn("row", F.explode(F.sequence(_cell(F.col("y")), _cell(F.col("y") + F.col("height"))))).select("root", "page", "pos", "asset_id", F.col("y").alias("top"), (F.col("y") + F.col("height")).alias("bottom"), "ix", "row", "column")
    met = a.join(b, ["root", "page", "row", "column"]).filter((F.col("bottom") >= F.col("y0") - ABOVE) & (F.col("top") < F.col("y0") + BELOW) & (F.abs(F.col("ix") - F.col("lx")) < F.col("reach")))
    return met.groupBy("root", "page", "label_id").agg(F.min(F.struct("pos", "asset_id")).alias("m")).select("root", "page", "label_id", "m.asset_id")


def label_rows(labels: DataFrame) -> DataFrame:
    """(root, ord, row, column, letter) of labels(root, ord, letter, x, y): how a question's option labels stand in rows.

    Of a letter's places the topmost counts, then the leftmost.  Down the page, a label opens a new row if it is
    45 points or more below the one that opened the row before.  Rows and columns are numbered from 1.  Questions
    without all four letters have no rows.
    """
    first = labels.filter(F.col("letter").isin(*LETTERS)).groupBy("root", "ord", "letter").agg(F.min(F.struct("y", "x")).alias("at"))
    held = first.groupBy("root", "ord").agg(F.array_sort(F.collect_list(F.struct("at.y", "at.x", "letter"))).alias("all")).filter(F.size("all") == len(LETTERS))
    # four labels, so the fold is short
    start = F.struct(F.lit(0).alias("row"), F.lit(None).cast("double").alias("top"), F.array().cast("array<struct<row:int,x:double,y:double,letter:string>>").alias("out"))

    def place(s: Column, v: Column) -> Column:
        new = s["top"].isNull() | (v["y"] - s["top"] >= ROW)
        row = F.when(new, s["row"] + 1).otherwise(s["row"])
        return F.struct(row.alias("row"), F.when(new, v["y"]).otherwise(s["top"]).alias("top"), F.array_append(s["out"], F.struct(row.alias("row"), v["x"].alias("x"), v["y"].alias("y"), v["letter"].alias("letter"))).alias("out"))

    rows = held.select("root", "ord", F.array_sort(F.aggregate("all", start, place)["out"]).alias("out"))
    column = lambda v, i: i - F.size(F.filter("out", lambda u: u["row"] < v["row"])) + 1
    return rows.select("root", "ord", F.inline(F.transform("out", lambda v, i: F.struct(v["row"].cast("bigint").alias("row"), column(v, i).cast("bigint").alias("column"), v["letter"].alias("letter")))))
