"""What the blocks of a page tell: where questions begin, how far they reach, and what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequences as seq

#: First lines of blocks that begin something, and of those that only go on with a list.
MAIN = r"^\s*(\d{1,2})\.\s+\S"
SUB = r"^\s*(\d{1,2}(?:\.\d+)+)\.\s+\S"
GROUP = r"(?i)^\s*Grupo\s+([IVX]+)\b"
ITEM = r"(?i)^\s*Item\s+(\d+)\b"
LISTED = r"^\s*[1-5]\.\s+[\p{L}\p{N}_]{2,15}\s*$"
#: The highest number of a question, the least length of a block, and the points around a region.
MOST_NUMBER, LEAST_LENGTH, GAP, SLACK = 30, 4, 2, 5
#: Height of a strip of a page: blocks and regions meet by strips, of which the outermost take all beyond.
STRIP, STRIPS = 64, 64


def _part(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def anchors(blocks: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """(root, page, pos, y0, number, method): the blocks that begin a question, a part of one, a group or an item.

    Only a block's first line counts.  Blocks under four characters, lines of lists inside a statement (`2. igual`),
    numbers above 30 and blocks of skipped(root, page) begin nothing, nor do blocks that are no text or have none.
    """
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    df = blocks.filter("type = 'text' AND text IS NOT NULL").withColumn("__t", text).filter(F.length("__t") >= LEAST_LENGTH)
    if skipped is not None:
        df = df.join(skipped.select("root", "page").distinct(), ["root", "page"], "left_anti")
    line = F.when(F.col("__t").contains("\n"), F.trim(F.substring_index("__t", "\n", 1))).otherwise(F.left("__t", F.lit(80)))
    df = df.withColumn("__l", line).filter(~F.col("__l").rlike(LISTED))
    sub, main, group, item = (_part(F.col("__l"), p) for p in (SUB, MAIN, GROUP, ITEM))
    found = (
        F.when(sub.isNotNull(), F.struct(sub.alias("number"), F.lit("sub_question").alias("method")))
        .when(main.isNotNull(), F.struct(F.when(main.cast("int") <= MOST_NUMBER, main).alias("number"), F.lit("main_question").alias("method")))
        .when(group.isNotNull(), F.struct(F.concat(F.lit("Grupo "), group).alias("number"), F.lit("group").alias("method")))
        .when(item.isNotNull(), F.struct(F.concat(F.lit("Item "), item).alias("number"), F.lit("item").alias("method")))
    )
    return df.withColumn("__f", found).filter("__f.number IS NOT NULL").select("root", "page", "pos", "y0", "__f.number", "__f.method")


def _strip(y: Column) -> Column:
    return F.greatest(F.lit(-1), F.least(F.lit(STRIPS), F.floor(y / STRIP))).cast("int")


def blocks_of_regions(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(root, page, pos, block_ids): blocks that begin from SLACK above y0 to above y1 of a region, in their order.

    Regions are dealt over the strips they cover and meet only the blocks of those.
    """
    over = regions.filter(F.col("y1") > F.col("y0") - SLACK).select("root", "page", "pos", "y0", "y1", F.explode(F.sequence(_strip(F.col("y0") - SLACK), _strip(F.col("y1")))).alias("strip"))
    inside = blocks.select("root", "page", F.col("pos").alias("id"), F.col("y0").alias("y"), _strip(F.col("y0")).alias("strip"))
    met = over.join(inside, ["root", "page", "strip"]).filter(F.col("y").between(F.col("y0") - SLACK, F.col("y1")) & (F.col("y") < F.col("y1")))
    return met.groupBy("root", "page", "pos").agg(F.array_sort(F.collect_list("id")).alias("block_ids"))


def segments(blocks: DataFrame, heights: DataFrame, skipped: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Questions that blocks(root, page, pos, type, y0, text) begin, and numbers that come again.

    The first table: root, page, pos, scope (the group in force), number, method, y0, y1 (above the next beginning on
    the page, else the height of the page in heights(root, page, height)), block_ids, confidence, parent, is_group.
    The second: root, page, scope, number of beginnings whose number its scope already has; these end the region of
    the one before, but have none.  pos orders the blocks of a page; pages not in heights have no regions.
    """
    df = seq.carry_forward(anchors(blocks, skipped), ["root"], ["page", "pos"], F.when(F.col("method") == "group", F.col("number")), "scope")
    after = F.lead("y0").over(Window.partitionBy("root", "page").orderBy("pos"))
    again = F.row_number().over(Window.partitionBy("root", "scope", "number").orderBy("page", "pos"))
    df = df.withColumn("after", after).withColumn("again", again)
    first = df.filter("again = 1").join(heights.select("root", "page", "height"), ["root", "page"]).withColumn("y1", F.coalesce(F.col("after") - GAP, F.col("height")))
    held = blocks_of_regions(first, blocks)
    sure = F.when(F.col("method").isin("main_question", "sub_question"), 0.92).otherwise(0.85)
    parent = F.when(F.col("method") == "sub_question", F.regexp_replace("number", r"\.\d+$", ""))
    out = first.join(held, ["root", "page", "pos"], "left").select(
        "root", "page", "pos", "scope", "number", "method", "y0", "y1", F.coalesce("block_ids", F.array().cast("array<bigint>")).alias("block_ids"),
        sure.alias("confidence"), parent.alias("parent"), (F.col("method") == "group").alias("is_group"),
    )
    return out, df.filter("again > 1").select("root", "page", "scope", "number")


def question_regions(questions: DataFrame, blocks: DataFrame, default: float = 842.0, least: float = 180.0) -> DataFrame:
    """(root, ord, page, y0, y1) of questions(root, ord, number, page) whose number begins a block of their page.

    The first such block counts.  A region ends where the page's next one begins, else at the lowest block's end (or
    `default`); one that would be empty gets `least` points, as far as the page goes.  Numbers hold no white space.
    """
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    starts = blocks.withColumn("number", _part(text, r"^(\S+)\.\s+\S")).filter("number IS NOT NULL").groupBy("root", "page", "number").agg(F.min_by("y0", "pos").alias("y0"))
    bottoms = blocks.groupBy("root", "page").agg(F.max(F.col("y0") + F.col("height")).alias("low")).select("root", "page", F.when(F.col("low") > 0, F.col("low")).otherwise(default).alias("bottom"))
    df = questions.filter("number <> ''").join(starts, ["root", "page", "number"]).join(bottoms, ["root", "page"])
    end = F.coalesce(F.lead("y0").over(Window.partitionBy("root", "page").orderBy("y0", "ord")), F.col("bottom"))
    df = df.withColumn("end", end).withColumn("y1", F.when(F.col("end") <= F.col("y0"), F.least("bottom", F.col("y0") + least)).otherwise(F.col("end")))
    return df.select("root", "ord", "page", F.round("y0", 2).alias("y0"), F.round("y1", 2).alias("y1"))
