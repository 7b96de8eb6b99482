"""Grading criteria to questions: by number, by points that only one has, by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sort_key


def tidy(number: Column) -> Column:
    """A number without blanks around it and dots after it."""
    return F.rtrim(F.trim(F.coalesce(number, F.lit(""))), F.lit("."))


def match_criteria(items: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items(root, ord, group_id, number, points), questions(root, ord, question_id, group_id, number, points).

    Question ids are unique within an exam, and so are the items' places.  Three passes, each windows over items and questions together,
    so that both are read once:

    exact: an item takes the last question of its group and number; several items may share one.
    points: of a group's items of some points (null is a value here) the first takes the group's only free question
    of these points, if there is exactly one.  Whoever comes later finds it taken.
    positional: if a group's free items and questions are equally many, the items' numbers all flat and the questions'
    all decimal or all flat, they pair up in natural order.

    Gives the items with question_id, match (null if there is none) and needs_review, and the questions that none took.
    """
    none = F.lit(None).cast(questions.schema["question_id"].dataType)
    root = F.col("root").alias("root")  # a column of this name on both sides, without its table: the union then lies as they do
    i = items.select(root, "ord", "group_id", "number", "points", none.alias("question_id"), F.col("group_id").alias("gid"), F.lit(True).alias("item"))
    q = questions.select(root, "ord", "group_id", "number", "points", "question_id", F.lower(F.trim(F.coalesce("group_id", F.lit("")))).alias("gid"), F.lit(False).alias("item"))
    df = i.unionByName(q).withColumn("no", tidy(F.col("number")))
    item, known = F.col("item"), F.col("root").isNotNull()

    same_no = Window.partitionBy("root", "gid", "no")
    df = df.withColumn("last", F.max(F.when(~item & (F.col("no") != ""), F.struct("ord", "question_id"))).over(same_no)).withColumn("asked", F.max(item).over(same_no))
    df = df.withColumn("exact", F.when(item & known, F.col("last.question_id")))
    taken = known & F.col("asked") & F.coalesce(F.col("question_id") == F.col("last.question_id"), F.lit(False))
    df = df.withColumn("free", F.when(item, F.col("exact").isNull()).otherwise(~taken))

    same_points = Window.partitionBy("root", "gid", "points")
    free_q, free_i = ~item & F.col("free"), item & F.col("free")
    df = df.withColumn("many", F.count(F.when(free_q, 1)).over(same_points)).withColumn("only", F.min(F.when(free_q, F.col("question_id"))).over(same_points)).withColumn("first", F.min(F.when(free_i, F.col("ord"))).over(same_points))
    single = known & F.col("free") & (F.col("many") == 1)
    df = df.withColumn("by_points", F.when(single & item & (F.col("ord") == F.col("first")), F.col("only")))
    met = single & ~item & F.col("first").isNotNull() & F.col("question_id").isNotNull()
    df = df.withColumn("rest", F.when(item, F.col("free") & F.col("by_points").isNull()).otherwise(F.col("free") & ~met))

    flat, decimal = F.col("no").rlike(r"^\d+$"), F.col("no").rlike(r"^\d+\.\d+")
    rest_i, rest_q = item & F.col("rest"), ~item & F.col("rest")
    in_group, in_order = Window.partitionBy("root", "gid"), Window.partitionBy("root", "gid", "item", "rest").orderBy("key", "ord")
    all_of = lambda which, what: F.coalesce(F.min(F.when(which, what)).over(in_group), F.lit(False))
    df = df.withColumn("key", F.when(F.col("rest"), sort_key(F.col("no")))).withColumn("place", F.row_number().over(in_order))
    fit = all_of(rest_i, flat) & (all_of(rest_q, flat) | all_of(rest_q, decimal)) & (F.count(F.when(rest_i, 1)).over(in_group) == F.count(F.when(rest_q, 1)).over(in_group))
    df = df.withColumn("fit", fit & F.col("rest") & known)
    df = df.withColumn("paired", F.max(F.when(~item & F.col("fit"), F.col("question_id"))).over(Window.partitionBy("root", "gid", "fit", "place")))
    df = df.withColumn("by_place", F.when(item & F.col("fit"), F.col("paired")))

    match = F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_points").isNotNull(), "points").when(F.col("by_place").isNotNull(), "positional")
    out = df.filter("item").select("root", "ord", "group_id", "number", F.coalesce("exact", "by_points", "by_place").alias("question_id"), match.alias("match"), (F.coalesce("exact", "by_points").isNull()).alias("needs_review"))
    left = df.filter(rest_q & ~(F.col("fit") & F.col("question_id").isNotNull()))
    return out, left.select("root", "question_id")


def unique_by_points(items: DataFrame, questions: DataFrame, keys: list[str], points: str) -> DataFrame:
    """Pairs of an item and a question that each are the only ones of their points in the key: the order-free part."""
    one = lambda df, name: df.groupBy(*keys, points).agg(F.count("*").alias("__n"), F.min(name).alias(name)).filter("__n = 1").drop("__n")
    return one(items, "item_id").join(one(questions, "question_id"), [*keys, points])
