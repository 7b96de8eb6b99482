"""Points: totals, pools, remainders and their distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(df: DataFrame, keys: list[str], points: str = "points") -> DataFrame:
    """Sum, rows, and rows without points (null or 0) of each key."""
    return df.groupBy(*keys).agg(F.sum(F.coalesce(points, F.lit(0))).cast("bigint").alias("total"), F.count("*").alias("n"), F.count_if(F.coalesce(points, F.lit(0)) == 0).alias("missing"))


def largest_remainder(df: DataFrame, keys: list[str], weight: str, total: Column, order: list[str], name: str = "share") -> DataFrame:
    """Points of each key rescaled to its total, in proportion, so that they add up to it.

    Each row is given one point; the rest of the total is shared out by weight, rounded down, and what is then left
    goes by largest fraction, then order.  A key keeps its weights (null as 0) where there is no total, where they
    add up to it or to nothing, or to less than two fifths or more than five times of it, or where it has fewer points than rows.
    """
    whole = Window.partitionBy(*keys)
    own = F.greatest(F.coalesce(weight, F.lit(0)), F.lit(0))
    df = df.withColumn("__w", own.cast("bigint")).withColumn("__sum", F.sum("__w").over(whole)).withColumn("__n", F.count("*").over(whole)).withColumn("__total", total)
    raw = (F.col("__total") - F.col("__n")) * F.col("__w") / F.col("__sum")
    df = df.withColumn("__raw", F.when(F.col("__sum") > 0, raw)).withColumn("__low", F.floor("__raw"))
    ranked = whole.orderBy((F.col("__raw") - F.col("__low")).desc(), *order)
    df = df.withColumn("__left", F.col("__total") - F.col("__n") - F.sum("__low").over(whole)).withColumn("__rank", F.row_number().over(ranked))
    fits = (F.col("__sum") != F.col("__total")) & (F.col("__sum") > 0) & (F.col("__sum") >= F.col("__total") * 0.4) & (F.col("__sum") <= F.col("__total") * 5) & (F.col("__total") >= F.col("__n"))
    share = F.when(fits, 1 + F.col("__low") + (F.col("__rank") <= F.col("__left")).cast("bigint")).otherwise(F.col("__w"))
    return df.withColumn(name, share.cast("bigint")).drop("__w", "__sum", "__n", "__total", "__raw", "__low", "__left", "__rank")


def era_total(year: Column, group: Column) -> Column:
    """Official points of a group of the Portuguese exam; null where its year has no fixed split."""
    # Points of the groups by years.
    eras = [((2008, 2017), {"grupo_i": 100, "grupo_ii": 50, "grupo_iii": 50}), ((2018, 2019), {"grupo_i": 104, "grupo_ii": 56, "grupo_iii": 40})]
    return F.coalesce(*(F.when(year.between(*years) & (group == name), F.lit(points)) for years, groups in eras for name, points in groups.items()))


def optional_pool(df: DataFrame, keys: list[str], optional: Column, target: int, points: str = "points") -> DataFrame:
    """Mandatory and optional subtotals, and how many optional rows count: what the target leaves, by the pool's points each.

    points_each is null unless all optional rows have the same points; choose is null unless it divides.
    """
    out = df.groupBy(*keys).agg(
        F.sum(F.when(~optional, F.col(points)).otherwise(0)).cast("bigint").alias("mandatory"),
        F.sum(F.when(optional, F.col(points)).otherwise(0)).cast("bigint").alias("optional"),
        F.count_if(optional).alias("pool_size"),
        F.when(F.min(F.when(optional, F.col(points))) == F.max(F.when(optional, F.col(points))), F.min(F.when(optional, F.col(points)))).cast("bigint").alias("points_each"),
    )
    rest = F.lit(target) - F.col("mandatory")
    fits = F.col("points_each").isNotNull() & (F.col("points_each") > 0) & (rest > 0)
    return out.withColumn("choose", F.when(fits & (F.expr(f"({target} - mandatory) % nullif(points_each, 0)") == 0), F.expr(f"({target} - mandatory) div nullif(points_each, 0)")).cast("bigint"))


def remainder(df: DataFrame, keys: list[str], total: int, points: str = "points", name: str = "remainder") -> DataFrame:
    """What the other rows of the key leave of the total."""
    others = F.sum(F.coalesce(points, F.lit(0))).over(Window.partitionBy(*keys)) - F.coalesce(points, F.lit(0))
    return df.withColumn(name, (F.lit(total) - others).cast("bigint"))


def roll_up(parents: DataFrame, children: DataFrame, key: str, own: str) -> DataFrame:
    """Parents' points: their own, else the sum of their children's; and whether all or any child is flagged."""
    sums = children.groupBy(key).agg(F.sum("points").cast("bigint").alias("child_points"), F.count("*").alias("children"), F.bool_or("flagged").alias("any_flagged"), F.bool_and("flagged").alias("all_flagged"))
    out = parents.join(sums, key, "left")
    return out.withColumn("points", F.coalesce(own, "child_points")).withColumn("children", F.coalesce("children", F.lit(0)))


def confidence(penalties: list[tuple[Column, int]], start: int = 92) -> Column:
    """Hundredths: start minus each penalty that applies, within 10 and 100."""
    value = F.lit(start)
    for when, cost in penalties:
        value = value - F.when(when, F.lit(cost)).otherwise(0)
    return F.least(F.greatest(value, F.lit(10)), F.lit(100)).cast("bigint")


def assign_scores(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """questions(root, ord, number, group_id, points), entries(root, ord, number, points, group) -> (root, ord, points).

    Entries come in turn.  One with a group goes to the first question of its number whose group holds that name, points
    or not.  Else it goes to the first question without points of its number, of it without leading zeros, or of it
    with dots for underscores.  Who takes what depends on turns, so an exam's few questions are one list and its entries a fold over it.
    Entries without a number or positive points are passed over.
    """
    number, points = F.rtrim(F.trim(F.coalesce("number", F.lit(""))), F.lit(".")), F.col("points").try_cast("double").try_cast("int")
    e = entries.select("root", "ord", number.alias("number"), points.alias("points"), F.coalesce("group", F.lit("")).alias("group")).filter("number <> '' AND points > 0")
    e = e.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("ord", "number", "points", "group"))).alias("e"))
    q = questions.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("ord", "number", F.coalesce("group_id", F.lit("")).alias("group"), F.col("points").cast("int").alias("points")))).alias("q"))

    def take(state: Column, x: Column) -> Column:
        first = lambda test: F.nullif(F.array_position(F.transform(state, lambda y: F.coalesce(test(y), F.lit(False))), True), F.lit(0).cast("bigint"))
        free = lambda no: first(lambda y: (y["number"] == no) & y["points"].isNull())
        bare = F.regexp_replace(x["number"], "^0+", "")
        ways = [
            F.when(x["group"] != "", first(lambda y: (y["number"] == x["number"]) & F.lower(y["group"]).contains(F.lower(x["group"])))),
            free(x["number"]), free(F.when(bare == "", "0").otherwise(bare)), free(F.translate(x["number"], "_", ".")),
        ]
        at = F.coalesce(*ways)
        return F.transform(state, lambda y, i: F.struct(y["ord"].alias("ord"), y["number"].alias("number"), y["group"].alias("group"), F.when(at == i + 1, x["points"]).otherwise(y["points"]).alias("points")))

    df = q.join(e, "root", "left")
    out = F.when(F.col("e").isNull(), F.col("q")).otherwise(F.aggregate("e", F.col("q"), take))
    return df.select("root", F.inline(out)).select("root", "ord", "points")
