"""Joins by nearness, by rank, and against what is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, take: list[str]) -> DataFrame:
    """Each left row with the latest right row of its key at or before it (nulls if there is none).

    Both sides are stacked and sorted once, and the last right row is carried forward, so no pair of rows
    that is not in the result is built.
    """
    fields = F.struct(*take)
    no_left = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in keys]
    a = left.select(*left.columns, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(fields.alias("s")).schema["s"].dataType).alias("__r"))
    b = right.select(*keys, *no_left, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), fields.alias("__r")).select(*a.columns)
    w = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1")
    return out.select(*left.columns, *(F.col("__r")[c].alias(c) for c in take))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, right_id: str, blocks: int = 256) -> DataFrame:
    """Each left row with the id and distance of the right row nearest to it (ties: the smaller id).

    Only the neighbours before and after in sorted order can be nearest, so the two sides are stacked and
    sorted instead of being paired.  A key's rows are dealt over ranges of the value, cut at quantiles of all rows,
    so a key that holds most rows is sorted by many tasks; what a range lacks at its ends comes from one row for
    each key and range.
    """
    no_left = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in keys]
    a = left.select(*left.columns, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[right_id].dataType).alias("__id"))
    # equal values: only the smallest id counts
    firsts = right.groupBy(*keys, F.col(right_at).alias("__at")).agg(F.min(right_id).alias("__id"))
    b = firsts.select(*keys, *no_left, "__at", F.lit(0).alias("__side"), "__id").select(*a.columns)
    cuts = sorted(set(left.select(F.col(left_at).alias("__at")).approxQuantile("__at", [i / blocks for i in range(1, blocks)], 0.5 / blocks)))
    block = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("__at"))) if cuts else F.lit(0)
    here = F.when(F.col("__side") == 0, F.struct("__at", "__id"))
    both = a.unionByName(b).withColumn("__block", block)
    # both frames grow by one row at a time; a frame that shrinks would be gone through anew for each row
    seen = lambda by, frame, *order: F.last(by, ignorenulls=True).over(Window.partitionBy(*frame).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ranged = [*keys, "__block"]
    ends = both.groupBy(*ranged).agg(F.max(here).alias("__last"), F.min(here).alias("__first"))
    by_key = lambda by, order: F.last(by, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*ranged, by_key("__last", F.col("__block")).alias("__before"), by_key("__first", F.col("__block").desc()).alias("__after"))
    out = both.withColumn("__lo", seen(here, ranged, F.col("__at"), "__side")).withColumn("__hi", seen(here, ranged, F.col("__at").desc(), "__side")).filter("__side = 1")
    same = [out[c].eqNullSafe(ends[c]) for c in ranged]
    out = out.join(ends, same, "left").select(*(out[c] for c in [*left.columns, "__at"]), F.coalesce("__lo", "__before").alias("__lo"), F.coalesce("__hi", "__after").alias("__hi"))
    lo = F.when(F.col("__lo").isNotNull(), F.struct((F.col("__at") - F.col("__lo.__at")).alias("d"), F.col("__lo.__id").alias("i")))
    hi = F.when(F.col("__hi").isNotNull(), F.struct((F.col("__hi.__at") - F.col("__at")).alias("d"), F.col("__hi.__id").alias("i")))
    best = F.when(hi.isNull() | (lo <= hi), lo).otherwise(hi)
    return out.withColumn("__best", best).select(*left.columns, F.col("__best.i").alias("nearest_id"), F.col("__best.d").alias("distance"))


def first_match(left: DataFrame, right: DataFrame, left_id: str, strategies: list[Column], order: list[str | Column]) -> DataFrame:
    """Each left row with its first right row: by the first strategy that has one, then by order.

    Each strategy is a join condition with at least one equality, so each is a hash or sort-merge join.
    """
    ranked = reduce(DataFrame.unionByName, (left.join(right, on).withColumn("strategy", F.lit(i + 1)) for i, on in enumerate(strategies)))
    w = Window.partitionBy(left_id).orderBy("strategy", *order)
    return ranked.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def broken(refs: DataFrame, ref: str, assets: DataFrame, asset: str) -> DataFrame:
    """References to nothing."""
    return refs.join(assets.select(F.col(asset).alias("__a")).distinct(), refs[ref] == F.col("__a"), "left_anti")


def unreferenced(assets: DataFrame, asset: str, refs: DataFrame, ref: str) -> DataFrame:
    """Assets that nothing refers to."""
    return assets.join(refs.select(F.col(ref).alias("__r")).distinct(), assets[asset] == F.col("__r"), "left_anti")


def with_fallback(found: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows found, and those of the other source whose key was not."""
    return found.unionByName(other.join(found.select(*keys).distinct(), keys, "left_anti"))


def compare(expected: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison: keys, expected, actual, and same / changed / missing / extra."""
    e = expected.select(*keys, F.col(value).alias("expected"), F.lit(True).alias("__e"))
    a = actual.select(*keys, F.col(value).alias("actual"), F.lit(True).alias("__a"))
    status = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "extra").when(F.col("expected").eqNullSafe(F.col("actual")), "same").otherwise("changed")
    return e.join(a, keys, "full_outer").withColumn("status", status).drop("__e", "__a")


def longest_keyword(df: DataFrame, text: str, keywords: list[tuple[str, str]], name: str) -> DataFrame:
    """The value of the longest keyword that stands in the text (ties: the first listed); null if none does.

    The keywords are constants, so this is one expression and no join.
    """
    ordered = sorted(enumerate(keywords), key=lambda x: (-len(x[1][0]), x[0]))
    cases = [F.when(F.lower(text).contains(word.lower()), F.lit(value)) for _, (word, value) in ordered]
    return df.withColumn(name, F.coalesce(*cases))


def zip_if_equal(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Left and right rows of a key by position, for keys with equally many of both."""
    lw, rw = Window.partitionBy(*keys).orderBy(*left_order), Window.partitionBy(*keys).orderBy(*right_order)
    a = left.withColumn("__pos", F.row_number().over(lw)).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    b = right.withColumn("__pos", F.row_number().over(rw)).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    return a.join(b, [*keys, "__pos", "__n"]).drop("__pos", "__n")


def ancestors(edges: DataFrame) -> DataFrame:
    """edges(id, parent), one parent an id -> (id, ancestor, depth).

    Each round joins the furthest ancestors known with their own, so paths double and a depth of n takes log2(n)
    rounds.  Parents that go round in a circle raise RuntimeError.
    """
    known = saved(edges.filter("parent IS NOT NULL").select("id", F.col("parent").alias("ancestor"), F.lit(1).cast("bigint").alias("depth")), "ancestors")
    for reach in (1 << k for k in range(40)):
        far = known.filter(F.col("depth") == reach)
        step = known.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        new = saved(far.join(step, "ancestor").select("id", F.col("next").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth")), "ancestors")
        if new.isEmpty():
            return known
        if not new.filter("id = ancestor").isEmpty():
            raise RuntimeError("parents go round in a circle")
        known = known.unionByName(new)
    raise RuntimeError("paths are too long")
