"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(sym: DataFrame, keep_smaller: bool) -> DataFrame:
    """sym(u, v): links every chosen neighbour v of u to the smallest of u and its neighbours.

    The smallest are written out first, so that the join has two plain inputs and Spark can split a hot u.
    """
    mins = materialize(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-min")
    joined = sym.join(mins, "u")
    if keep_smaller:  # v < u throughout
        links = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(mins.filter("u != m").select("u", F.col("m").alias("v")))
    else:
        links = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) of comparable ids, null-free -> (id, component): the smallest id reachable, for ids with a link to another.

    Each round is a fixed number of shuffles whose rows are no more than the edges; chains shrink by a
    constant factor a round.  Loops (a = b) and repeated edges are ignored; no edges give no rows.
    Raises RuntimeError if `most_rounds` rounds do not settle (longer chains than 2^60 would need).
    """
    e = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges")
    for _ in range(most_rounds):
        large = materialize(_star(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), False), "large-star")
        small = materialize(_star(large, True), "small-star")
        e = small
        # settled: every node has one link, to a node that has none
        ends = small.select("u", F.lit(1).alias("out"), F.lit(0).alias("hit")).unionByName(small.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("hit")))
        if ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("hit").alias("hit")).filter("out > 1 OR (out > 0 AND hit > 0)").isEmpty():
            break
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
