"""Driver tables, and the assessment model that the queries read them as.

orders are exams, lineitem rows their leaf questions (number, points, flags), part and supplier the assets
and sources that questions refer to, conversations the pages of an exam, events the job log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Makes rows of a question's number a total order.
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

LEAF_SQL = f"""leaf AS (
    SELECT l_orderkey AS exam_id, CAST(l_linenumber AS BIGINT) AS number, CAST(l_quantity AS BIGINT) AS points, l_partkey AS part_id, l_suppkey AS supp_id,
        l_returnflag AS flag, l_linestatus AS status, CAST(l_shipdate AS DATE) AS day,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS ord
    FROM lineitem)"""

PAGES_SQL = "pages_of AS (SELECT conv_id AS exam_id, turn AS page, role, text FROM conversations)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf questions with `ord`, a total order within their exam."""
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("exam_id"), F.col("l_linenumber").cast("bigint").alias("number"), F.col("l_quantity").cast("bigint").alias("points"),
        F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supp_id"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.to_date("l_shipdate").alias("day"), F.row_number().over(w).cast("bigint").alias("ord"),
    )


def plain_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf questions without `ord`: no shuffle."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("exam_id"), F.col("l_linenumber").cast("bigint").alias("number"), F.col("l_quantity").cast("bigint").alias("points"),
        F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supp_id"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.to_date("l_shipdate").alias("day"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("exam_id"), F.col("turn").alias("page"), "role", "text")
