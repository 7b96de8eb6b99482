"""Ordered rows: gaps, runs, carried headers, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins
from ..operators import sequences as seq
from ..sources.tables import LEAF_SQL, PAGES_SQL, leaf, pages, plain_leaf, table
from .registry import query


@query(f"""WITH {LEAF_SQL}, k AS (SELECT DISTINCT exam_id, number AS n FROM leaf), m AS (SELECT exam_id, unnest(generate_series(1, max(n))) AS missing FROM k GROUP BY exam_id)
SELECT exam_id, missing, (SELECT max(n) FROM k WHERE k.exam_id = m.exam_id AND n < missing) AS prev_known, (SELECT min(n) FROM k WHERE k.exam_id = m.exam_id AND n > missing) AS next_known
FROM m WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.exam_id = m.exam_id AND n = missing)""")
def q_number_gaps(spark: SparkSession, d: str) -> DataFrame:
    return seq.gaps(plain_leaf(spark, d), ["exam_id"], "number")


@query(f"""WITH {LEAF_SQL}, k AS (SELECT DISTINCT exam_id, flag, number AS n FROM leaf), m AS (SELECT exam_id, flag, unnest(generate_series(min(n), max(n))) AS missing FROM k GROUP BY exam_id, flag)
SELECT exam_id, flag, missing FROM m WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.exam_id = m.exam_id AND k.flag = m.flag AND n = missing)""")
def q_group_gaps(spark: SparkSession, d: str) -> DataFrame:
    return seq.gaps(plain_leaf(spark, d), ["exam_id", "flag"], "number", None).select("exam_id", "flag", "missing")


@query(f"""WITH {LEAF_SQL}, l AS (SELECT *, number <= lag(number) OVER w AS again FROM (SELECT exam_id, number, points, row_number() OVER (PARTITION BY exam_id ORDER BY part_id, ord) AS pos FROM leaf) WINDOW w AS (PARTITION BY exam_id ORDER BY pos))
SELECT exam_id, pos, number, CAST(sum(CASE WHEN COALESCE(again, true) THEN 1 ELSE 0 END) OVER (PARTITION BY exam_id ORDER BY pos) AS BIGINT) AS run FROM l""")
def q_item_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of rising numbers in the order in which the questions stand."""
    from pyspark.sql import Window

    df = leaf(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("exam_id").orderBy("part_id", "ord")).cast("bigint"))
    return seq.runs(df, ["exam_id"], ["pos"], seq.not_above_previous("number", ["exam_id"], ["pos"])).select("exam_id", "pos", "number", "run")


@query(f"""WITH {PAGES_SQL}, h AS (SELECT *, role = 'system' OR length(text) < 40 AS skip FROM pages_of)
SELECT exam_id, page, CASE WHEN NOT skip THEN last_value(CASE WHEN NOT skip AND role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY exam_id ORDER BY page ROWS UNBOUNDED PRECEDING) END AS group_header FROM h""")
def q_group_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The group header that holds for each page; cover and scoring pages (here: short ones) neither have nor give one."""
    p = pages(spark, d)
    skip = (F.col("role") == "system") | (F.length("text") < 40)
    header = F.when(F.col("role") == "user", F.col("text"))
    return seq.carry_forward(p, ["exam_id"], ["page"], header, "group_header", skip).select("exam_id", "page", "group_header")


@query(f"""WITH {PAGES_SQL}, y AS (SELECT exam_id, page, CAST(length(text) AS BIGINT) AS y0 FROM pages_of), e AS (SELECT *, COALESCE(lead(y0) OVER (PARTITION BY exam_id ORDER BY page), 5000) AS e FROM y)
SELECT exam_id, page, y0, CASE WHEN e <= y0 THEN y0 + 180 ELSE e END AS region_end FROM e""")
def q_regions_lead(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d).select("exam_id", "page", F.length("text").cast("bigint").alias("y0"))
    return seq.regions(p, ["exam_id"], ["page"], "y0", F.lit(5000).cast("bigint"), 180)


@query(f"""WITH {PAGES_SQL}, m AS (SELECT *, contains(lower(text), 'tion') AND page >= 2 AS mark, count(*) OVER (PARTITION BY exam_id) AS n FROM pages_of), c AS (SELECT *, min(CASE WHEN mark THEN page END) OVER (PARTITION BY exam_id) AS cut FROM m)
SELECT exam_id, page FROM c WHERE n <= 3 OR cut IS NULL OR page < cut""")
def q_sfi_tail(spark: SparkSession, d: str) -> DataFrame:
    """In long exams everything from the first marked page on goes."""
    p = pages(spark, d)
    marker = F.lower("text").contains("tion") & (F.col("page") >= 2)
    return seq.tail_from(p, ["exam_id"], "page", marker, 3).select("exam_id", "page")


@query(f"""WITH {LEAF_SQL}, p AS (SELECT exam_id, ord, number, CASE WHEN points % 5 = 0 THEN points END AS v, flag = 'R' AS stop FROM leaf),
n AS (SELECT a.exam_id, a.ord, a.number, b.v, b.stop, b.ord AS o FROM p a LEFT JOIN p b ON a.exam_id = b.exam_id AND b.ord BETWEEN a.ord + 1 AND a.ord + 5 AND (b.stop OR b.v IS NOT NULL))
SELECT exam_id, ord, number, CASE WHEN NOT stop THEN v END AS points_ahead FROM n QUALIFY row_number() OVER (PARTITION BY exam_id, ord ORDER BY o) = 1""")
def q_lookahead_points(spark: SparkSession, d: str) -> DataFrame:
    """Points within the next five rows, unless another anchor comes first."""
    value = F.when(F.col("points") % 5 == 0, F.col("points"))
    return seq.look_ahead(leaf(spark, d), ["exam_id"], ["ord"], value, F.col("flag") == "R", 5, "points_ahead").select("exam_id", "ord", "number", "points_ahead")


@query("""WITH l AS (SELECT doc_id, unnest(generate_series(0, len(x) - 1)) AS line, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
s AS (SELECT doc_id, line, CASE WHEN starts_with(t, 'The ') THEN 'grupo_i' WHEN starts_with(t, 'Licensed') OR starts_with(t, 'Released') THEN 'grupo_ii' WHEN starts_with(t, 'And ') THEN 'grupo_iii' END AS section FROM l),
f AS (SELECT doc_id, section, min(line) AS first_position FROM s WHERE section IS NOT NULL GROUP BY doc_id, section)
SELECT doc_id, section, CAST(first_position AS BIGINT) AS first_position, CAST(lead(first_position) OVER (PARTITION BY doc_id ORDER BY first_position, section) AS BIGINT) AS end_position FROM f""")
def q_section_bounds(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("line", F.col("line").cast("bigint"))
    t = F.col("t")
    section = F.when(t.startswith("The "), "grupo_i").when(t.startswith("Licensed") | t.startswith("Released"), "grupo_ii").when(t.startswith("And "), "grupo_iii")
    return seq.section_bounds(lines, ["doc_id"], "line", section)


@query(f"""WITH {LEAF_SQL} SELECT exam_id, supp_id, ord, chr(CAST(96 + row_number() OVER (PARTITION BY exam_id, supp_id ORDER BY points, ord) AS INTEGER)) AS letter FROM leaf""")
def q_child_letters(spark: SparkSession, d: str) -> DataFrame:
    return seq.letters(leaf(spark, d), ["exam_id", "supp_id"], ["points", "ord"]).select("exam_id", "supp_id", "ord", "letter")


@query(f"""WITH {LEAF_SQL} SELECT exam_id, ord, last_value(CASE WHEN flag = 'N' THEN number END IGNORE NULLS) OVER (PARTITION BY exam_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_known,
first_value(CASE WHEN flag = 'N' THEN number END IGNORE NULLS) OVER (PARTITION BY exam_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_known FROM leaf""")
def q_nearest_prev_next(spark: SparkSession, d: str) -> DataFrame:
    known = F.when(F.col("flag") == "N", F.col("number"))
    return seq.known_around(leaf(spark, d), ["exam_id"], ["ord"], known).select("exam_id", "ord", "prev_known", "next_known")


@query(f"""WITH {LEAF_SQL}, s AS (SELECT exam_id, flag, max(number) AS strong FROM leaf WHERE points >= 20 GROUP BY exam_id, flag)
SELECT l.exam_id, l.ord, l.number, s.strong FROM leaf l JOIN s USING (exam_id, flag) WHERE l.points < 20 AND l.number > s.strong""")
def q_out_of_range(spark: SparkSession, d: str) -> DataFrame:
    """Weak rows whose number is above the highest strong number of their group."""
    q = leaf(spark, d)
    strong = q.filter("points >= 20").groupBy("exam_id", "flag").agg(F.max("number").alias("strong"))
    return q.filter("points < 20").join(strong, ["exam_id", "flag"]).filter("number > strong").select("exam_id", "ord", "number", "strong")


@query(f"""WITH {LEAF_SQL}, a AS (SELECT exam_id, number, points FROM leaf WHERE flag = 'N' QUALIFY row_number() OVER (PARTITION BY exam_id, number ORDER BY ord) = 1),
b AS (SELECT exam_id, number, points FROM leaf WHERE flag = 'R' QUALIFY row_number() OVER (PARTITION BY exam_id, number ORDER BY ord) = 1)
SELECT exam_id, number, COALESCE(a.points, b.points) AS points, CASE WHEN a.points IS NOT NULL AND b.points IS NOT NULL THEN 'both' WHEN a.points IS NOT NULL THEN 'key' ELSE 'prose' END AS origin FROM a FULL OUTER JOIN b USING (exam_id, number)""")
def q_key_prose_merge(spark: SparkSession, d: str) -> DataFrame:
    """Answer-key rows override prose rows of the same number."""
    from ..operators.dedupe import first_wins

    q = leaf(spark, d)
    part = lambda flag, name: first_wins(q.filter(F.col("flag") == flag), ["exam_id", "number"], ["ord"]).select("exam_id", "number", F.col("points").alias(name))
    both = part("N", "a").join(part("R", "b"), ["exam_id", "number"], "full_outer")
    origin = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("a").isNotNull(), "key").otherwise("prose")
    return both.select("exam_id", "number", F.coalesce("a", "b").alias("points"), origin.alias("origin"))


@query(f"""WITH {PAGES_SQL} SELECT exam_id, page, CAST(row_number() OVER (PARTITION BY exam_id ORDER BY page DESC) AS BIGINT) AS from_end FROM pages_of QUALIFY from_end <= 3""")
def q_last_pages(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("exam_id").orderBy(F.col("page").desc())).cast("bigint")
    return pages(spark, d).withColumn("from_end", rn).filter("from_end <= 3").select("exam_id", "page", "from_end")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS parent FROM part),
up AS (SELECT id, parent AS ancestor, 1 AS depth FROM e WHERE parent IS NOT NULL UNION ALL SELECT up.id, e.parent, up.depth + 1 FROM up JOIN e ON up.ancestor = e.id WHERE e.parent IS NOT NULL)
SELECT id, ancestor, CAST(depth AS BIGINT) AS depth FROM up""")
def q_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return joins.ancestors(table(spark, d, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey > 0 THEN p_partkey div 2 END AS parent"))
