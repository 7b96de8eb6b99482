"""References, assets and matches: joins of questions with what they point to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedupe, joins, matching
from ..sources.tables import LEAF_SQL, leaf, plain_leaf, table
from .registry import query


@query(f"""WITH {LEAF_SQL} SELECT exam_id, ord, part_id FROM leaf WHERE flag = 'R' AND part_id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)""")
def q_broken_refs(spark: SparkSession, d: str) -> DataFrame:
    assets = table(spark, d, "part").filter("p_size <= 25")
    return joins.broken(leaf(spark, d).filter("flag = 'R'"), "part_id", assets, "p_partkey").select("exam_id", "ord", "part_id")


@query(f"""WITH {LEAF_SQL}, r AS (SELECT DISTINCT part_id FROM leaf WHERE flag = 'R' AND status = 'F' AND points > 45) SELECT p_partkey AS part_id, p_brand AS brand, EXISTS (SELECT 1 FROM leaf WHERE leaf.part_id = p_partkey AND status = 'O') AS page_has_questions
FROM part WHERE p_partkey NOT IN (SELECT part_id FROM r) AND p_type <> 'ECONOMY'""")
def q_unreferenced_assets(spark: SparkSession, d: str) -> DataFrame:
    """Assets that no reference names, sources aside, and whether their page has questions."""
    q = plain_leaf(spark, d)
    refs = q.filter("flag = 'R' AND status = 'F' AND points > 45")
    free = joins.unreferenced(table(spark, d, "part").filter("p_type <> 'ECONOMY'"), "p_partkey", refs, "part_id")
    asked = q.filter("status = 'O'").select("part_id").distinct().withColumn("page_has_questions", F.lit(True))
    out = free.select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("brand")).join(asked, "part_id", "left")
    return out.fillna(False, ["page_has_questions"]).select("part_id", "brand", "page_has_questions")


@query(f"""WITH {LEAF_SQL} SELECT exam_id, ord, COALESCE(CAST(p_size AS BIGINT), points) AS points, p_size IS NOT NULL AS overwritten FROM leaf LEFT JOIN part ON part_id = p_partkey AND p_type = 'ECONOMY'""")
def q_scoring_overwrite(spark: SparkSession, d: str) -> DataFrame:
    table_points = table(spark, d, "part").filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("part_id"), F.col("p_size").cast("bigint").alias("official"))
    out = leaf(spark, d).join(table_points, "part_id", "left")
    return out.select("exam_id", "ord", F.coalesce("official", "points").alias("points"), F.col("official").isNotNull().alias("overwritten"))


@query("""SELECT doc_id, CAST(quality AS BIGINT) AS value, 'label' AS origin FROM labels UNION ALL SELECT doc_id, CAST(length(text) AS BIGINT), 'text' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_text_fallback_recovery(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "labels").select("doc_id", F.col("quality").cast("bigint").alias("value"), F.lit("label").alias("origin"))
    other = table(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("value"), F.lit("text").alias("origin"))
    return joins.with_fallback(found, other, ["doc_id"])


@query("""WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view')
SELECT p.event_id, p.user_id, v.event_id AS source_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def q_asof_source(spark: SparkSession, d: str) -> DataFrame:
    """The latest earlier view of each purchase's user."""
    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("source_id"))
    return joins.as_of(left, right, ["user_id"], "ts", "at", ["source_id"]).select("event_id", "user_id", "source_id")


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, CAST(round(s_acctbal * 100) AS BIGINT) AS v FROM supplier), c AS (SELECT c_custkey, c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) AS v FROM customer)
SELECT c_custkey, c_nationkey, s_suppkey AS nearest_id, abs(c.v - s.v) AS distance FROM c LEFT JOIN s ON c_nationkey = s_nationkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c.v - s.v), s_suppkey) = 1""")
def q_nearest_distance(spark: SparkSession, d: str) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    left = table(spark, d, "customer").select("c_custkey", "c_nationkey", cents("c_acctbal").alias("v"))
    right = table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), cents("s_acctbal").alias("w"), "s_suppkey")
    return joins.nearest(left, right, ["c_nationkey"], "v", "w", "s_suppkey").select("c_custkey", "c_nationkey", "nearest_id", "distance")


@query(f"""WITH {LEAF_SQL}, q AS (SELECT exam_id, number, min(ord) AS ord FROM leaf WHERE flag = 'N' GROUP BY ALL), f AS (SELECT exam_id, number AS fig, ord FROM leaf WHERE flag = 'A')
SELECT q.exam_id, q.number, f.fig, f.ord FROM q JOIN f ON q.exam_id = f.exam_id AND abs(q.number - f.fig) <= 1""")
def q_range_theta_join(spark: SparkSession, d: str) -> DataFrame:
    """Questions and figures of an exam at most one page apart: each figure is copied to the three pages it can meet."""
    x = leaf(spark, d)
    q = x.filter("flag = 'N'").groupBy("exam_id", "number").agg(F.min("ord").alias("q_ord"))
    f = x.filter("flag = 'A'").select("exam_id", F.col("number").alias("fig"), "ord").withColumn("number", F.explode(F.array(F.col("fig") - 1, F.col("fig"), F.col("fig") + 1)))
    return q.join(f, ["exam_id", "number"]).select("exam_id", "number", "fig", "ord")


@query(f"""WITH {LEAF_SQL}, e AS (SELECT * FROM leaf QUALIFY row_number() OVER (PARTITION BY exam_id, number, status ORDER BY ord DESC) = 1)
SELECT exam_id, number, max(CASE WHEN status = 'O' THEN points END) AS v1, max(CASE WHEN status = 'F' THEN points END) AS v2 FROM e GROUP BY exam_id, number""")
def q_answer_key_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Both versions of an answer key side by side; of a repeated entry the last holds."""
    last = leaf(spark, d).groupBy("exam_id", "number").pivot("status", ["O", "F"]).agg(F.max_by("points", "ord"))
    return last.select("exam_id", "number", F.col("O").alias("v1"), F.col("F").alias("v2"))


@query("""WITH e AS (SELECT doc_id, lang AS v FROM documents), a AS (SELECT doc_id, CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN 'en' ELSE 'de' END AS v FROM labels)
SELECT COALESCE(e.doc_id, a.doc_id) AS doc_id, e.v AS expected, a.v AS actual, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'extra' WHEN e.v IS NOT DISTINCT FROM a.v THEN 'same' ELSE 'changed' END AS status FROM e FULL OUTER JOIN a ON e.doc_id = a.doc_id""")
def q_golden_diff(spark: SparkSession, d: str) -> DataFrame:
    """Every document's language beside what its labels say of it."""
    expected = table(spark, d, "documents").select("doc_id", F.col("lang").alias("v"))
    actual = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, None).when(F.col("quality") == 1, "en").otherwise("de").alias("v"))
    return joins.compare(expected, actual, ["doc_id"], "v")


@query(f"""WITH {LEAF_SQL}, p AS (SELECT exam_id, part_id, max(points) AS points FROM leaf GROUP BY ALL)
SELECT exam_id, p_partkey AS part_id, CAST(p_size AS BIGINT) AS official, points, CASE WHEN points IS NULL THEN 'missing' WHEN points <> p_size THEN 'mismatch' ELSE 'equal' END AS status
FROM p JOIN part ON part_id = p_partkey WHERE points <> p_size""")
def q_policy_compare(spark: SparkSession, d: str) -> DataFrame:
    """Items whose points differ from the scoring policy's."""
    p = plain_leaf(spark, d).groupBy("exam_id", "part_id").agg(F.max("points").alias("points"))
    policy = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_size").cast("bigint").alias("official"))
    status = F.when(F.col("points").isNull(), "missing").when(F.col("points") != F.col("official"), "mismatch").otherwise("equal")
    return p.join(policy, "part_id").withColumn("status", status).filter("status <> 'equal'").select("exam_id", "part_id", "official", "points", "status")


@query(f"""WITH {LEAF_SQL} SELECT exam_id, ord, COALESCE(CASE WHEN p_size > 30 THEN 'crop/' || p_name END, CASE WHEN s_acctbal > 5000 THEN 'source/' || s_name END, 'page/' || CAST(number AS VARCHAR)) AS media
FROM leaf LEFT JOIN part ON part_id = p_partkey LEFT JOIN supplier ON supp_id = s_suppkey""")
def q_media_resolution(spark: SparkSession, d: str) -> DataFrame:
    """A question's media: the asset's crop, else the source's, else its page."""
    crops = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.when(F.col("p_size") > 30, F.concat(F.lit("crop/"), "p_name")).alias("crop"))
    sources = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supp_id"), F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("source/"), "s_name")).alias("source"))
    out = leaf(spark, d).join(crops, "part_id", "left").join(sources, "supp_id", "left")
    return out.select("exam_id", "ord", F.coalesce("crop", "source", F.concat(F.lit("page/"), F.col("number").cast("string"))).alias("media"))


@query(f"""WITH {LEAF_SQL} SELECT exam_id, 'part' AS kind, part_id AS ref FROM leaf UNION SELECT exam_id, 'supplier', supp_id FROM leaf UNION SELECT exam_id, 'page', number FROM leaf""")
def q_asset_closure(spark: SparkSession, d: str) -> DataFrame:
    """All that an exam's export must hold, once each: one pass over the questions."""
    refs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("bigint").alias("ref")) for k, c in (("part", "part_id"), ("supplier", "supp_id"), ("page", "number"))))
    return plain_leaf(spark, d).select("exam_id", F.inline(refs)).distinct()


#: Subjects and the words that tell them, in order.
SUBJECTS = [("widget", "general"), ("small widget", "compact"), ("cold", "thermal"), ("hot", "thermal"), ("steel", "metal"), ("large", "bulk")]


@query("""SELECT p_partkey AS part_id, p_name AS name, CASE WHEN contains(lower(p_name), 'small widget') THEN 'compact' WHEN contains(lower(p_name), 'widget') THEN 'general' WHEN contains(lower(p_name), 'steel') THEN 'metal' WHEN contains(lower(p_name), 'large') THEN 'bulk' WHEN contains(lower(p_name), 'cold') THEN 'thermal' WHEN contains(lower(p_name), 'hot') THEN 'thermal' END AS subject FROM part""")
def q_longest_keyword(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("name"))
    return joins.longest_keyword(p, "name", SUBJECTS, "subject")


@query(f"""WITH {LEAF_SQL}, i AS (SELECT exam_id, part_id, row_number() OVER (PARTITION BY exam_id ORDER BY number, ord) AS pos, count(*) OVER (PARTITION BY exam_id) AS n FROM leaf WHERE flag = 'A'),
q AS (SELECT exam_id, supp_id, row_number() OVER (PARTITION BY exam_id ORDER BY number, ord) AS pos, count(*) OVER (PARTITION BY exam_id) AS n FROM leaf WHERE flag = 'N') SELECT i.exam_id, i.part_id, q.supp_id FROM i JOIN q USING (exam_id, pos, n)""")
def q_positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Items and questions by position, where an exam has as many of one as of the other."""
    q = leaf(spark, d)
    items = q.filter("flag = 'A'").select("exam_id", "part_id", F.col("number").alias("i_no"), F.col("ord").alias("i_ord"))
    questions = q.filter("flag = 'N'").select("exam_id", "supp_id", F.col("number").alias("q_no"), F.col("ord").alias("q_ord"))
    return joins.zip_if_equal(items, questions, ["exam_id"], ["i_no", "i_ord"], ["q_no", "q_ord"]).select("exam_id", "part_id", "supp_id")


@query(f"""WITH {LEAF_SQL}, i AS (SELECT exam_id, points, min(part_id) AS item_id FROM leaf WHERE flag = 'A' GROUP BY exam_id, points HAVING count(*) = 1), q AS (SELECT exam_id, points, min(part_id) AS question_id FROM leaf WHERE flag = 'N' GROUP BY exam_id, points HAVING count(*) = 1)
SELECT exam_id, points, item_id, question_id FROM i JOIN q USING (exam_id, points)""")
def q_unique_points_match(spark: SparkSession, d: str) -> DataFrame:
    q = plain_leaf(spark, d)
    items = q.filter("flag = 'A'").select("exam_id", "points", F.col("part_id").alias("item_id"))
    questions = q.filter("flag = 'N'").select("exam_id", "points", F.col("part_id").alias("question_id"))
    return matching.unique_by_points(items, questions, ["exam_id"], "points").select("exam_id", "points", "item_id", "question_id")


@query(f"""WITH {LEAF_SQL}, q AS (SELECT exam_id, ord, number, supp_id FROM leaf WHERE flag = 'N'), s AS (SELECT exam_id, number AS s_number, supp_id AS s_supp, ord AS s_ord, points AS s_points FROM leaf WHERE flag = 'A'),
r AS (SELECT q.exam_id, ord, 1 AS strategy, s_ord, s_points FROM q JOIN s ON q.exam_id = s.exam_id AND number = s_number AND supp_id = s_supp UNION ALL SELECT q.exam_id, ord, 2, s_ord, s_points FROM q JOIN s ON q.exam_id = s.exam_id AND number = s_number UNION ALL SELECT q.exam_id, ord, 3, s_ord, s_points FROM q JOIN s ON q.exam_id = s.exam_id AND number = s_number + 1)
SELECT exam_id, ord, CAST(strategy AS BIGINT) AS strategy, s_points FROM r QUALIFY row_number() OVER (PARTITION BY exam_id, ord ORDER BY strategy, s_ord) = 1""")
def q_scoring_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Points of a question from the first scoring entry: by group and number, by number, by the number before."""
    x = leaf(spark, d)
    q = x.filter("flag = 'N'").select(F.concat_ws("/", "exam_id", "ord").alias("q_id"), "exam_id", "ord", "number", "supp_id")
    s = x.filter("flag = 'A'").select(F.col("exam_id").alias("s_exam"), F.col("number").alias("s_number"), F.col("supp_id").alias("s_supp"), F.col("ord").alias("s_ord"), F.col("points").alias("s_points"))
    exam = F.col("exam_id") == F.col("s_exam")
    ways = [exam & (F.col("number") == F.col("s_number")) & (F.col("supp_id") == F.col("s_supp")), exam & (F.col("number") == F.col("s_number")), exam & (F.col("number") == F.col("s_number") + 1)]
    return joins.first_match(q, s, "q_id", ways, ["s_ord"]).select("exam_id", "ord", F.col("strategy").cast("bigint").alias("strategy"), "s_points")


@query("""SELECT o_orderkey AS exam_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def q_set_difference(spark: SparkSession, d: str) -> DataFrame:
    """Exams expected and not found."""
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("exam_id"))
    return expected.exceptAll(table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("exam_id")).distinct())


@query(f"""WITH {LEAF_SQL}, g AS (SELECT exam_id, count(DISTINCT supp_id) AS n FROM leaf WHERE flag = 'N' GROUP BY exam_id) SELECT l.exam_id, l.ord, s.supp_id AS source_id FROM leaf l JOIN g USING (exam_id) JOIN (SELECT exam_id, min(supp_id) AS supp_id FROM leaf WHERE flag = 'N' GROUP BY exam_id) s USING (exam_id) WHERE n = 1 AND l.flag = 'A'""")
def q_sole_source(spark: SparkSession, d: str) -> DataFrame:
    """Questions without a source, in exams with exactly one."""
    q = leaf(spark, d)
    sole = q.filter("flag = 'N'").groupBy("exam_id").agg(F.min("supp_id").alias("source_id"), F.max("supp_id").alias("__other")).filter("source_id = __other")
    return q.filter("flag = 'A'").join(sole, "exam_id").select("exam_id", "ord", "source_id")


@query(f"""WITH {LEAF_SQL}, s AS (SELECT exam_id, number, points, ord, CASE flag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS src FROM leaf), f AS (SELECT exam_id, src, min(src) OVER (PARTITION BY exam_id) AS best, number, points, ord FROM s)
SELECT exam_id, number, points, CAST(src AS BIGINT) AS src FROM f QUALIFY row_number() OVER (PARTITION BY exam_id, number ORDER BY src, ord) = 1""")
def q_ranked_union(spark: SparkSession, d: str) -> DataFrame:
    """Scoring entries of three sources: a number's entry comes from the first source that has it."""
    src = F.when(F.col("flag") == "N", 1).when(F.col("flag") == "A", 2).otherwise(3).cast("bigint")
    return dedupe.first_wins(leaf(spark, d).withColumn("src", src), ["exam_id", "number"], ["src", "ord"]).select("exam_id", "number", "points", "src")
