"""Points, audits and duplicates over exams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, dedupe, scoring, sequences
from ..sources.exams import MODEL_SQL, model
from ..sources.tables import LEAF_SQL, leaf, plain_leaf, table
from .registry import query


@query(f"""WITH {LEAF_SQL}, t AS (SELECT exam_id, CAST(sum(points) AS BIGINT) AS total, count(*) AS n, count(*) FILTER (points = 0) AS missing FROM leaf GROUP BY exam_id)
SELECT exam_id, total, n, missing, CASE WHEN missing > 0 OR abs(total - 200) > 10 THEN 'FAIL' WHEN total <> 200 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM t""")
def q_points_total_audit(spark: SparkSession, d: str) -> DataFrame:
    t = scoring.totals(plain_leaf(spark, d), ["exam_id"])
    off = F.abs(F.col("total") - 200)
    return t.withColumn("verdict", F.when((F.col("missing") > 0) | (off > 10), "FAIL").when(off > 0, "REVIEW").otherwise("PASS"))


@query("""WITH q AS (SELECT p_partkey AS id, p_partkey // 2 AS parent, p_type AS type FROM part)
SELECT id, type FROM q WHERE type <> 'ECONOMY' AND NOT EXISTS (SELECT 1 FROM q c WHERE c.parent = q.id AND c.id <> q.id)""")
def q_leaf_filter(spark: SparkSession, d: str) -> DataFrame:
    """Questions that are no group and no other's parent."""
    q = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 2").alias("parent"), F.col("p_type").alias("type"))
    parents = q.filter("parent <> id").select(F.col("parent").alias("p")).distinct()
    return q.filter("type <> 'ECONOMY'").join(parents, F.col("id") == F.col("p"), "left_anti").select("id", "type")


@query(f"""WITH {LEAF_SQL}, r AS (SELECT exam_id, number, part_id, row_number() OVER w AS nth, first_value(part_id) OVER w AS first_part_id FROM leaf WINDOW w AS (PARTITION BY exam_id, number ORDER BY ord))
SELECT * FROM r WHERE nth > 1""")
def q_duplicate_numbers(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.repeats(leaf(spark, d), ["exam_id", "number"], ["ord"], "part_id").select("exam_id", "number", "part_id", "nth", "first_part_id")


@query(f"""WITH {LEAF_SQL} SELECT exam_id, number, part_id, points FROM leaf QUALIFY row_number() OVER (PARTITION BY exam_id, number ORDER BY ord) = 1""")
def q_first_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.first_wins(leaf(spark, d), ["exam_id", "number"], ["ord"]).select("exam_id", "number", "part_id", "points")


@query(f"""WITH {LEAF_SQL} SELECT exam_id, number, part_id, points, CAST(points * 10 + CASE flag WHEN 'N' THEN 200 WHEN 'A' THEN 50 ELSE 0 END + CASE status WHEN 'O' THEN 25 ELSE 0 END AS BIGINT) AS score
FROM leaf QUALIFY row_number() OVER (PARTITION BY exam_id, number ORDER BY score DESC, ord) = 1""")
def q_best_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    score = (F.col("points") * 10 + F.when(F.col("flag") == "N", 200).when(F.col("flag") == "A", 50).otherwise(0) + (F.col("status") == "O").cast("int") * 25).cast("bigint")
    df = leaf(spark, d).withColumn("score", score)
    return dedupe.best_wins(df, ["exam_id", "number"], F.col("score"), ["ord"]).select("exam_id", "number", "part_id", "points", "score")


@query(f"""WITH {LEAF_SQL} SELECT part_id, ord, exam_id, CASE WHEN row_number() OVER w = 1 THEN CAST(part_id AS VARCHAR) ELSE CAST(part_id AS VARCHAR) || '_p' || CAST(number AS VARCHAR) || '_' || CAST(row_number() OVER w AS VARCHAR) END AS new_id
FROM leaf WINDOW w AS (PARTITION BY part_id ORDER BY exam_id, ord)""")
def q_unique_ids(spark: SparkSession, d: str) -> DataFrame:
    df = dedupe.unique_ids(leaf(spark, d), "part_id", ["exam_id", "ord"], F.concat(F.lit("_p"), F.col("number").cast("string"), F.lit("_")))
    return df.select("part_id", "ord", "exam_id", "new_id")


@query("""SELECT source, sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY source, sha256(text) HAVING count(*) > 1""")
def q_duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.repeated_content(table(spark, d, "documents"), ["source"], "text", "doc_id")


@query(f"""WITH {MODEL_SQL}, w AS (SELECT q.root, ord, greatest(coalesce(points, 0), 0) AS w, CASE WHEN year BETWEEN 2008 AND 2017 THEN 50 WHEN year BETWEEN 2018 AND 2019 THEN 56 END AS official FROM questions q JOIN exams e ON e.root = q.root),
s AS (SELECT *, CAST(sum(w) OVER g AS BIGINT) AS total, count(*) OVER g AS n FROM w WINDOW g AS (PARTITION BY root)),
r AS (SELECT *, CAST((official - n) * w AS DOUBLE) / nullif(total, 0) AS raw FROM s), f AS (SELECT *, CAST(floor(raw) AS BIGINT) AS low FROM r),
p AS (SELECT *, official - n - CAST(sum(low) OVER (PARTITION BY root) AS BIGINT) AS rest, row_number() OVER (PARTITION BY root ORDER BY raw - low DESC NULLS LAST, ord) AS place FROM f)
SELECT root, ord, w AS points, CASE WHEN total <> official AND total > 0 AND total BETWEEN official * 0.4 AND official * 5 AND official >= n THEN 1 + low + CASE WHEN place <= rest THEN 1 ELSE 0 END ELSE w END AS share FROM p""")
def q_largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    """Points of the second group, here all of an exam's, rescaled to the official total of the exam's year."""
    ex = model(spark, d)
    q = ex.questions.join(ex.exams.select("root", "year"), "root")
    out = scoring.largest_remainder(q, ["root"], "points", scoring.era_total(F.col("year"), F.lit("grupo_ii")), ["ord"])
    return out.select("root", "ord", F.greatest(F.coalesce("points", F.lit(0)), F.lit(0)).cast("bigint").alias("points"), "share")


@query(f"""WITH {LEAF_SQL}, c AS (SELECT exam_id, CAST(sum(points) AS BIGINT) AS child_points, count(*) AS children, bool_or(flag = 'R') AS any_flagged, bool_and(flag = 'R') AS all_flagged FROM leaf GROUP BY exam_id)
SELECT o_orderkey AS exam_id, COALESCE(CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) END, child_points) AS points, COALESCE(children, 0) AS children, any_flagged, all_flagged
FROM orders LEFT JOIN c ON o_orderkey = exam_id""")
def q_parent_rollup(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "orders").select(F.col("o_orderkey").alias("exam_id"), F.when(F.col("o_orderstatus") == "F", F.floor("o_totalprice")).cast("bigint").alias("own"))
    children = plain_leaf(spark, d).withColumn("flagged", F.col("flag") == "R")
    return scoring.roll_up(parents, children, "exam_id", "own").select("exam_id", "points", "children", "any_flagged", "all_flagged")


@query(f"""WITH {LEAF_SQL} SELECT o_orderkey AS exam_id, count(ord) AS nodes, count(*) FILTER (points > 0) AS answerable, count(DISTINCT number) AS main, count(*) FILTER (flag = 'R') AS groups
FROM orders LEFT JOIN leaf ON o_orderkey = exam_id GROUP BY o_orderkey""")
def q_question_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = plain_leaf(spark, d).groupBy("exam_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("points") > 0).alias("answerable"), F.countDistinct("number").alias("main"), F.count_if(F.col("flag") == "R").alias("groups"))
    exams = table(spark, d, "orders").select(F.col("o_orderkey").alias("exam_id"))
    return exams.join(stats, "exam_id", "left").fillna(0, ["nodes", "answerable", "main", "groups"])


@query(f"""WITH {LEAF_SQL}, f AS (SELECT o_orderkey AS exam_id, count(ord) AS n, bool_or(points < 3) AS low, bool_or(flag = 'R') AS recovered FROM orders LEFT JOIN leaf ON o_orderkey = exam_id GROUP BY o_orderkey)
SELECT exam_id, CASE WHEN n = 0 THEN 'partial_failed' WHEN recovered THEN 'needs_review' WHEN low THEN 'completed_with_warnings' ELSE 'completed' END AS status FROM f""")
def q_status_cascade(spark: SparkSession, d: str) -> DataFrame:
    flags = plain_leaf(spark, d).groupBy("exam_id").agg(F.count("*").alias("n"), F.bool_or(F.col("points") < 3).alias("low"), F.bool_or(F.col("flag") == "R").alias("recovered"))
    exams = table(spark, d, "orders").select(F.col("o_orderkey").alias("exam_id")).join(flags, "exam_id", "left")
    return exams.select("exam_id", audit.status(F.col("n").isNull(), F.col("recovered"), F.col("low")).alias("status"))


@query(f"""WITH {LEAF_SQL}, p AS (SELECT exam_id, CAST(sum(CASE WHEN flag <> 'A' THEN points ELSE 0 END) AS BIGINT) AS mandatory, CAST(sum(CASE WHEN flag = 'A' THEN points ELSE 0 END) AS BIGINT) AS optional,
    count(*) FILTER (flag = 'A') AS pool_size, CASE WHEN count(DISTINCT points) FILTER (flag = 'A') = 1 THEN min(points) FILTER (flag = 'A') END AS points_each FROM leaf GROUP BY exam_id)
SELECT *, CASE WHEN points_each > 0 AND mandatory < 200 AND (200 - mandatory) % points_each = 0 THEN (200 - mandatory) // points_each END AS choose FROM p""")
def q_optional_pool(spark: SparkSession, d: str) -> DataFrame:
    return scoring.optional_pool(plain_leaf(spark, d), ["exam_id"], F.col("flag") == "A", 200)


@query(f"""WITH {LEAF_SQL} SELECT exam_id, ord, points, CAST(200 - (sum(points) OVER (PARTITION BY exam_id) - points) AS BIGINT) AS remainder FROM leaf""")
def q_composition_remainder(spark: SparkSession, d: str) -> DataFrame:
    return scoring.remainder(leaf(spark, d), ["exam_id"], 200).select("exam_id", "ord", "points", "remainder")


@query(f"""WITH {LEAF_SQL} SELECT exam_id, ord, CAST(least(greatest(92 - CASE WHEN points < 3 THEN 25 ELSE 0 END - CASE WHEN flag = 'R' THEN 40 ELSE 0 END - CASE WHEN status = 'F' THEN 10 ELSE 0 END - CASE WHEN number > 5 THEN 30 ELSE 0 END, 10), 100) AS BIGINT) AS confidence FROM leaf""")
def q_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence in hundredths."""
    penalties = [(F.col("points") < 3, 25), (F.col("flag") == "R", 40), (F.col("status") == "F", 10), (F.col("number") > 5, 30)]
    return leaf(spark, d).select("exam_id", "ord", scoring.confidence(penalties).alias("confidence"))


RULES_SQL = f"""{LEAF_SQL}, t AS (SELECT exam_id, CAST(sum(points) AS BIGINT) AS total, count(*) FILTER (points = 0) AS missing, CAST(max(number) AS BIGINT) AS top FROM leaf GROUP BY exam_id),
issues AS (
    SELECT exam_id, 'HIGH' AS severity, 'MISSING_POINTS' AS code, CAST(number AS VARCHAR) AS number, '> 0' AS expected, CAST(points AS VARCHAR) AS actual FROM leaf WHERE points = 0
    UNION ALL SELECT exam_id, CASE WHEN abs(total - 200) > 10 THEN 'HIGH' ELSE 'MEDIUM' END, 'TOTAL_POINTS', NULL, '200', CAST(total AS VARCHAR) FROM t WHERE missing = 0 AND total <> 200
    UNION ALL SELECT exam_id, 'MEDIUM', 'DUPLICATE_NUMBER', CAST(number AS VARCHAR), '1', CAST(nth AS VARCHAR) FROM (SELECT *, row_number() OVER (PARTITION BY exam_id, number ORDER BY ord) AS nth FROM leaf) WHERE nth > 1
    UNION ALL SELECT exam_id, 'BLOCKER', 'NUMBER_GAP', CAST(n AS VARCHAR), CAST(n AS VARCHAR), NULL FROM (SELECT exam_id, unnest(generate_series(1, top)) AS n FROM t) g WHERE NOT EXISTS (SELECT 1 FROM leaf WHERE leaf.exam_id = g.exam_id AND leaf.number = g.n)
    UNION ALL SELECT exam_id, 'LOW', 'SUSPICIOUS_POINTS', CAST(number AS VARCHAR), '>= 3', CAST(points AS VARCHAR) FROM leaf WHERE points > 0 AND points < 3
    UNION ALL SELECT o_orderkey, 'BLOCKER', 'NO_QUESTIONS', NULL, '> 0', '0' FROM orders WHERE o_orderkey NOT IN (SELECT exam_id FROM leaf))"""


def issues(spark: SparkSession, d: str) -> DataFrame:
    return audit.exam_rules(plain_leaf(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("exam_id")))


@query(f"WITH {RULES_SQL} SELECT * FROM issues")
def q_rule_union(spark: SparkSession, d: str) -> DataFrame:
    return issues(spark, d)


@query(f"""WITH {RULES_SQL}, v AS (SELECT exam_id, count(*) FILTER (severity = 'BLOCKER') AS blocker, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium FROM issues GROUP BY exam_id)
SELECT *, CASE WHEN blocker > 0 OR high > 0 THEN 'FAIL' WHEN medium > 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM v""")
def q_audit_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return audit.verdicts(issues(spark, d))


@query(f"""WITH {RULES_SQL} SELECT exam_id, severity, code, number, CAST(CASE severity WHEN 'BLOCKER' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END AS BIGINT) AS severity_rank
FROM issues ORDER BY severity_rank, exam_id, code, number NULLS FIRST, expected, actual LIMIT 200""")
def q_top_issues(spark: SparkSession, d: str) -> DataFrame:
    """The report's first 200 issues."""
    ranked = issues(spark, d).withColumn("severity_rank", audit.rank(F.col("severity")))
    return ranked.orderBy("severity_rank", "exam_id", "code", F.col("number").asc_nulls_first(), "expected", "actual").limit(200).select("exam_id", "severity", "code", "number", "severity_rank")


@query(f"""WITH {RULES_SQL} SELECT exam_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM issues WHERE code IN ('NUMBER_GAP', 'MISSING_POINTS', 'NO_QUESTIONS') GROUP BY exam_id""")
def q_retryable_issues(spark: SparkSession, d: str) -> DataFrame:
    """Exams with codes that another run may mend (a fixed list, so each exam's set is bounded)."""
    retry = ["NUMBER_GAP", "MISSING_POINTS", "NO_QUESTIONS"]
    sets = issues(spark, d).groupBy("exam_id").agg(F.collect_set("code").alias("found"))
    both = F.array_intersect("found", F.array(*map(F.lit, retry)))
    return sets.filter(F.size(both) > 0).select("exam_id", F.array_join(F.array_sort(both), ",").alias("codes"))


@query(f"""WITH {LEAF_SQL}, f AS (SELECT exam_id, supp_id, CAST(sum(points) AS BIGINT) AS total, count(DISTINCT number) AS covered, bool_or(flag = 'A') AS has_pool FROM leaf GROUP BY exam_id, supp_id)
SELECT exam_id, supp_id, total, covered, has_pool FROM f QUALIFY row_number() OVER (PARTITION BY exam_id ORDER BY covered DESC, has_pool DESC, abs(total - 200), supp_id) = 1""")
def q_best_scoring_table(spark: SparkSession, d: str) -> DataFrame:
    """Of an exam's candidate tables the one that covers most, then has a pool, then comes nearest to 200; ties: the first."""
    tables = plain_leaf(spark, d).groupBy("exam_id", "supp_id").agg(F.sum("points").cast("bigint").alias("total"), F.countDistinct("number").alias("covered"), F.bool_or(F.col("flag") == "A").alias("has_pool"))
    best = tables.groupBy("exam_id").agg(F.max(F.struct("covered", "has_pool", (-F.abs(F.col("total") - 200)).alias("near"), (-F.col("supp_id")).alias("first"), "total", "supp_id")).alias("m"))
    return best.select("exam_id", *(F.col("m")[c].alias(c) for c in ("supp_id", "total", "covered", "has_pool")))


@query(f"""WITH RECURSIVE {LEAF_SQL.replace("leaf AS", "leaf AS MATERIALIZED")}, v AS (SELECT exam_id, list(points ORDER BY ord) AS a FROM leaf GROUP BY exam_id),
s AS (SELECT exam_id, a, 0 AS step FROM v UNION ALL SELECT exam_id, a[:len(a) - 1], step + 1 FROM s WHERE len(a) > 1 AND a[len(a)] * 2 = list_sum(a))
SELECT exam_id, CAST(len(a) AS BIGINT) AS kept, CAST(list_sum(a) AS BIGINT) AS total FROM s QUALIFY row_number() OVER (PARTITION BY exam_id ORDER BY step DESC) = 1""")
def q_tail_subtotals(spark: SparkSession, d: str) -> DataFrame:
    """Points of an exam in order, without last values that only add up those before; an exam's questions are few."""
    lists = leaf(spark, d).groupBy("exam_id").agg(F.array_sort(F.collect_list(F.struct("ord", "points"))).alias("a"))
    kept = lists.select("exam_id", sequences.without_subtotals(F.transform("a", lambda x: x["points"])).alias("a"))
    return kept.select("exam_id", F.size("a").cast("bigint").alias("kept"), F.aggregate("a", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))
