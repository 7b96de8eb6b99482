"""Rules of any exam that yield issues(exam_id, severity, code, number, expected, actual), and what follows from issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import span

SEVERITIES = ["BLOCKER", "HIGH", "MEDIUM", "LOW", "INFO"]
ISSUE = ["exam_id", "severity", "code", "number", "expected", "actual"]


def rank(severity: Column) -> Column:
    """0 for the gravest; unknown severities come last."""
    cases = F.lit(len(SEVERITIES))
    for i, name in reversed(list(enumerate(SEVERITIES))):
        cases = F.when(F.upper(severity) == name, F.lit(i)).otherwise(cases)
    return cases.cast("bigint")


def exam_rules(leaf: DataFrame, exams: DataFrame, total: int = 200, slack: int = 10, low: int = 3) -> DataFrame:
    """Issues of exams from leaf(exam_id, number, points) and exams(exam_id).

    Rows are counted once by number and once by exam; what the rules of an exam need is one row of few numbers, so
    all rules are one pass over these rows.  Rules on single questions are one pass over the leaves.
    """
    points = F.coalesce("points", F.lit(0))
    by_number = leaf.groupBy("exam_id", "number").agg(F.count("*").alias("n"), F.sum(points).alias("points"), F.count_if(points == 0).alias("missing"))
    by_exam = by_number.groupBy("exam_id").agg(F.sum("points").alias("total"), F.sum("missing").alias("missing"), F.array_sort(F.collect_list(F.struct("number", "n"))).alias("found"))
    df = exams.join(by_exam, "exam_id", "left")
    row = lambda severity, code, number=None, expected=None, actual=None: F.struct(*(F.lit(c).cast("string").alias(n) if not isinstance(c, Column) else c.cast("string").alias(n) for n, c in zip(ISSUE[1:], (severity, code, number, expected, actual), strict=True)))
    one = lambda when, issue: F.when(when, F.array(issue)).otherwise(F.array().cast("array<struct<severity:string,code:string,number:string,expected:string,actual:string>>"))
    off, numbers = F.abs(F.col("total") - total), F.transform("found", lambda x: x["number"])
    gaps = F.array_except(span(F.lit(1).cast("bigint"), F.array_max(numbers)), numbers)
    lists = [
        one(F.col("total").isNull(), row("BLOCKER", "NO_QUESTIONS", None, "> 0", "0")),
        one((F.col("missing") == 0) & (off > 0), row(F.when(off > slack, "HIGH").otherwise("MEDIUM"), "TOTAL_POINTS", None, str(total), F.col("total"))),
        F.transform(F.coalesce(F.when(F.array_max(numbers) >= 1, gaps), F.array().cast("array<bigint>")), lambda n: row("BLOCKER", "NUMBER_GAP", n, n)),
        F.coalesce(F.flatten(F.transform(F.filter("found", lambda x: x["n"] > 1), lambda x: F.transform(F.sequence(F.lit(2).cast("bigint"), x["n"]), lambda nth: row("MEDIUM", "DUPLICATE_NUMBER", x["number"], "1", nth)))), F.array().cast("array<struct<severity:string,code:string,number:string,expected:string,actual:string>>")),
    ]
    rows = F.array_compact(F.array(
        F.when(points == 0, row("HIGH", "MISSING_POINTS", F.col("number"), "> 0", F.col("points"))),
        F.when((points > 0) & (points < low), row("LOW", "SUSPICIOUS_POINTS", F.col("number"), f">= {low}", F.col("points"))),
    ))
    return df.select("exam_id", F.inline(F.concat(*lists))).unionByName(leaf.select("exam_id", F.inline(rows)))


def verdicts(issues: DataFrame) -> DataFrame:
    """Per exam: issues by severity and PASS, REVIEW or FAIL (any blocker or high)."""
    counts = [F.count_if(F.upper("severity") == s).alias(s.lower()) for s in SEVERITIES[:3]]
    verdict = F.when((F.col("blocker") > 0) | (F.col("high") > 0), "FAIL").when(F.col("medium") > 0, "REVIEW").otherwise("PASS")
    return issues.groupBy("exam_id").agg(*counts).withColumn("verdict", verdict)


def status(failed: Column, review: Column, warned: Column) -> Column:
    """Processing status: the gravest flag that holds."""
    return F.when(failed, "partial_failed").when(review, "needs_review").when(warned, "completed_with_warnings").otherwise("completed")
