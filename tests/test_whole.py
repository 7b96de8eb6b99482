"""Queries that ask every row of their tables, where they once asked only some."""

from pyspark.sql import functions as F

from assaylake.operators import rules
from assaylake.plans import QUERIES
from assaylake.sources.exams import model
from assaylake.sources.tables import pages


def test_status_asks_all_warnings_and_questions(spark, tiny):
    """No exam passes as better than any of its warnings and reviewed questions."""
    status = {r.root: r.status for r in QUERIES["q_processing_status"](spark, tiny).collect()}
    ex = model(spark, tiny)
    found = rules.validator(ex, pages(spark, tiny).select(F.col("exam_id").cast("string").alias("root"), "text"))
    grave = {r.root for r in found.filter("lower(severity) IN ('critical', 'high')").select("root").distinct().collect()} & status.keys()
    asked = {r.root for r in rules.reviewed(ex).filter("needs_review").select("root").distinct().collect()} & status.keys()
    assert grave and {status[r] for r in grave} <= {"partial_failed", "needs_review"}
    assert asked and "completed" not in {status[r] for r in asked}
