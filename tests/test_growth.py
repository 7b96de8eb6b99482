"""Plans whose work must not multiply: the model is read once for each side, not once for each step."""

import pytest

from assaylake.operators import matching, profiles, rules
from assaylake.plans import QUERIES
from assaylake.sources.exams import Exams


@pytest.mark.parametrize("name", ["q_criteria_match", "q_unmatched_questions"])
def test_matching_reads_its_sides_once(spark, tiny, name):
    plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Join" not in plan and "Exchange" not in plan


def test_matching_of_odd_rows(spark):
    """Rows without an exam or a group match nothing; a question without an id stays free; equal points are paired once."""
    items = [(None, 1, "g", "1", 5), ("r", 1, None, "1", 5), ("r", 2, "g", "1", 5), ("r", 3, "g", "9", None), ("r", 4, "g", "8", None), ("s", 1, "", "7", 1), ("s", 2, "", "6", 2), ("t", 1, "g", "", 1)]
    questions = [(None, 1, "a", "g", "1", 5), ("r", 1, "b", " G ", "1.", 5), ("r", 2, "c", "g", "2", None), ("r", 3, None, "g", "3", 4), ("s", 1, "d", None, "1.10", 8), ("s", 2, "e", None, "1.9", 9), ("t", 1, "f", "g", "", 2)]
    a = spark.createDataFrame(items, "root string, ord long, group_id string, number string, points long")
    b = spark.createDataFrame(questions, "root string, ord long, question_id string, group_id string, number string, points long")
    out, left = matching.match_criteria(a, b)
    got = {(r.root, r.ord): (r.question_id, r.match) for r in out.collect()}
    assert got == {(None, 1): (None, None), ("r", 1): (None, None), ("r", 2): ("b", "exact"), ("r", 3): ("c", "points"), ("r", 4): (None, None), ("s", 1): ("d", "positional"), ("s", 2): ("e", "positional"), ("t", 1): (None, None)}
    assert sorted(map(str, ((r.root, r.question_id) for r in left.collect()))) == sorted(map(str, [(None, "a"), ("r", None), ("t", "f")]))


def test_normalised_in_one_pass(spark, tiny):
    """Nothing is written between, and no row moves."""
    plan = QUERIES["q_normalised"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "normalised-" not in plan and "Bucketed: true" in plan


def test_normalised_as_normalise(spark):
    """Both forms give the same questions and steps, odd rows included."""
    schema = "root string, ord long, number string, group_id string, parent string, type string, statement string, options array<string>, math_heavy boolean"
    rows = [("m", 1, "1", None, None, "open_answer", "Calcule 3/4 de x\nFIM\n", [], False), ("h", 1, "95", "g", None, "open_answer", "x", [], False), ("h", 2, " ii ", None, None, "x", "texto", [], None), ("h", 3, "II", None, "p", "x", "texto", None, None), ("p", 1, "1", "g", None, "multiple_choice", "Qual é? (A) um (B) dois", ["um"], False), ("p", 2, "1", "g", None, "x", "Leia atentamente o texto seguinte.", [], False), ("p", 3, None, None, None, None, "cotação e subtotal", [], True), ("z", 1, None, None, None, None, None, None, None), (None, 1, "31", "g", None, "x", "a\nFIM\n", [], True)]
    q, exams = spark.createDataFrame(rows, schema), spark.createDataFrame([("m", "Matemática A"), ("h", "História A"), ("p", "Português"), ("z", None)], "root string, subject string")
    kept, warned = profiles.normalise(q, exams)
    steps = {(r.root, r.ord): r.steps for r in warned.collect()}
    want = sorted(str((*r, steps.get((r.root, r.ord), []))) for r in kept.collect())
    assert len(want) == 5 and sorted(str(tuple(r)) for r in profiles.normalised(q, exams).collect()) == want


@pytest.mark.parametrize(("name", "most"), [("q_retryable_history", 16), ("q_rules_history", 16)])
def test_history_reads_the_model_for_few_passes(spark, tiny, name, most):
    """Rules on questions are one pass, those on sources another: the model is not read anew for each rule."""
    plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= most


def test_references_and_crops_of_odd_rows(spark):
    """Null names, exams without sources or files, files of one name twice, and crops of one picture."""
    exams = spark.createDataFrame([("a", 5), ("b", 5)], "root string, total_pages long")
    sources = spark.createDataFrame([("a", 1, "g_documento_1", "g", 2, None, "/x/assets/1", None, ["k", None], ["assets/9", None]), ("a", 2, "g_documento_x", "g", None, "text", None, None, None, []), ("a", 3, None, "g", 2, None, "assets/1", None, [], None), (None, 1, "z", "g", 2, None, None, None, [], [])],
        "root string, ord long, source_id string, group_id string, page_start long, render string, crop string, method string, children array<string>, child_crops array<string>")
    files = spark.createDataFrame([("a", "assets/1", 900, 79, "d"), ("a", "assets/1", 90, 90, "e"), ("a", None, 1, 1, "d")], "root string, rel string, width long, height long, digest string")
    refs = "array<struct<source_id:string,child_id:string>>"
    q = spark.createDataFrame([("a", "q1", "g", "1", [("g_documento_1", "k"), ("none", "no"), (None, None)], ["/x/assets/1", "assets/2", None, ""]), ("b", "q2", None, "2", [("g_documento_1", None)], None), ("b", "q3", None, "3", None, ["u"])], f"root string, question_id string, group_id string, number string, source_refs {refs}, media array<string>")
    ex = Exams(exams, q, None, sources, files, None, None)
    got = sorted((r.root, r.code, r.question_id, r.actual) for r in rules.row_rules(rules.beside_names(q, ex, exams), [], *rules.reference_rules()).collect())
    assert got == [("a", "BROKEN_CHILD_REF", "q1", "no"), ("a", "BROKEN_SOURCE_REF", "q1", ""), ("a", "BROKEN_SOURCE_REF", "q1", "none"), ("a", "MISSING_MEDIA_FILE", "q1", "assets/2"), ("b", "BROKEN_SOURCE_REF", "q2", "g_documento_1"), ("b", "MISSING_MEDIA_FILE", "q3", "u")]
    got = sorted((r.root, r.severity, r.code, r.question_id, r.group, r.actual) for r in rules.crop_rules(ex, exams).collect())
    small = ("a", "HIGH", "SUSPECT_CROP_TOO_SMALL")
    assert got == [("a", "BLOCKER", "MISSING_CHILD_CROP_FILE", "", "", "assets/9"), ("a", "HIGH", "DUPLICATE_SOURCE_CROPS", "", "g", "g_documento_1"), ("a", "HIGH", "DUPLICATE_SOURCE_CROPS", "", "g", "g_documento_1"), (*small, "", "g", "assets/1 (900x79)"), (*small, "g_documento_1", "g", "assets/1 (900x79)")]


def test_status_reads_reviewed_questions_once(spark, tiny):
    """What is asked of reviewed questions comes with them, not by a join with the questions again."""
    plan = QUERIES["q_processing_status"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 32
