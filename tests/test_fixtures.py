"""Small cases traced by hand (FIXTURES.md): order, guards and edges that the tables may not hold."""

import pytest
from pyspark.sql import functions as F

from assaylake.operators import joins, matching, rules, scoring, scoring_text, sequences
from assaylake.sources.exams import Exams
from assaylake.streaming import progress

ITEM = "root string, ord long, group_id string, number string, points long"
QUESTION = "root string, ord long, question_id string, group_id string, number string, points long"


def matched(spark, items, questions):
    a = spark.createDataFrame([("e", i, *x) for i, x in enumerate(items)], ITEM)
    b = spark.createDataFrame([("e", i, f"q{i}", *x) for i, x in enumerate(questions)], QUESTION)
    out, left = matching.match_criteria(a, b)
    return [(r.question_id, r.match, r.needs_review) for r in sorted(out.collect(), key=lambda r: r.ord)], sorted(r.question_id for r in left.collect())


def test_matching(spark):
    """F-2: exact, then by position in groups whose questions have parts."""
    items = [("grupo_i", "1", 20), ("grupo_i", "2", 13), ("grupo_ii", "1", 13), ("grupo_ii", "2", 13), ("grupo_iii", "1", 40)]
    questions = [("grupo_i", "1", 20), ("grupo_i", "2", 13), ("grupo_ii", "1.1", 13), ("grupo_ii", "1.2", 13), ("grupo_iii", "1", 40)]
    assert matched(spark, items, questions) == ([("q0", "exact", False), ("q1", "exact", False), ("q2", "positional", True), ("q3", "positional", True), ("q4", "exact", False)], [])


def test_matching_order(spark):
    """F-3: the only question of some points goes to the first item."""
    got = matched(spark, [("grupo_ii", "1", 13), ("grupo_ii", "2", 13)], [("grupo_ii", "1.1", 13)])
    assert got == ([("q0", "points", False), (None, None, True)], [])


@pytest.mark.parametrize(
    ("items", "questions", "want"),
    [
        ([("a", "B", 1)], [("a", "1.1", 2)], [(None, None, True)]),  # numbers that are not flat do not pair up by position
        ([("a", "1", 5), ("a", "1", 5)], [("A ", "1.", 7)], [("q0", "exact", False), ("q0", "exact", False)]),  # two items of one number share a question
        ([("a", "9", None)], [("a", "x", None)], [("q0", "points", False)]),  # no points equal no points
        ([("a", "9", 4), ("a", "8", 4)], [("a", "x", 4), ("a", "y", 4)], [(None, None, True)] * 2),  # two candidates: none
        ([("a", "10", 1), ("a", "2", 1)], [("a", "1.10", 2), ("a", "1.2", 2)], [("q0", "positional", True), ("q1", "positional", True)]),
    ],
)
def test_matching_guards(spark, items, questions, want):
    assert matched(spark, items, questions)[0] == want


@pytest.mark.parametrize(
    ("points", "total", "want"),
    [
        ([25, 25, 15, 15, 15, 20], 50, [10, 10, 7, 7, 7, 9]),  # F-6
        ([20, 30], 50, [20, 30]),
        ([300, 1], 50, [300, 1]),  # over five times
        ([5, 4], 50, [5, 4]),  # under two fifths
        ([0, None], 50, [0, 0]),
        ([1, 1, 1], 2, [1, 1, 1]),  # fewer points than rows
        ([30, 30, 0], 50, [25, 24, 1]),
        ([10, 10], None, [10, 10]),
    ],
)
def test_largest_remainder(spark, points, total, want):
    df = spark.createDataFrame([("e", i, p) for i, p in enumerate(points)], "exam string, ord long, points long")
    out = scoring.largest_remainder(df, ["exam"], "points", F.lit(total).cast("int"), ["ord"]).orderBy("ord").collect()
    assert [r.share for r in out] == want and (want != [25, 24, 1] or sum(want) == 50)


def test_page_groups(spark):
    """F-4."""
    texts = ["Prova 623", "GRUPO I\nDocumento 1", "1. Refira o autor", "GRUPO II", "COTAÇÕES GRUPO I"]
    pages = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "exam_id long, page long, text string")
    assert sorted((r.page, r.group_id) for r in scoring_text.page_groups(pages).collect()) == [(2, "grupo_i"), (3, "grupo_i"), (4, "grupo_ii")]


def test_scoring_columns(spark):
    """F-8."""
    lines = ["Grupo", "Item", "Cotação", "I", "1.", "2.", "3.", "10", "10", "10", "30", "II", "1.", "2.", "20", "20", "40"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "exam_id long, line_no long, line string")
    assert sorted((r.group_id, r["item"], r.points) for r in scoring_text.scoring_columns(df).collect()) == [("grupo_i", 1, 10), ("grupo_i", 2, 10), ("grupo_i", 3, 10), ("grupo_ii", 1, 20), ("grupo_ii", 2, 20)]


def test_subtotals(spark):
    """F-7."""
    df = spark.createDataFrame([([10, 10, 10, 30],), ([5, 5],), ([7],)], "a array<long>")
    assert [r.a for r in df.select(sequences.without_subtotals(F.col("a")).alias("a")).collect()] == [[10, 10, 10], [5], [7]]


def exam(spark, questions, subject="Matemática A", **more):
    names = "root string, ord long, question_id string, group_id string, number string, type string, points long, statement string, raw_text string, options array<string>, visual boolean, is_group boolean, parent string, text_status string"
    q = spark.createDataFrame([("e", i, *x) for i, x in enumerate(questions)], names)
    exams = spark.createDataFrame([("e", subject, False)], "root string, subject string, pool boolean")
    policy = spark.createDataFrame(more.get("policy", []), "root string, mandatory boolean")
    return Exams(exams, q, None, None, None, policy, None)


def test_generic_rules(spark):
    """F-10: with points missing there is no word of the total."""
    good = "Explique a ideia principal."
    rows = [("q1", None, "1", "open_answer", 100, good, "", [], False, False, None, "ok"), ("q2", None, "2", "multiple_choice", 50, good, "", ["a", "b", ""], False, False, None, "ok"), ("q3", None, "3", "open_answer", None, good, "", [], False, False, None, "ok")]
    found = rules.generic(exam(spark, rows)).collect()
    assert sorted((r.severity, r.code, r.question_id) for r in found) == [("HIGH", "GENERIC_MC_OPTIONS", "q2"), ("HIGH", "GENERIC_MISSING_POINTS", "q3")]
    none = rules.generic(exam(spark, [])).collect()
    assert [(r.severity, r.code) for r in none] == [("BLOCKER", "GENERIC_NO_QUESTIONS")]


def test_number_rules(spark):
    """F-9: ungrouped 2, 3, 5."""
    rows = [(f"q{n}", None, n, "open_answer", 5, "", "", [], False, False, None, "ok") for n in ("2", "3", "5", "3.1")]
    (got,) = rules.main_numbers(exam(spark, rows).questions).collect()
    assert got.found == [2, 3, 5] and not got.grouped


def test_ancestors(spark):
    chain = [(i, i - 1 if i else None) for i in range(100)]
    got = joins.ancestors(spark.createDataFrame(chain, "id long, parent long"))
    assert sorted(map(tuple, got.collect())) == [(i, j, i - j) for i in range(100) for j in range(i)]
    assert joins.ancestors(spark.createDataFrame([], "id long, parent long")).count() == 0
    with pytest.raises(RuntimeError):
        joins.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent long"))


def test_progress_goes_on(spark, tmp_path):
    """A second run over the same folder takes up new files only and gives the states of all."""
    rows = lambda *x: spark.createDataFrame([(u, s, t, i) for i, (u, s, t) in enumerate(x)], "user_id long, event_type string, ts long, event_id long").selectExpr("user_id", "event_type", "timestamp_seconds(ts) AS ts", "event_id")
    path, state = str(tmp_path / "events"), str(tmp_path / "state")
    rows((1, "signup", 1), (2, "view", 2)).coalesce(1).write.parquet(path)
    first = {r.exam_id: r.stage for r in progress.run_to_end(spark, path, state).collect()}
    rows((1, "click", 9), (3, "signup", 3)).coalesce(1).write.mode("append").parquet(path)
    again = {r.exam_id: (r.stage, r.percent) for r in progress.run_to_end(spark, path, state).collect()}
    assert first == {1: "signup", 2: "view"} and again == {1: ("click", 60), 2: ("view", 40), 3: ("signup", 10)}
    assert spark.read.parquet(f"{state}/changes").filter("batch = 1").count() == 2
