"""No text or number ends a job: large numbers, long texts, nulls and empties."""

import pytest
from pyspark.sql import functions as F

from assaylake.functions import exam_text as E
from assaylake.functions import text as T
from assaylake.operators import audit, layout, repair, rules, scoring_text
from assaylake.operators import sequences as seq

HARD = [None, "", "documentos 1 a 2000000000", "documento 99999999999 e documento 3", "9" * 30, "Documentos 5-2 e " + "documento 7 " * 80_000, "1. " + "x" * 1_000_000, "\n" * 5000 + "a)\n1. um"]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(HARD)], "root string, text string")


def test_span(spark):
    row = spark.range(1).select(T.span(F.lit(2), F.lit(5)).alias("a"), T.span(F.lit(1), F.lit(2_000_000_000)).alias("b"), T.span(F.lit(3), F.lit(2)).alias("c"), T.span(F.lit(None).cast("int"), F.lit(2)).alias("d"), T.span(F.lit(-(2**63)), F.lit(2**63 - 1)).alias("e")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == ([2, 3, 4, 5], [1, 2_000_000_000], [], None, [-(2**63), 2**63 - 1])


def test_document_references(hard):
    told = hard.select(scoring_text.document_references(F.col("text"), F.array(F.lit(2), F.lit(3), F.lit(7))).alias("some"), scoring_text.document_references(F.col("text"), F.array().cast("array<int>")).alias("any")).collect()
    assert [r.some for r in told] == [[], [], [2, 3, 7], [3], [], [2, 3, 7], [], []]
    assert [r["any"] for r in told] == [[], [], [1, 2_000_000_000], [3], [], [2, 3, 4, 5, 7], [], []]


def test_gaps(spark):
    numbers = spark.createDataFrame([("a", 1), ("a", 1_999_999_999), ("b", 2), ("b", 5), ("c", None)], "k string, n long")
    found = {(r.k, r.missing) for r in seq.gaps(numbers, ["k"], "n").collect()}
    assert found == {("a", 2), ("a", 1_999_999_998), ("b", 1), ("b", 3), ("b", 4)}
    q = spark.createDataFrame([("r", "grupo_i", str(n)) for n in (1, 3, 2_147_483_647)] + [("r", "grupo_ii", "9" * 30), ("r", "grupo_iii", None)], "root string, group_id string, number string")
    assert [r.actual for r in rules.number_gaps(q).collect()] == ["1,3,2147483647"]
    leaf = spark.createDataFrame([(1, 1, 100), (1, 2**62, 100)], "exam_id long, number long, points long")
    assert audit.exam_rules(leaf, leaf.select("exam_id").distinct()).filter("code = 'NUMBER_GAP'").count() == 0  # of so wide a gap both ends are there


@pytest.mark.parametrize("name", ["format_statement", "latex_to_plain", "fractions_to_latex", "math_spans", "latex_checks", "parse_json", "normalise_url", "fold_accents"])
def test_text_functions(hard, name):
    assert len(hard.select(getattr(T, name)(F.col("text")).alias("x")).collect()) == len(HARD)


@pytest.mark.parametrize("f", [E.choice_options, E.letter_options, E.roman_options, E.matching_columns, E.ordering_items, E.blank_markers, E.minimum_words, E.optional_pool, E.cover, E.without_scoring, repair.text_blanks, repair.lettered_options, repair.without_inline_options, repair.vertical_fractions], ids=lambda f: f.__name__)
def test_exam_functions(hard, f):
    assert len(hard.select(f(F.col("text")).alias("x")).collect()) == len(HARD)


def test_layout(spark, hard):
    blocks = hard.select("root", F.lit(1).alias("page"), F.lit(0).alias("pos"), F.lit("text").alias("type"), F.lit(1e300).alias("y0"), F.lit(1.0).alias("height"), "text")
    heights = blocks.select("root", "page").withColumn("height", F.lit(842.0))
    found, again = layout.segments(blocks, heights)
    assert {r.root for r in found.collect()} == {"6"} and again.isEmpty()
    assert layout.segments(blocks.limit(0), heights)[0].isEmpty()


FRACTIONS = [
    ("Sabe-se que:\n• dos alunos da escola são rapazes;\n• o resto são raparigas", "texto\n• 3\n2 dos alunos da escola são rapazes;\n", "Sabe-se que:\n• \\(\\frac{2}{3}\\) dos alunos da escola são rapazes;\n• o resto são raparigas"),
    ("Um total de dos alunos da escola; fim", "• 5\n 4 dos   alunos da escola;", "Um total de \\(\\frac{4}{5}\\) dos alunos da escola; fim"),
    ("já tem 2/3 dos alunos da escola", "• 3\n2 dos alunos da escola", "já tem 2/3 dos alunos da escola"),
    ("dos alunos", "• 3\n2 dos alunos", "dos alunos"),
    ("nada disto aqui", "• 3\n2 dos alunos da escola", "nada disto aqui"),
    ("zero dos alunos da escola", "• 0\n2 dos alunos da escola", "zero dos alunos da escola"),
    ("• \\( \\) dos alunos (da escola) $1 \\E fim", "• 7\n1 dos alunos (da escola) $1 \\E fim", "• \\(\\frac{1}{7}\\) dos alunos (da escola) $1 \\E fim"),
    (None, "• 3\n2 dos alunos da escola", None),
    ("sem texto de origem", None, "sem texto de origem"),
]


def test_fractions(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in FRACTIONS], "text string, raw string")
    assert [r.x for r in df.select(repair.with_fractions(F.col("text"), F.col("raw")).alias("x")).collect()] == [c for *_, c in FRACTIONS]


def test_normal_blanks(spark):
    schema = "blanks array<struct<number:string,options:array<struct<letter:string,text:string>>>>"
    rows = [([(None, [("1", " um  ."), ("1", "UM"), ("2", "dois COTAÇÕES 20")]), ("B", [("", "x"), ("1", "três")]), ("c).", None)],), (None,)]
    got = spark.createDataFrame(rows, schema).select(repair.normal_blanks(F.col("blanks")).alias("b"), repair.valid_blanks(F.col("blanks")).alias("v")).collect()
    assert [(b.number, [tuple(o) for o in b.options] if b.options is not None else None) for b in got[0].b] == [("a)", [("1", "um"), ("2", "dois")]), ("b)", [("1", "três")]), ("c)", None)]
    assert [r.v for r in got] == [False, False]


@pytest.mark.parametrize("f", [E.choice_options, E.letter_options, E.roman_options], ids=lambda f: f.__name__)
def test_texts_are_searched_once(hard, f):
    """A list that is used again is bound: the plan holds no search of a text twice over."""
    plan = hard.select(f(F.col("text")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 6


def test_null_texts_have_null_options(hard):
    got = hard.filter("root = '0'").select(E.choice_options(F.col("text")).alias("c"), E.letter_options(F.col("text")).alias("l"), E.roman_options(F.col("text")).alias("r"), E.matching_columns(F.col("text")).alias("m")).first()
    assert got.c is None and got.l is None and got.r is None and got.m is None
