"""Blanks of pages: nothing is searched anew for each of its uses, and odd rows come out as before."""

from pyspark.sql import functions as F

from assaylake.operators import repair

ROWS = [
    (1, [[["a)", None, "x"], [" 2) dois", "1. um", "3. x"], ["1. um", "2. y"], ["01. zero", None], ["2 outra"]], [], [["A) "], ["3. três"]]], "c)\n1. nunca"),
    (2, [[["x"], ["1. um"]]], "a)\n2) dois\n1. um\nB) __\ntexto\na)\n1. outra\n"),
    (3, None, "veja a) e f) aqui"),
    (4, [], None),
    (5, [[]], ""),
]
WANT = {1: "a)=1=um,01=zero,2=dois,3=três", 2: "a)=1=um,2=dois b)=", 3: "a)= f)=", 4: "a)= b)= c)= d)=", 5: "a)= b)= c)= d)="}


def test_page_blanks(spark):
    df = spark.createDataFrame(ROWS, "id long, t array<array<array<string>>>, b string").select("id", repair.page_blanks(F.col("t"), F.col("b")).alias("x"))
    got = {r.id: " ".join(f"{b.number}=" + ",".join(f"{o.letter}={o.text}" for o in b.options) for b in r.x) for r in df.collect()}
    assert got == WANT


def test_patterns_are_searched_once(spark):
    df = spark.createDataFrame(ROWS, "id long, t array<array<array<string>>>, b string").select(repair.page_blanks(F.col("t"), F.col("b")).alias("x"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract") <= 8 and plan.count("split(") <= 2
