"""Criteria documents as lists of pages: each different one is parsed once, and every exam gets its own items."""

import random
from collections import Counter

from pyspark.sql import functions as F

from assaylake.operators import criteria_text
from assaylake.plans import QUERIES
from assaylake.plans.criteria import DOCUMENTS

DOC = "root string, pages array<struct<page:bigint,text:string>>"


def test_exams_of_equal_and_odd_documents(spark):
    """Shuffled lines, pages out of order, equal documents, pages without text, no pages at all: as if every exam were parsed by itself."""
    rng = random.Random(5)
    lines = [line for doc in DOCUMENTS for page in doc for line in page.split("\n")]
    made = []
    for doc in DOCUMENTS:
        made.append([(i + 1, t) for i, t in enumerate(doc)])
        made.append([(2, doc[-1]), (1, doc[0])])
        made.append([(1, "\n".join(rng.sample(lines, 40)))])
        made.append([(1, "GRUPO I\n" + "\n".join(rng.sample(lines, 20))), (None, "GRUPO II\n1. x ........ 4 pontos"), (3, None)])
    made += [[], None, [(1, None)], [(1, "")]]
    rows = [(f"r{i}", made[i % len(made)]) for i in range(2 * len(made) + 3)]
    df = spark.createDataFrame(rows, DOC)
    got = criteria_text.parse_documents(df)
    want = criteria_text.parse(df.select("root", F.inline("pages")))
    assert got.columns == want.columns
    told = lambda x: Counter(str(tuple(r)) for r in x.collect())
    assert told(got) == told(want) and sum(told(want).values()) > 40


def test_each_document_is_parsed_once(spark, tiny):
    """The windows of the parser run over different documents, not over those of every exam."""
    for name in ("q_criteria_parse", "q_answer_keys"):
        df = QUERIES[name](spark, tiny)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "keys=[pages" in plan and plan.index("Join") < plan.index("Window")
