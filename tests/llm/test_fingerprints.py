"""Fingerprints: SQL over odd rows, both ways to the lexicon, likeness of edited texts."""

import hashlib
import random
import re

import duckdb
import pytest

from assaylake.llm import fingerprints as fp
from assaylake.llm.oracles import FINGERPRINTS

from .helpers import documents


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(900)]
    return [(3 * i, " ".join(rng.choices(words, k=rng.randint(0, 90)))) for i in range(n)]


ODD = [(None, "no id at all"), (None, None), (9, "second text of nine"), (9, "second text of nine"), (12, None), (15, ""), (18, "-- ++"), (21, "x" * 50_000 + " end"), (24, " ".join(f"u{i}" for i in range(20_000))), (27, "Ünï 日本語 🙂 " * 7)]


def sql_rows(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in con.sql(FINGERPRINTS).fetchall())


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_sql_on_odd_rows(spark, most):
    """The broadcast value and the join by term give the rows of the SQL."""
    rows = corpus(1) + ODD
    found = fp.compare_with_edits(documents(spark, rows).withColumnsRenamed({"lang": "head", "source": "digest", "score": "next"}), most=most)
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, found.collect())) == sql_rows(rows)


def test_one_and_none(spark):
    assert fp.compare_with_edits(documents(spark, [])).collect() == []
    (r,) = fp.compare_with_edits(documents(spark, [(5, "abcdefgh")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0


def test_equal_texts_and_edits(spark):
    """Equal texts share a fingerprint; texts with a quarter changed are far more like than others."""
    rows = corpus(2) + [(10_000 + i, text) for i, text in corpus(2)]
    found = fp.compare_with_edits(documents(spark, rows)).collect()
    by_text, text_of = {}, dict(rows)
    for r in found:
        by_text.setdefault(text_of[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    long = [r for r in found if r.n_chars > 100]
    assert sum(r.near_edited for r in long) / len(long) > 0.4
    assert sum(r.near_next for r in long) / len(long) < 0.1
    assert sum(r.near_edited > r.near_next for r in long) >= 0.97 * len(long)


def test_band(spark):
    docs = documents(spark, [(i, " ".join(["all"] + ["half"] * (i % 2) + [f"t{i // 4}"] + ["own"] * (i == 7))) for i in range(400)])
    number = {w: int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in ["all", "half", "own", *(f"t{k}" for k in range(100))]}
    found = {r.term: r.df for r in fp.band(docs, rare=200, common=10).collect()}
    assert found == {number[f"t{k}"]: 4 for k in range(100)}


def test_general_interface(spark):
    docs = documents(spark, [(1, "one two"), (2, "one two"), (3, None), (None, "")])
    got = fp.fingerprint(docs).select("doc_id", "fingerprint", "source").collect()
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[1] == prints[2] != prints[3] == prints[None] == "x." + hashlib.md5(b"").hexdigest()


def test_lexicon_is_no_column(spark, tiny):
    """The lexicon stands in an expression; no operator passes it on with each row."""
    rows = documents(spark, corpus(3)).withColumn("kept", fp.terms("text"))
    plan = fp._in_band(rows, "kept", spark.range(5).withColumnRenamed("id", "term"), 10)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"(AS|,) lexicon#", plan.split("Subquery")[0]) and "scalar-subquery" in plan
