"""Every query beside its SQL in DuckDB, as multisets of rows; those without SQL must run."""

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from assaylake.plans import ORACLE_SQL, QUERIES


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str | bytes):
        return value
    if isinstance(value, int | float | decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime | datetime.date):
        return str(value)
    return repr(value)


def rows(names, found) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, small, oracle, name):
    df = QUERIES[name](spark, small)
    got = rows(df.columns, df.collect())
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLE_SQL:
        found = oracle.execute(ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        want = rows(names, found.fetchall())
        assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


@pytest.mark.parametrize("name", ["q_criteria_verdict", "q_document_sources", "q_labelled_documents", "q_recovered_from_scoring", "q_rules_criteria", "q_rules_validator"])
def test_files_do_not_plan_broadcasts(spark, tiny, name):
    """Exam tables are far larger in memory than in files: no broadcast is planned by the size of files."""
    plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["q_rules_portuguese", "q_rules_history", "q_segments", "q_criteria_match", "q_document_references", "q_retryable_history", "q_cover_sources", "q_segment_duplicates", "q_audit_summary", "q_warnings_report", "q_cover_source_refs", "q_labelled_documents"])
def test_exams_stay_in_their_buckets(spark, tiny, name):
    """What is joined, grouped or ordered within an exam is not dealt out again."""
    plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
