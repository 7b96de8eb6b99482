"""Queries beside their SQL on whole tables."""

from pathlib import Path

import duckdb
import pytest

from assaylake.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["op1_decontamination", "op4_embedding_dedup", "op7_chat_format", "op10_ngram_jaccard", "op11_spelling_variants", "op12_fingerprints", "op13_phrase_mining"])
def test_sql(spark, small, name):
    con = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    df = QUERIES[name](spark, small)
    found = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    assert got == sorted(found.fetchall(), key=repr)
