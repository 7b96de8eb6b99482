import shutil

import corpus_pipeline
from assaylake.llm import decontaminate, ngram_join, secret_scan

from .test_tokens import check_packing, library  # noqa: F401


def test_stages(spark, tiny, library):  # noqa: F811
    """Every stage on its predecessor's rows: what goes, what stays, and what changes."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "secret_scan", "packing"]
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    schema, items = docs.schema, spark.read.parquet(f"{tiny}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tiny)
        assert docs.schema == schema
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert after == {i: r for i, r in rows.items() if any(map(str.isalpha, r.text or ""))}
        if name == "ngram_jaccard":
            before = spark.createDataFrame(list(rows.values()), schema)
            parts = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(before, 5, 80, 100).collect()}
            assert after == {i: r for i, r in rows.items() if parts[i] == i} and len(after) < len(rows)
        if name == "decontamination":
            hit = {r.doc_id for r in decontaminate.find_contamination(spark.createDataFrame(list(rows.values()), schema), items).collect() if r.contaminated}
            assert hit and after == {i: r for i, r in rows.items() if i not in hit}
        if name == "secret_scan":
            cost = secret_scan.Guesses(secret_scan.learn_ranks(spark.createDataFrame(list(rows.values()), schema)))
            assert {i: r.text for i, r in after.items()} == {i: secret_scan.redacted(r.text, cost=cost) for i, r in rows.items()}
        rows = after
        docs = spark.createDataFrame(list(rows.values()), schema)
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, tiny).collect(), [(i, r.text) for i, r in rows.items()], library)


def test_run(spark, tiny, library):  # noqa: F811
    """The whole pipeline packs what its stages leave, one after the other, of the whole table."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, tiny).collect(), docs.schema)
    left = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(left) > 100
    check_packing(corpus_pipeline.run(spark, tiny).collect(), left, library)


def test_run_on_odd_tables(spark, tiny, tmp_path, library):  # noqa: F811
    """Null texts, null and repeated ids, repeated rows, clashing columns, and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id long, DIGEST string, row string"
    long, other = "the quick brown fox jumps over the lazy dog near the river bank", "many small words stand here in one line and say nothing more"
    rows = [(1, long, "en", None), (1, long, "en", None), (2, long, "en", "s"), (2, other, "en", "s"), (None, other + " at all", None, None), (3, None, "en", "s"), (4, "", None, None), (5, "12 34", "en", "s"), (6, "password = hunter2hunter2", "en", "s"), (None, None, None, None)]
    for name, given in (("odd", rows), ("empty", [])):
        folder = tmp_path / name
        spark.createDataFrame([(*r, None, None, "d", "r") for r in given], schema).write.parquet(str(folder / "documents.parquet"))
        shutil.copy(f"{tiny}/benchmark.parquet", folder / "benchmark.parquet")
        got = corpus_pipeline.run(spark, str(folder)).collect()
        ids = sorted({str(r.doc_id) for r in got})
        assert ids == (["1", "2", "6", "None"] if given else [])
        assert sum(1 for r in got if r.doc_id == 1 and r.start == 0) == (1 if given else 0)
