"""Corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assaylake.llm import decontaminate, language_id, ngram_join, packing, secret_scan
from assaylake.llm.common import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter, and null texts, go.

    Each row is judged by its own text: repeated rows and rows without a doc_id stay or go like any other.
    """
    return language_id.keep_identified(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8)."""
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; very long documents are held whole by their task."""
    return packing.pack(docs, most_units=150_000)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identified),
    ("ngram_jaccard", distinct_texts),
    ("decontamination", clean_of_benchmark),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: Language ID, the guess costs and the tokenizer can't be put in SQL; tests compare with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
