"""The numbered queries of this folder, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, embedding_dedup, fingerprints, html_extract, language_id, license_scan, ngram_join, oracles, packing, phrase_mining, secret_scan, spelling_variants, token_counts
from .common import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    # a cache of its own: every run encodes what it is given
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"  # control strings of other templates, and this one's escape
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat_format.format_conversations(told.unionByName(more)).drop("expanded_tokens")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(spelling_variants.count_words(table(spark, sf_dir, "documents"), slip=199))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mine_phrases(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_token_counts, op3_license_scan, op4_embedding_dedup, op5_html_extraction, op6_language_id, op7_chat_format, op8_secret_scan, op9_packing, op10_ngram_jaccard, op11_spelling_variants, op12_fingerprints, op13_phrase_mining)}


def license_sql() -> str:
    """op3 as SQL: every phrase tried at every word, every block compared with every template."""
    word, ends = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", license_scan.LINES
    lower = f"translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}')"
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    at = {label: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) for label, phrase in license_scan.PHRASES.items()}
    places = ", ".join(f"[i - 1 FOR i IN range(1, len(w) + 1) IF {test}] AS p{k}" for k, test in enumerate(at.values()))
    lists = [f"p{k}" for k in range(len(at))]
    named = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(at))
    sets = ", ".join(f"('{label}', [{quoted(words)}], {ceil(0.9 * len(words) - 1e-9)}, {license_scan.WIDE * len(words)})" for label, words in license_scan.template_sets(license_scan.TEMPLATES))
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all({lower}, '{word}') AS w, {lower} AS low FROM documents),
p AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, {places} FROM d),
b AS (SELECT doc_id, n_words, list_concat({", ".join(lists)}) AS spots, list_filter([{named}], lambda x: x IS NOT NULL) AS base FROM p),
lines AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, list_transform(regexp_split_to_array(low, '{ends}'), lambda x: regexp_extract_all(x, '{word}')) AS l FROM d)),
ends AS (SELECT doc_id, l, i FROM lines WHERE len(l[i]) > 0 AND (i = 1 OR len(l[i - 1]) = 0)),
paragraphs AS (SELECT doc_id, flatten(list_slice(l, i, i - 1 + coalesce(nullif(list_position(list_transform(l[i:], lambda x: len(x) = 0), true), 0) - 1, len(l)))) AS w FROM ends),
t(label, words, need, width) AS (VALUES {sets}),
met AS (SELECT doc_id, label, words, need, width, w FROM paragraphs, t WHERE len(list_intersect(w, words)) >= need),
m AS (SELECT doc_id, label, list_max(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains(words, w[i]) THEN len(list_intersect(w[i:i + width - 1], words)) ELSE 0 END)) AS held, words, need FROM met),
g AS (SELECT doc_id, list(DISTINCT label) AS more, max(held / len(words)) AS share FROM m WHERE held >= need GROUP BY doc_id)
SELECT b.doc_id, n_words, CAST(len(spots) AS BIGINT) AS n_base, CAST(list_min(spots) AS BIGINT) AS first_word, CAST(list_max(spots) AS BIGINT) AS last_word,
coalesce(array_to_string(list_sort(base), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ','), '') AS labels,
CASE WHEN len(spots) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM b LEFT JOIN g ON b.doc_id = g.doc_id"""


#: SQL where it can express a query; the others need tokenizers or trained models.
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": oracles.DECONTAMINATION, "op3_license_scan": license_sql(), "op4_embedding_dedup": oracles.EMBEDDINGS,
    "op7_chat_format": oracles.CONVERSATIONS, "op10_ngram_jaccard": oracles.JACCARD, "op11_spelling_variants": oracles.VARIANTS, "op12_fingerprints": oracles.FINGERPRINTS, "op13_phrase_mining": oracles.PHRASES,
}
