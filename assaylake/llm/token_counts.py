"""Token counts through a cache of digests: only distinct texts that the cache lacks are encoded."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UnitCache, shared_dir

TOKENIZER = "piece_bpe_32k.model"
CACHE = "digest binary, tokenizer string, n_tokens bigint"


def tokenizer_file(name: str, path: str | None = None) -> str:
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(name: str, path: str | None = None) -> str:
    """Digest of the tokenizer's file: counts of another version are never used."""
    with open(tokenizer_file(name, path), "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def counter(name: str, path: str | None = None) -> UnitCache:
    """Numbers of tokens by the sentencepiece library, without begin and end tokens."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name, path))
    count = lambda text: len(model.encode(text, add_bos=False, add_eos=False))
    # its pieces hold the space mark at their start or throughout; the library itself puts one before a text
    return UnitCache(count, count, sum, ("▁",))


def content_digest(text: Column) -> Column:
    """Digest of the normalised content: null counts as the empty text; the tokenizer itself normalises nothing."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def encode_misses(misses: DataFrame, version: str, tokenizer: str, path: str | None) -> DataFrame:
    """(digest, text) -> rows of the cache."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = counter(tokenizer, path)
        for batch in batches:
            counts = [cache.value(x.as_py() or "") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    return misses.mapInArrow(run, CACHE)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none if the cache does not exist yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def count_tokens(docs: DataFrame, cache_path: str | None = None, tokenizer: str = TOKENIZER, tokenizer_path: str | None = None, limit: int = 4096) -> DataFrame:
    """One row per document row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Digests of content and of the tokenizer's file are joined to the cache at `cache_path` (default: the
    folder token_counts in the shared folder); distinct texts that it lacks are encoded once and appended.
    Texts are deduplicated where they are read before they move, so a text that fills a third of the table
    moves once per task.  A run that is cut short appends nothing, as Spark commits a write at its end; two
    runs at once may append the same rows, so the cache is read as distinct digests.

    Null text counts as empty (0 bytes).  Rows are kept as they are: repeated rows and null doc_ids each
    give a row.  An empty table gives no rows.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    cache_path = cache_path or f"{shared_dir(spark)}/token_counts"
    version = tokenizer_version(tokenizer, tokenizer_path)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", content_digest(F.col("text")))
    stored = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).select("digest")
    misses = keyed.groupBy("digest").agg(F.first("text").alias("text")).join(stored, "digest", "left_anti")
    encode_misses(misses, version, tokenizer, tokenizer_path).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    rows = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
