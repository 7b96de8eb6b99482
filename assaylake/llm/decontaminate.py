"""Benchmark decontamination: a hash set of normalised benchmark n-grams, scanned along the documents' words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, WordHashes, materialize, simple_words, windows

#: The broadcast set may hold so many windows (each about 200 bytes in a task); beyond, windows meet in a shuffle.
MOST_BROADCAST_WINDOWS = 500_000

#: Bits of the table through which windows go before that shuffle: 2 MB, at every size of benchmark.
FILTER_BITS = 24

REPORT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, hit_spans array<struct<start:bigint,end:bigint>>"


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(size, window, item_id): every n consecutive words of an item; an item of fewer words, but not none, is one window."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = simple_words((text or "").encode())
                k = min(n, len(w))
                if item is not None and k:
                    rows |= {(k, b" ".join(w[i : i + k]), item) for i in range(len(w) - k + 1)}
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], ["size", "window", "item_id"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(scan, "size int, window binary, item_id long").distinct()


class HitSet:
    """The windows by size: sorted hashes with a bit table before them, and the words themselves for the final test."""

    BITS = 22

    def __init__(self, rows: list[tuple[int, bytes, int]]):
        items: dict[bytes, list[int]] = {}
        sizes: dict[int, set[bytes]] = {}
        for size, window, item in rows:
            items.setdefault(bytes(window), []).append(item)
            sizes.setdefault(size, set()).add(bytes(window))
        self.items = {w: tuple(sorted(i)) for w, i in items.items()}
        hashes = WordHashes()
        self.sizes = []
        for size, found in sorted(sizes.items()):
            h = np.sort(np.array([windows(hashes.of(w.split(b" ")), size)[0] for w in found], dtype=np.uint64))
            bits = np.zeros(1 << self.BITS, dtype=bool)
            bits[h >> np.uint64(64 - self.BITS)] = True
            self.sizes.append((size, h, bits))

    def hits(self, words: list[bytes], hashes: WordHashes) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(start, size, items) of every occurrence in the words, verified word by word."""
        if not words or not self.sizes:
            return
        h = hashes.of(words)
        for size, known, bits in self.sizes:
            got = windows(h, size)
            for at in np.flatnonzero(bits[got >> np.uint64(64 - self.BITS)]):
                k = np.searchsorted(known, got[at])
                if k < len(known) and known[k] == got[at] and (items := self.items.get(b" ".join(words[at : at + size]))):
                    yield int(at), size, items


def summary(n_words: int, hits: list[tuple[int, int]], items) -> tuple:
    """A report row without doc_id: words, hit words, items, their digest, whether any, and merged spans of hit words."""
    spans: list[list[int]] = []
    for start, size in sorted(hits):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], start + size)
        else:
            spans.append([start, start + size])
    n_hit = sum(b - a for a, b in spans)
    ids = sorted(map(str, set(items)))
    return n_words, n_hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), n_hit > 0, [{"start": a, "end": b} for a, b in spans]


def _report_batch(ids, rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 6
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    arrays = [pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"])


def broadcast_hits(docs: DataFrame, benchmark: DataFrame, n: int, most: int):
    """The broadcast hit set, or None if the benchmark has more than `most` windows."""
    rows = benchmark_windows(benchmark, n).limit(most + 1).collect()  # bounded by `most`
    if len(rows) > most:
        return None
    return docs.sparkSession.sparkContext.broadcast(HitSet([tuple(r) for r in rows]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, most_broadcast: int = MOST_BROADCAST_WINDOWS) -> DataFrame:
    """One report row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans.

    Words: runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z.  A document word inside any
    occurrence of a benchmark window is hit.  Up to `most_broadcast` windows the set is broadcast and the
    documents are scanned where they are read; beyond it, those windows of the documents that a table of hashes
    marks meet the benchmark's in a shuffle join by their words.

    Null text has no words and no hits.  Null item_id or item text is no window.  Empty benchmark: nothing is
    hit.  Repeated rows give a row each.  Rows with a null doc_id are reported under null.  Extra columns
    are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = broadcast_hits(docs, benchmark, n, most_broadcast)
    if shared is None:
        return _shuffled(docs, benchmark, n)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, hashes = shared.value, WordHashes()
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = simple_words((text.as_py() or "").encode())
                hits = list(found.hits(words, hashes))
                rows.append(summary(len(words), [(a, s) for a, s, _ in hits], {i for _, _, items in hits for i in items}))
            yield _report_batch(batch.column("doc_id"), rows)

    return docs.mapInArrow(scan, REPORT)


def _shuffled(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """The same report for any size of benchmark."""
    base, hits = _met(docs.withColumn("row", F.monotonically_increasing_id()), benchmark, n)
    w = base.join(hits.groupBy("row").agg(F.collect_set(F.struct("start", "size")).alias("hits"), F.collect_set("item_id").alias("items")), "row", "left")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [summary(r["n_words"], [(x["start"], x["size"]) for x in r["hits"] or []], r["items"] or []) for r in batch.select(["n_words", "hits", "items"]).to_pylist()]
            yield _report_batch(batch.column("doc_id"), rows)

    return w.select("doc_id", "n_words", "hits", "items").mapInArrow(close, REPORT)


def _window_bits(known: DataFrame) -> np.ndarray:
    """A table of fixed size that marks the hashes of all known windows (and, by chance, of others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = np.zeros(1 << FILTER_BITS, dtype=bool), WordHashes()
        for batch in batches:
            for size, window in zip(batch.column("size").to_pylist(), batch.column("window").to_pylist(), strict=True):
                bits[windows(hashes.of(window.split(b" ")), size) >> np.uint64(64 - FILTER_BITS)] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(np.packbits(bits).tobytes())], pa.binary())], ["data"])

    out = np.zeros(1 << FILTER_BITS - 3, dtype=np.uint8)
    for row in known.select("size", "window").coalesce(64).mapInArrow(run, "data binary").toLocalIterator():
        out |= np.frombuffer(zstandard.decompress(row["data"]), dtype=np.uint8)
    return out


def _met(docs: DataFrame, benchmark: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """docs(row, doc_id, text) -> (row, doc_id, n_words) and distinct (row, start, size, item_id).

    Only windows whose hash the table of known ones marks leave their task; there they meet the benchmark's by words.
    The documents are read once.
    """
    known = materialize(benchmark_windows(benchmark, n).withColumn("key", F.xxhash64("window", "size")), "known-windows")
    sizes = [r[0] for r in known.select("size").distinct().collect()]  # at most n values
    marks = docs.sparkSession.sparkContext.broadcast(_window_bits(known))
    row_type = docs.schema["row"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = np.unpackbits(marks.value).view(bool), WordHashes()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
        for batch in batches:
            for row, doc, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                w = simple_words((text.as_py() or "").encode())
                h = hashes.of(w)
                found = [(doc, None, 0, None, len(w))]  # size 0: the row that counts the words
                for size in sizes:
                    got = windows(h, size)
                    found += [(doc, int(i), size, b" ".join(w[i : i + size]), len(w)) for i in np.flatnonzero(bits[got >> np.uint64(64 - FILTER_BITS)])]
                for at in range(0, len(found), 5000):
                    cols = list(zip(*found[at : at + 5000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(cols[0]), batch.schema.field("row").type), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["row", "doc_id", "start", "size", "window", "n_words"])

    rows = materialize(docs.mapInArrow(cut, f"row {row_type}, doc_id long, start long, size int, window binary, n_words long"), "marked-windows")
    base = rows.filter("size = 0").select("row", "doc_id", "n_words")
    hits = rows.filter("size > 0").withColumn("key", F.xxhash64("window", "size")).join(known, ["key", "size", "window"]).select("row", "start", F.col("size").cast("long").alias("size"), "item_id").distinct()
    return base, hits


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the given word spans and what stands between them."""
    data = text.encode()
    marks = np.frombuffer(b" " + data.translate(WORD_BYTES) + b" ", dtype=np.uint8) != 32
    starts, ends = np.flatnonzero(~marks[:-1] & marks[1:]), np.flatnonzero(marks[:-1] & ~marks[1:])
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, data[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "document", most_broadcast: int = MOST_BROADCAST_WINDOWS) -> DataFrame:
    """docs, all columns as they are, without hit documents (mode "document") or without the hit spans (mode "span").

    With mode "span", n_chars is set to the new text's length where the column exists.  Rows with null text stay.
    Each row is judged by its own text, whatever its doc_id and the size of the benchmark.
    """
    if mode not in ("document", "span"):
        raise ValueError(mode)
    shared = broadcast_hits(docs, benchmark, n, most_broadcast)
    if shared is None:
        digest = F.unhex(F.sha2(docs["text"], 256))  # null for null text, which has no hits
        _, hits = _met(docs.select(digest.alias("row"), F.lit(None).cast("long").alias("doc_id"), "text"), benchmark, n)
        hits = hits.withColumnRenamed("row", "__hit")
        if mode == "document":
            return docs.join(hits.select("__hit").distinct(), digest == F.col("__hit"), "left_anti")
        hits = hits.groupBy("__hit").agg(F.collect_set(F.struct("start", "size")).alias("__hits"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = []
                for text, found in zip(batch.column("text").to_pylist(), batch.column("__hits").to_pylist(), strict=True):
                    spans = summary(0, [(x["start"], x["size"]) for x in found or []], ())[-1]
                    new.append(remove_spans(text, [(x["start"], x["end"]) for x in spans]) if spans else text)
                yield with_text(batch.drop_columns(["__hits"]), new)

        return docs.join(hits, digest == F.col("__hit"), "left").drop("__hit").mapInArrow(cut, docs.schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, hashes = shared.value, WordHashes()
        for batch in batches:
            keep, new = [], []
            for value in batch.column("text"):
                text = value.as_py()
                words = simple_words((text or "").encode())
                hits = [(a, s) for a, s, _ in found.hits(words, hashes)]
                keep.append(not hits)
                if mode == "span":
                    new.append(remove_spans(text, [(x["start"], x["end"]) for x in summary(len(words), hits, ())[-1]]) if hits else text)
            if mode == "document":
                yield batch.filter(pa.array(keep, pa.bool_()))
            else:
                yield with_text(batch, new)

    return docs.mapInArrow(scan, docs.schema)


def with_text(batch: pa.RecordBatch, new: list) -> pa.RecordBatch:
    """The batch with other texts, and n_chars (where it exists) in step with them."""
    put = {"text": new, "n_chars": [None if t is None else len(t) for t in new]}
    return pa.RecordBatch.from_arrays([pa.array(put[f.name], f.type) if f.name in put else batch.column(i) for i, f in enumerate(batch.schema)], schema=batch.schema)
