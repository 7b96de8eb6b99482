"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sum_tables, table_blocks

#: Features: hashed n-grams of 1 to 3 characters.
BITS, LONGEST = 16, 3
#: Rows per language, and in all, from which weights are learned.
MOST_PER_LANGUAGE, MOST_ROWS = 1000, 8000

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of a text: n-grams of its lower-case letters, runs of all else being one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    letter = letters()[c]
    if not letter.any():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    c = np.concatenate([[0], np.where(letter, c, 0), [0]]).astype(np.uint64)
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    count = np.zeros(1 << BITS, dtype=np.int64)
    h = np.zeros(len(c), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, LONGEST + 1):
            h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            count += np.bincount((h & np.uint64((1 << BITS) - 1)).astype(np.int64), minlength=1 << BITS)
            if len(c) <= n:
                break
    at = np.flatnonzero(count)
    return at, count[at]


def tf_idf(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(count)) * idf[at]
    size = np.sqrt((x * x).sum())
    return x / size if size else x


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (features, languages)
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        at, count = grams(text or "")
        if not len(at) or not self.langs:
            return "und", 0.0
        z = self.logits(at, tf_idf(at, count, self.idf)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], langs: list[str], idf: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> Model:
    """Follow-the-regularised-leader (proximal, per coordinate) with an elastic net; then one temperature from every fifth row."""
    n = len(langs)
    z, s = np.zeros((1 << BITS, n)), np.zeros((1 << BITS, n))
    zb, sb = np.zeros(n), np.zeros(n)

    def weights(z: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(s)) / alpha + l2))

    data = [(at, tf_idf(at, count, idf), y) for at, count, y in rows if len(at)]
    held, seen = data[::5], [d for i, d in enumerate(data) if i % 5] or data
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(seen)):
            at, x, y = seen[i]
            w, b = weights(z[at], s[at]), weights(zb, sb)
            t = x @ w + b
            p = np.exp(t - t.max())
            p /= p.sum()
            p[y] -= 1
            for grad, zz, ss, ww, where in ((x[:, None] * p, z, s, w, at), (p, zb, sb, b, slice(None))):
                old = ss[where]
                new = old + grad * grad
                zz[where] += grad - (np.sqrt(new) - np.sqrt(old)) / alpha * ww
                ss[where] = new
    model = Model(langs, weights(z, s).astype(np.float32), weights(zb, sb).astype(np.float32), idf)
    if held and n > 1:
        scores, y = np.stack([model.logits(at, x) for at, x, _ in held]), np.array([y for *_, y in held])

        def loss(t: float) -> float:
            v = scores / t
            v = v - v.max(axis=1, keepdims=True)
            return float((np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(y)), y]).mean())

        model.temperature = min((float(t) for t in np.geomspace(0.05, 5, 60)), key=loss)
    return model


def labelled(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: a text, a lang, and crc32 of doc_id as text not 2 modulo 4."""
    return docs.filter((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")


def fit(docs: DataFrame, most_per_language: int = MOST_PER_LANGUAGE, most_rows: int = MOST_ROWS) -> Model:
    """Learns from docs(doc_id, text, lang).

    Document frequencies come from all labelled rows.  Weights come from at most `most_per_language` rows of
    each language and about `most_rows` in all, those of the smallest hashes of doc_id.
    """
    rows = labelled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    each = max(10, min(most_per_language, most_rows // max(1, len(langs))))
    share = F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(1.0, 1.2 * each / sizes[lang])))) if langs else F.create_map(F.lit(""), F.lit(0.0))
    chosen = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << BITS, dtype=np.uint32)
        for batch in batches:
            lang, at_, count_ = [], [], []
            for text, use, name in zip(batch.column("text"), batch.column("chosen").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                at, count = grams(text.as_py())
                df[at] += 1
                if use:
                    lang.append(name)
                    at_.append(at.astype("<i4").tobytes())
                    count_.append(count.astype("<i4").tobytes())
            m = len(lang)
            yield pa.RecordBatch.from_arrays([pa.array([None] * m, pa.int32()), pa.array(at_, pa.binary()), pa.array(lang, pa.string()), pa.array(count_, pa.binary())], ["block", "data", "lang", "counts"])
        for block, data in table_blocks(df):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary()), pa.array([None], pa.string()), pa.array([None], pa.binary())], ["block", "data", "lang", "counts"])

    from .common import materialize

    scanned = materialize(rows.select("text", "lang", chosen.alias("chosen")).mapInArrow(scan, "block int, data binary, lang string, counts binary"), "grams")
    df = sum_tables(scanned.filter("block is not null"), 1 << BITS)
    idf = np.log((1 + sum(sizes.values())) / (1.0 + df)) + 1
    sample: dict[str, list] = {lang: [] for lang in langs}
    for r in scanned.filter("block is null").orderBy(F.xxhash64("data", "counts"), "lang").toLocalIterator():  # bounded by `share`
        if len(sample[r["lang"]]) < each:
            sample[r["lang"]].append((np.frombuffer(r["data"], "<i4"), np.frombuffer(r["counts"], "<i4"), langs.index(r["lang"])))
    data = [row for lang in langs for row in sample[lang]]
    return train([data[i] for i in np.random.default_rng(1).permutation(len(data))], langs, idf)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score.

    held_out: crc32 of doc_id as text is 2 modulo 4; such rows, and those without lang or text, teach
    nothing.  lang_pred is one of the learned langs, or `und` (score 0) where the text is null or has no
    letter, or nothing could be learned.  score is the calibrated probability.  The prediction sees the
    whole text and nothing else.

    Rows with a null doc_id are predicted, not held out, and teach nothing.  Repeated rows give a row each;
    an empty table gives none.  Extra columns are ignored.
    """
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """docs, all columns as they are, without rows whose language is `und` (null text or no letter) or less likely than `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column("text")]
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
