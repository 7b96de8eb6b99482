"""Phrase collocations: a frequent k-gram is named by the pair of frequent (k - 1)-grams it is made of."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, mix

#: A-Z become a-z, a tab a space, and what ends a piece a line feed.
PIECE_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))
#: Words that are read before the arrays made of them are counted.
CHUNK = 400_000
#: Bits of one bitmap of Spark's bitmap functions.
BITMAP = 1 << 15
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Clash(Exception):
    """Two phrases got one name."""


class _Names(dict):
    """Word bytes to the word's name in one language; emptied when it holds `most` words."""

    def __init__(self, lang: str, salt: int, bits: int, most: int = 300_000):
        import xxhash

        self.seed, self.shift, self.most = xxhash.xxh3_64_intdigest(lang.encode(), seed=salt), 64 - bits, most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        name = self[word] = xxhash.xxh3_64_intdigest(word, seed=self.seed) >> self.shift << self.shift
        return name


def _pair(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Names of pairs of names."""
    with np.errstate(over="ignore"):
        return (mix((left ^ (left >> np.uint64(31))) * _ODD + mix(right + _ODD)) >> np.uint64(64 - bits)) << np.uint64(64 - bits)


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(language, lower-cased bytes with pieces on lines) of each document."""
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
        yield lang if lang is not None else "und", (text.as_py() or b"").translate(PIECE_BYTES)


def _word_counts(docs: DataFrame, salt: int, bits: int, most: int) -> DataFrame:
    """(id, lang, word, n): each task's counts of its words; rows without a word hold counts of all words of a language."""

    def counted(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["id", "lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        totals: Counter = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                names = _Names(lang, salt, bits)
                words = list(found)
                ids = np.array([names[w] for w in words], dtype=np.uint64).view(np.int64)
                yield counted(ids, [lang] * len(words), [w.decode() for w in words], list(found.values()))
            counts.clear()

        for batch in batches:
            for lang, data in _columns(batch):
                words = data.split()
                counts.setdefault(lang, Counter()).update(words)
                totals[lang] += len(words)
                if sum(map(len, counts.values())) > most:
                    yield from told()
        yield from told()
        yield counted([None] * len(totals), list(totals), [None] * len(totals), list(totals.values()))

    return docs.mapInArrow(run, "id long, lang string, word string, n long")


def _sieve(ids: DataFrame, most_bits: int) -> np.ndarray:
    """Bits of which the given ids (and, by chance, few others) are set: 16 for each, 2 ** most_bits at most."""
    bits = int(min(max(16, np.ceil(np.log2(16 * max(1, ids.count())))), most_bits))
    place = F.shiftrightunsigned("id", 64 - bits) + 1
    maps = ids.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    found = np.zeros(1 << bits - 3, dtype=np.uint8)
    for row in maps.toLocalIterator():
        part = np.frombuffer(row["bits"], dtype=np.uint8)[: len(found)]
        found[(row["part"] - 1) * (BITMAP >> 3) :][: len(part)] = part
    return found


def _passes(sieve: np.ndarray, names: np.ndarray) -> np.ndarray:
    place = names >> np.uint64(64 - (len(sieve) * 8 - 1).bit_length())
    return (sieve[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _gram_counts(docs: DataFrame, k: int, sieves: list, salt: int, bits: int, most: int) -> DataFrame:
    """(id, l, r, n): each task's counts of k-grams whose two (k - 1)-grams pass the sieve; l and r are their names."""

    def merged(ids: np.ndarray, left: np.ndarray, right: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """One row a name; pairs that share one are added without a count, so that the clash is seen."""
        ids, first, back, many = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
        odd = (left != left[first][back]) | (right != right[first][back])
        total = many if n is None else np.bincount(back, weights=n)
        told = ids, left[first], right[first], total.astype(np.int64)
        return tuple(np.concatenate(c) for c in zip(told, (ids[back[odd]], left[odd], right[odd], np.zeros(odd.sum(), dtype=np.int64)), strict=True)) if odd.any() else told

    def batch_of(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in rows], ["id", "l", "r", "n"])

    def grams(names: list[int], pieces: list[int]) -> tuple[np.ndarray, ...]:
        x, piece = np.array(names, dtype=np.uint64), np.repeat(np.arange(len(pieces)), pieces)
        good = _passes(sieves[0].value, x)
        for level in range(2, k + 1):
            good = good[:-1] & good[1:] & (piece[: len(good) - 1] == piece[1 : len(good)])
            left, right = x[:-1], x[1:]
            x = _pair(left, right, bits)
            if level < k:
                good &= _passes(sieves[level - 1].value, x)
        at = np.flatnonzero(good)
        return merged(x[at], left[at], right[at], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Names] = {}
        rows, held, names, pieces = [], 0, [], []

        def chunk() -> Iterator[pa.RecordBatch]:
            nonlocal rows, held
            if len(names) >= k:
                rows.append(grams(names, pieces))
                held += len(rows[-1][0])
            names.clear()
            pieces.clear()
            if held > most:
                rows = [merged(*map(np.concatenate, zip(*rows, strict=True)))]
                held = len(rows[0][0])
                if held > most // 2:
                    yield batch_of(rows[0])
                    rows, held = [], 0

        for batch in batches:
            for lang, data in _columns(batch):
                name = known.get(lang) or known.setdefault(lang, _Names(lang, salt, bits))
                for piece in data.split(b"\n"):
                    words = piece.split()
                    if len(words) >= k:
                        names.extend(map(name.__getitem__, words))
                        pieces.append(len(words))
                if len(names) > CHUNK:
                    yield from chunk()
            if len(known) > 1000:
                known.clear()
        yield from chunk()
        if rows:
            yield batch_of(merged(*map(np.concatenate, zip(*rows, strict=True))))

    return docs.mapInArrow(run, "id long, l long, r long, n long")


def _no_clash(table: DataFrame) -> DataFrame:
    """The table, written, if the least and the greatest thing that bears each name are the same; else Clash."""
    out = materialize(table, "grams")
    if not out.filter("lo <> hi").isEmpty():
        discard(out)
        raise Clash
    return out.drop("hi")


def _levels(docs: DataFrame, longest: int, least: int, salt: int, bits: int, most: int, most_bits: int) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for each k = 1 .. longest the frequent k-grams.

    Columns: id, lang, phrase, last (its last word), f, starts and ends (f of its first and last 1 .. k words), and
    above one word l and r, the ids of its first and last k - 1 words.
    """
    thing = F.struct("lang", "word")
    # a name has one language, so only rows of totals are told apart by it
    counted = _word_counts(docs, salt, bits, most).groupBy("id", F.when(F.col("id").isNull(), F.col("lang")).alias("of")).agg(F.sum("n").alias("f"), F.min(thing).alias("lo"), F.max(thing).alias("hi"))
    told = _no_clash(counted.filter((F.col("f") >= least) | F.col("id").isNull()))
    words = told.filter("id IS NOT NULL").select("id", "lo.lang", F.col("lo.word").alias("phrase"), F.col("lo.word").alias("last"), "f", F.array("f").alias("starts"), F.array("f").alias("ends"))
    levels, sieves = [words], []
    for k in range(2, longest + 1):
        sieves.append(docs.sparkSession.sparkContext.broadcast(_sieve(levels[-1].select("id"), most_bits)))
        thing = F.struct("l", "r")
        pairs = _no_clash(_gram_counts(docs, k, sieves, salt, bits, most).groupBy("id").agg(F.sum("n").alias("f"), F.min(thing).alias("lo"), F.max(thing).alias("hi")).filter(F.col("f") >= least)).select("id", "f", "lo.l", "lo.r")
        first = levels[-1].select(F.col("id").alias("l"), "lang", "phrase", "starts")
        rest = levels[-1].select(F.col("id").alias("r"), "last", "ends")
        named = pairs.join(first, "l").join(rest, "r")  # an inner join: what only the sieve let through goes
        levels.append(materialize(named.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", F.concat("starts", F.array("f")).alias("starts"), F.concat("ends", F.array("f")).alias("ends"), "l", "r"), f"grams-{k}"))
    return told.filter("id IS NULL").select(F.col("of").alias("lang"), F.col("f").alias("n")), levels


def _scored(grams: DataFrame, k: int) -> DataFrame:
    """(id, lang, phrase, a, l, r, score): the cut of least score, the first of several."""
    cut = "struct((2000000 * CAST(f AS DECIMAL(20, 0))) div (CAST(starts[{j}] AS DECIMAL(20, 0)) + CAST(ends[{i}] AS DECIMAL(20, 0))) AS score, {j} AS j, starts[{j}] AS l, ends[{i}] AS r)"
    cuts = ", ".join(cut.format(j=j, i=k - 2 - j) for j in range(k - 1))
    return grams.select("id", "lang", "phrase", F.col("f").alias("a"), F.expr(f"array_min(array({cuts}))").alias("c")).select("id", "lang", "phrase", "a", "c.l", "c.r", "c.score")


def mine_phrases(docs: DataFrame, longest: int = 4, least: int = 30, share: tuple[int, int] = (80, 100), top: int = 2000, bits: int = 64, most: int = 1_000_000, most_bits: int = 28) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of docs(text, lang) by score.

    A phrase has 2 to `longest` words of one piece and occurs a >= `least` times; of its cuts in two parts, which occur
    l and r times, the one of the smallest score floor(2000000 a / (l + r)) counts.  A phrase inside a longer one that
    occurs at least share[0] / share[1] as often goes.  n: all words of the language.  Ties in the score go to the
    more frequent phrase, then to the first in byte order.

    A null text is empty, a null language `und`; repeated rows count each time; texts of any length are read whole;
    other columns are ignored; no words give no rows.  Names have `bits` bits: if two frequent phrases ever shared
    one, all names are made anew with another salt.
    """
    docs = docs.select("lang", "text")
    for salt in range(8):
        try:
            totals, levels = _levels(docs, longest, least, salt, bits, most, most_bits)
            break
        except Clash:
            continue
    else:
        raise RuntimeError(f"names of {bits} bits clash")
    kept = None
    for k in range(2, longest + 1):
        found = _scored(levels[k - 1], k)
        if k < longest:  # a longer phrase that holds this one is no more frequent than the one with one word more
            over = levels[k].select(F.explode(F.array("l", "r")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("over"))
            found = found.join(over, "id", "left").filter(F.expr(f"over IS NULL OR {share[1]} * CAST(over AS DECIMAL(20, 0)) < {share[0]} * CAST(a AS DECIMAL(20, 0))")).drop("over")
        kept = found if kept is None else kept.unionByName(found)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = kept.withColumn("part", F.pmod("id", F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
