"""Spelling variants: words one edit apart, found by two-dimensional range reporting in wavelet trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What the words of a group have in common: a class of lengths, the places an edit may stand at, and the text around them.
GROUP = ["size", "low", "high", "before", "after"]


def count_words(docs: DataFrame, least_length: int = 6, least: int = 5, slip: int | None = None) -> DataFrame:
    """(word, n): runs of Latin letters of docs(doc_id, text), A-Z in lower case, that occur `least` times or more.

    With `slip`, a run loses a letter where slip divides the crc32 of "<doc_id>:<run>" (the letter at crc32 modulo its
    length), so that misspellings of known words stand in the texts.  A null text has no words; a null doc_id reads
    as the empty text; repeated rows count each time; texts of any length are read whole; other columns are ignored.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), 0)).alias("word"))
    if slip:
        crc = F.crc32(F.encode(F.concat("id", F.lit(":"), "word"), "UTF-8"))
        runs = runs.withColumn("crc", crc).withColumn("at", (F.col("crc") % F.length("word")).cast("int"))
        runs = runs.withColumn("word", F.when(F.col("crc") % slip == 0, F.concat(F.expr("left(word, at)"), F.expr("substring(word, at + 2)"))).otherwise(F.col("word"))).filter(F.length("word") >= least_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _spans(length: Column) -> Column:
    """The two halves of the places of a word of some length, as an array of (size, low, high)."""
    half = F.floor(length / 2).cast("int")
    return F.filter(F.array(F.struct(length.alias("size"), F.lit(0).alias("low"), half.alias("high")), F.struct(length.alias("size"), half.alias("low"), length.alias("high"))), lambda s: s.low < s.high)


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows with the text before and after their places; `whole` words have size letters, the others one less."""
    return rows.withColumn("before", F.expr("left(word, low)")).withColumn("after", F.expr("substring(word, IF(whole, high, high - 1) + 1)"))


def _rows(words: DataFrame) -> DataFrame:
    """Each word in the groups of its own length, and in those of the next length, whose words it may be one letter short of."""
    length = F.length("word").cast("int")
    roles = F.array(F.struct(F.lit(True).alias("whole"), _spans(length).alias("spans")), F.struct(F.lit(False).alias("whole"), _spans(length + 1).alias("spans")))
    return _grouped(words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.whole", F.explode("r.spans").alias("s")).select("word", "n", "whole", "s.*"))


def _halves(rows: DataFrame) -> DataFrame:
    """The same rows with their places cut in two: the groups of each half agree in the other half, too."""
    mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    spans = F.array(F.struct(F.col("low").alias("low"), mid.alias("high")), F.struct(mid.alias("low"), F.col("high").alias("high")))
    return _grouped(rows.select("word", "n", "whole", "size", F.explode(spans).alias("s")).select("word", "n", "whole", "size", "s.*"))


class WaveletTree:
    """A permutation of 0 .. m - 1, stored bit by bit from the highest; each level keeps the zeros before the ones."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for k in reversed(range(max(1, int(len(values) - 1).bit_length()))):
            ones = (values >> k) & 1
            self.levels.append((k, np.concatenate([[0], np.cumsum(1 - ones)])))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of every value in [low, high) that stands at a place in [left, right), for all queries at once."""
        query, base = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
        for k, zeros in self.levels:
            l0, r0, split = zeros[left], zeros[right], base + (1 << k)
            go0 = (r0 > l0) & (low[query] < split) & (high[query] > base)
            go1 = (right - r0 > left - l0) & (low[query] < split + (1 << k)) & (high[query] > split)
            left, right = np.concatenate([l0[go0], (zeros[-1] + left - l0)[go1]]), np.concatenate([r0[go0], (zeros[-1] + right - r0)[go1]])
            query, base = np.concatenate([query[go0], query[go1]]), np.concatenate([base[go0], split[go1]])
        return query, base


def _intervals(codes: np.ndarray, group: np.ndarray, order: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row and i: the points, by rank in `order`, that agree with it in their first i letters and in group.

    Gives the first rank, the one after the last (both rows x letters), and the rank of each row among the points.
    """
    m, width = codes.shape
    sorted_codes, sorted_group = codes[order], group[order]
    differs = sorted_codes[1:] != sorted_codes[:-1]
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    first = np.concatenate([[-1], np.where(sorted_group[1:] != sorted_group[:-1], -1, first)])
    new = first[:, None] < np.arange(width)[None, :]  # row r starts an interval of its first i letters
    at = np.arange(m, dtype=np.int64)[:, None]
    start = np.maximum.accumulate(np.where(new, at, 0), axis=0)
    after = np.minimum.accumulate(np.where(new, at, m)[::-1], axis=0)[::-1]
    end = np.concatenate([after[1:], np.full((1, width), m)])
    rank = np.concatenate([[0], np.cumsum(points[order])])  # points before each row
    back = np.empty(m, dtype=np.int64)
    back[order] = np.arange(m)
    return rank[start][back], rank[end][back], rank[:-1][back]


def near_pairs(words: list[str], whole: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of rows of one group that are one edit apart: both whole (given both ways), or x one letter short of y (given once).

    A letter that could go in at several places of a run of itself counts at the first of them only.
    """
    mids = [w[a : b if is_whole else b - 1] for w, a, b, is_whole in zip(words, low, high, whole, strict=True)]
    width = int((high - low).max())
    codes = np.array(mids, dtype=f"U{width}").view(np.uint32).reshape(len(mids), width)
    forward = np.array(sorted(range(len(mids)), key=lambda r: (group[r], mids[r])))
    turned = [s[::-1] for s in mids]
    turned_codes = np.array(turned, dtype=f"U{width}").view(np.uint32).reshape(len(mids), width)
    backward = np.array(sorted(range(len(mids)), key=lambda r: (group[r], turned[r])))
    left, right, place = _intervals(codes, group, forward, whole)
    bottom, top, value = _intervals(turned_codes, group, backward, whole)
    spare = (high - low)[:, None] - 1 - np.arange(width)[None, :]  # letters after the edit
    row, i = np.nonzero((spare >= 0) & (right - left > whole[:, None]))
    j = spare[row, i]
    bottom, top = bottom[row, j], top[row, j]
    keep = top - bottom > whole[row]
    row, i, bottom, top = row[keep], i[keep], bottom[keep], top[keep]
    points = np.flatnonzero(whole)
    by_place, by_value = np.empty(len(points), dtype=np.int64), np.empty(len(points), dtype=np.int64)
    by_place[place[points]], by_value[value[points]] = value[points], points
    if not len(points) or not len(row):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    query, found = WaveletTree(by_place).report(left[row, i], right[row, i], bottom, top)
    x, y, i = row[query], by_value[found], i[query]
    prior = np.array([ord(w[a - 1]) if a else -1 for w, a in zip(words, low, strict=True)])
    first_of_run = np.where(i > 0, codes[y, np.maximum(i - 1, 0)].astype(np.int64), prior[y]) != codes[y, i]
    keep = np.where(whole[x], x != y, first_of_run)
    return x[keep], y[keep]


NEAR = "word string, n_near long, best_n long, best string"


def _search(rows: DataFrame, most: int) -> DataFrame:
    """(word, n_near, best_n, best) of each word in each group, from rows that come group by group.

    Whole groups are put together to batches of some `most` letters, so a task holds no more than two groups' worth.
    """

    def solve(batch: list[pa.RecordBatch], cut: np.ndarray) -> pa.RecordBatch:
        t = pa.Table.from_batches(batch)
        words, n = t["word"].to_pylist(), t["n"].to_numpy()
        whole, low, high = (t[c].to_numpy() for c in ("whole", "low", "high"))
        x, y = near_pairs(words, whole, np.cumsum(cut), low, high)
        short = ~whole[x]
        who, other = np.concatenate([x, y[short]]), np.concatenate([y, x[short]])
        rank = np.empty(len(words), dtype=np.int64)
        rank[np.array(sorted(range(len(words)), key=words.__getitem__))] = np.arange(len(words))
        order = np.lexsort((rank[other], -n[other], who))
        who, other = who[order], other[order]
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])[: len(who)])
        many = np.diff(np.concatenate([first, [len(who)]]))
        columns = [[words[k] for k in who[first]], many, n[other[first]], [words[k] for k in other[first]]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "best_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cuts, cells, last = [], [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in GROUP), strict=True))
            cut = np.array([k != p for k, p in zip(keys, [last, *keys], strict=False)])
            last, start = keys[-1], 0
            widths = batch.column("high").to_numpy() - batch.column("low").to_numpy()
            for g in np.flatnonzero(cut):
                if cells + widths[start:g].sum() >= most:  # everything before g is whole groups
                    held.append(batch.slice(start, g - start))
                    cuts.append(cut[start:g])
                    yield solve(held, np.concatenate(cuts))
                    held, cuts, cells, start = [], [], 0, g
            held.append(batch.slice(start))
            cuts.append(cut[start:])
            cells += int(widths[start:].sum())
        if held:
            yield solve(held, np.concatenate(cuts))

    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, NEAR)


def near_words(words: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(word, n_near, best_n, best) of each of words(word, n) that others are one inserted, deleted or replaced letter from.

    An edit stands in one half of a word, so the other half is common: words meet in groups by length and half.  A
    group of more than `most` letters is cut in two by the place of the edit, which lengthens what its words have in
    common, down to single places, where all words of a group are neighbours.  In a group each word asks, for every
    place, for the words between whose ends that place lies: an interval in forward order, crossed with one in
    reverse order.  Every pair is found in one group, at one place.  best is the near word of largest n (the
    smallest of several).
    """
    rows, parts = _rows(words), []
    while True:
        hot = materialize(rows.filter("high - low > 1").groupBy(*GROUP).agg((F.count("*") * F.first(F.col("high") - F.col("low"))).alias("cells")).filter(F.col("cells") > most).select(*GROUP), "hot-groups")
        if hot.isEmpty():
            break
        parts.append(rows.join(hot, GROUP, "left_anti"))
        rows = materialize(_halves(rows.join(hot, GROUP, "left_semi")), "halved-groups")
    found = _search(rows, most)
    for part in parts:
        found = found.unionByName(_search(part, most))
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): the last word that forms lead to, by doubling the steps each round.

    A form is several times as frequent as its word, so chains are short: their length is a logarithm of the largest count.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = materialize(now.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        if then.filter("moved").isEmpty():
            return then.drop("moved")
        now = then


def group_variants(words: DataFrame, ratio: int = 5, most: int = 1_000_000) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words(word, n), whose words are distinct.

    form: the near word of largest n if that is `ratio` times the word's n or more, else null; root: where forms lead
    (the word itself without one); n_near: how many words are near, 0 if none.  Null words are dropped; words of one
    letter take part; other columns are ignored; no words give no rows.
    """
    words = materialize(words.filter("word IS NOT NULL AND word <> ''").select("word", F.col("n").cast("long").alias("n")), "words")
    near = materialize(words.join(near_words(words, most), "word").select("word", "n", "n_near", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")).alias("form"), F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best_n")).alias("form_n")), "near")
    root = _roots(near.filter("form IS NOT NULL"))
    return words.join(near.drop("n"), "word", "left").join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
