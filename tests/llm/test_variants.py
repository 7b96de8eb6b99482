"""Spelling variants against comparisons of all pairs."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from assaylake.llm import spelling_variants as sv

from .helpers import LOWER, documents


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    form, out = {}, {}
    for w, n in counts.items():
        found = [x for x in counts if near(w, x)]
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = len(found)
    rows = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, counts[w], out[w], counts[form[w]] if form[w] else None))
    return sorted(rows)


def vocabulary(seed, size, letters="abé", longest=9):
    rng = random.Random(seed)
    return {"".join(rng.choices(letters, k=rng.randint(1, longest))): rng.choice([5, 6, 30, 31, 200, 5000]) for _ in range(size)}


@pytest.mark.parametrize(("seed", "most"), [(1, 1_000_000), (2, 60), (3, 2)])
def test_all_pairs(spark, seed, most):
    """Whatever groups are cut in two, every pair is found once."""
    counts = vocabulary(seed, 300) | {"x" * 40: 7, "x" * 39: 99, "x" * 41: 700, "日本語": 5, "日本": 60}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, sv.group_variants(words, most=most).collect())) == brute(counts)


def test_chain_of_forms(spark):
    counts = {"a" * (6 + i): 5 * 6**i for i in range(9)}
    found = sv.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {r.root for r in found} == {"a" * 14}


def test_odd_words(spark):
    rows = [(None, 9), ("", 9), ("a", 5), ("b", 30)]
    found = sv.group_variants(spark.createDataFrame(rows, "word string, n long"))
    assert sorted(map(tuple, found.collect())) == [("a", "b", "b", 5, 1, 30), ("b", None, "b", 30, 1, None)]
    assert sv.group_variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_counts(spark):
    """Nulls, repeated rows, a very long text and columns whose names clash."""
    import re

    rows = [(i, "Straßen ÉCOLE-école walking x" * (1 + i % 3)) for i in range(40)] + [(None, "walking walking"), (7, None), (8, ""), (9, "longest " * 30_000), (9, "walking"), (9, "walking")]
    want = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                want[run] += 1
    docs = documents(spark, rows).withColumnRenamed("lang", "word").withColumnRenamed("n_chars", "n")
    assert dict(map(tuple, sv.count_words(docs, slip=7).collect())) == {w: n for w, n in want.items() if n >= 5}


def test_wavelet_tree():
    rng = np.random.default_rng(5)
    for m in (1, 2, 7, 64, 100):
        values = rng.permutation(m)
        left, low = rng.integers(0, m + 1, 50), rng.integers(0, m + 1, 50)
        right, high = left + rng.integers(0, m + 1 - left), low + rng.integers(0, m + 1 - low)
        query, found = sv.WaveletTree(values).report(left, right, low, high)
        want = [(q, v) for q in range(50) for v in values[left[q] : right[q]] if low[q] <= v < high[q]]
        assert sorted(zip(query.tolist(), found.tolist(), strict=True)) == sorted((int(q), int(v)) for q, v in want)
