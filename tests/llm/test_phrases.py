"""Phrase mining against counting every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from assaylake.llm import phrase_mining as pm

from .helpers import LOWER, documents


def brute(rows, least, top):
    f, n, out = defaultdict(Counter), Counter(), []
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, counts in f.items():
        known = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = Counter()
        for g, a in known.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside[g[i : i + k]], a)
        kept = []
        for g, a in known.items():
            if 100 * inside[g] < 80 * a:
                score, k = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
                kept.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    words = ["The", "the", "of", "É", "é", "new-york", "a\xa0b", "x", "'", "日本"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", "\n", " ", " ", "\x1c"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "en", "en", "fr", None, "und", ""])))
    return rows + [(None, None, "en"), (1, "", None), (1, "x of the " * 20_000, "long"), (1, "same row", "en"), (1, "same row", "en")]


@pytest.mark.parametrize(("seed", "least", "top", "most"), [(1, 30, 2000, 1_000_000), (2, 8, 5, 20)])
def test_every_phrase(spark, monkeypatch, seed, least, top, most):
    """Also with tasks that pass on what they hold after few phrases."""
    rows = texts(seed)
    docs = documents(spark, rows, "doc_id long, text string, lang string, phrase string, n long, id long").repartition(3)
    found = pm.mine_phrases(docs, least=least, top=top, most=most)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, least, top)


def test_nothing(spark):
    assert pm.mine_phrases(documents(spark, [])).collect() == []
    assert pm.mine_phrases(documents(spark, [(1, "one two three", "en")])).collect() == []


def test_clash(spark):
    """Names so short that phrases share them are noticed."""
    rows = [(i, " ".join(f"w{j}" for j in range(200)), "en") for i in range(8)]
    with pytest.raises(RuntimeError):
        pm.mine_phrases(documents(spark, rows), least=2, bits=6)
    assert sorted(map(tuple, pm.mine_phrases(documents(spark, rows), least=2, bits=30).collect())) == brute(rows, 2, 2000)


def test_large_counts(spark):
    """Products beyond 64 bits."""
    a, other = 9_000_000_000_000_000_001, 9_100_000_000_000_000_000
    row = spark.createDataFrame([(1, "en", "x y", a, [other, a], [other + 1, a])], "id long, lang string, phrase string, f long, starts array<long>, ends array<long>")
    assert pm._scored(row, 2).first().score == 2_000_000 * a // (2 * other + 1)


def test_sieve(spark):
    ids = np.random.default_rng(3).integers(-(2**63), 2**63, 5000)
    frame = spark.createDataFrame([(int(i),) for i in ids], "id long")
    for bits in (8, 16, 28):
        sieve = pm._sieve(frame, bits)
        assert pm._passes(sieve, ids.view(np.uint64)).all()
    other = np.random.default_rng(4).integers(-(2**63), 2**63, 5000)
    assert pm._passes(sieve, other.view(np.uint64)).mean() < 0.1
