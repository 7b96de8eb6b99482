import math
import zlib

import numpy as np

from assaylake.llm import language_id as li

from .helpers import documents


def test_grams():
    at, n = li.grams("Ab,  b!")
    assert n.sum() == 6 + 5 + 4  # " ab b " has so many n-grams of each length
    assert (li.grams("aB B")[0] == at).all() and not len(li.grams("12 .,")[0])


def test_held_out(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    real = {r.doc_id: (r.lang, r.text) for r in docs.select("doc_id", "lang", "text").collect()}
    got = li.identify(docs).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and real[r.doc_id][0] is not None and any(map(str.isalpha, real[r.doc_id][1] or ""))]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    right = np.array([r.lang_pred == real[r.doc_id][0] for r in held])
    assert right.mean() >= 0.95
    score = np.array([r.score for r in held])
    assert 0 <= score.min() and score.max() <= 1 and abs(score.mean() - right.mean()) < 0.08  # calibrated


def test_no_leaks(spark, small):
    """Held-out labels, sources and ids change no prediction."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(300)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    swapped = [(i, t, "en" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, "other") for i, t, lang in rows]
    a = sorted(map(tuple, li.identify(documents(spark, rows)).collect()))
    assert a == sorted(map(tuple, li.identify(documents(spark, swapped)).collect()))


def test_cases(spark):
    texts = {"aa": "alma bala kala saba alma", "bb": "otto bolo komo sono otto"}
    rows = [(i, texts[lang] + " " + texts[lang][: i % 9], lang) for i in range(60) for lang in texts]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 !?", None), (1003, "bala kala " * 20_000, None), (None, "bolo komo", "aa"), (1004, "Komo BOLO", None)]
    got = {r.doc_id: (r.lang_pred, r.held_out) for r in li.identify(documents(spark, rows + odd)).collect()}
    assert [got[i][0] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003][0] == "aa" and got[None] == ("bb", False) and got[1004][0] == "bb"
    kept = li.keep_identified(documents(spark, rows + odd))
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} | {1003, None, 1004}
    assert li.identify(documents(spark, [])).count() == 0 and li.keep_identified(documents(spark, [])).count() == 0
    assert {r.lang_pred for r in li.identify(documents(spark, [(1, "text")])).collect()} == {"und"}


def plain_train(data, n, order, epochs=3, alpha=0.5, beta=1.0, l1=1e-3, l2=1e-3):
    """Follow the regularised leader one number at a time: weights by (feature, language), feature None being the bias."""
    z, s = {}, {}

    def weight(key):
        v = z.get(key, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(s.get(key, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for i in order.permutation(len(data)):
            x, y = data[i]
            x = [*x, (None, 1.0)]
            w = {(f, k): weight((f, k)) for f, _ in x for k in range(n)}
            t = [sum(v * w[f, k] for f, v in x) for k in range(n)]
            e = [math.exp(v - max(t)) for v in t]
            for k in range(n):
                g = e[k] / sum(e) - (k == y)
                for f, v in x:
                    old = s.get((f, k), 0.0)
                    s[f, k] = old + (g * v) ** 2
                    z[f, k] = z.get((f, k), 0.0) + g * v - (math.sqrt(s[f, k]) - math.sqrt(old)) / alpha * w[f, k]
    return weight


def test_training_beside_plain():
    texts = [("alma bala kala", 0), ("otto bolo komo", 1), ("saba alma", 0), ("sono otto komo", 1), ("tiki miki bala", 2), ("miki tiki", 2), ("alma alma", 0), ("bolo", 1), ("tiki", 2), ("kala saba", 0), ("", 1)]
    rows = [(*li.grams(t), y) for t, y in texts]
    idf = np.log(12 / (1.0 + np.bincount(np.concatenate([at for at, *_ in rows]), minlength=1 << li.BITS))) + 1
    model = li.train(rows, ["a", "b", "c"], idf, l1=0.1, l2=0.05)
    data = [(at, li.tf_idf(at, n, idf), y) for at, n, y in rows if len(at)]
    seen = [(list(zip(at.tolist(), x.tolist(), strict=True)), y) for i, (at, x, y) in enumerate(data) if i % 5]
    weight = plain_train(seen, 3, np.random.default_rng(0), l1=0.1, l2=0.05)
    used = sorted({f for x, _ in seen for f, _ in x})
    want = np.array([[weight((f, k)) for k in range(3)] for f in used])
    assert np.allclose(model.weights[used], want, atol=1e-6) and np.allclose(model.bias, [weight((None, k)) for k in range(3)], atol=1e-6)
    assert (want == 0).any() and np.count_nonzero(model.weights) == np.count_nonzero(model.weights[used])  # l1 leaves zeros
    held = [(model.logits(at, x), y) for at, x, y in data[::5]]
    loss = {t: sum(math.log(sum(math.exp(v / t) for v in z)) - z[y] / t for z, y in held) for t in np.geomspace(0.05, 5, 60)}
    assert math.isclose(model.temperature, min(loss, key=loss.get))
