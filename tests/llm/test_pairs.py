from collections import Counter, defaultdict

import numpy as np
import pytest

from assaylake.llm.components import connected_components
from assaylake.llm.embedding_dedup import codes, most_signs, near_vectors, signs
from assaylake.llm.ngram_join import keep_one, near_duplicates

from .helpers import Groups, blank_words, documents


def test_components(spark):
    r = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (2000, 2001), (2001, 2000)]
    g = Groups({x for p in pairs for x in p})
    for a, b in pairs:
        g.tie(a, b)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted((r.id, r.component) for r in got) == sorted((x, g.find(x)) for x in linked)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_sets(rows, k, num):
    sets = [(doc, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())) for doc, w in ((d, blank_words(t)) for d, t in rows)]
    where = defaultdict(list)
    for i, (doc, s) in enumerate(sets):
        for x in s if doc is not None else ():
            where[x].append(i)
    g = Groups(range(len(sets)))
    for i, (doc, s) in enumerate(sets):
        if doc is not None:
            for j, m in Counter(j for x in s for j in where[x] if j < i).items():
                if 100 * m >= num * (len(s) + len(sets[j][1]) - m):
                    g.tie(i, j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[g.find(i)] = min(least.get(g.find(i), doc), doc)
    return sorted(((doc, len(s), None if doc is None else least[g.find(i)]) for i, (doc, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_near_duplicates(spark, small, k, num):
    table = spark.read.parquet(f"{small}/documents.parquet")
    got = sorted((tuple(r) for r in near_duplicates(table, k, num, 100).collect()), key=repr)
    assert got == plain_sets([tuple(r) for r in table.select("doc_id", "text").collect()], k, num)


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_near_duplicate_cases(spark, hot):
    """A chain of near copies, one large group of copies with few and many edits, and odd rows; with and without salts."""
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(1000, " ".join(base))]
    for i in range(90):  # a third are close to the base, others only to each other or to nothing
        w = list(base)
        for at in r.integers(0, 120, int(r.integers(0, 7))):
            w[at] = f"e{i if i % 2 else i // 10}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(12):
        rows.append((2000 - i, " ".join(chain[i:] + [f"d{j}" for j in range(i)])))
    rows += [(3000, None), (3001, ""), (3002, " \n "), (3003, "one"), (3004, "ONE"), (3005, "two words"), (3006, "two words x"), (None, " ".join(base)), (None, None), (3007, "dup id a b c"), (3007, "other text for it"), (3008, "other text for it"), (3009, "z " * 30_000)]
    docs = documents(spark, rows).repartition(5)
    got = sorted((tuple(x) for x in near_duplicates(docs, 3, 90, 100, hot=hot).collect()), key=repr)
    assert got == plain_sets(rows, 3, 90)


def test_salted_key_of_few(spark):
    """Two sets that share one prefix shingle only, in different salts of it, still meet."""
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{i}", *common, f"z{i}"])) for i in range(24)] + [(100 + i, f"x{i} y{i} lone{i}") for i in range(5)]
    docs = documents(spark, rows).repartition(4)
    got = sorted((tuple(x) for x in near_duplicates(docs, 3, 90, 100, hot=2).collect()), key=repr)
    assert got == plain_sets(rows, 3, 90) and len({g[2] for g in got if g[0] < 100}) == 1


def test_keep_one(spark):
    rows = [(5, "a b c d e f g"), (4, "a b c d e f g"), (6, "h i"), (7, None), (8, None), (None, "a b c d e f g")]
    docs = documents(spark, rows)
    out = keep_one(docs)
    assert out.schema == docs.schema and sorted(str(x.doc_id) for x in out.collect()) == ["4", "6", "7", "8", "None"]
    assert keep_one(documents(spark, [])).count() == 0


def test_keep_one_of_repeated_ids(spark):
    """Repeated rows leave one; a doc_id's other text, which is no copy, stays."""
    a, b, c = "a b c d e f g", "p q r s t u v", "k l m n o"
    rows = [(1, a), (1, a), (1, a), (2, b), (3, b), (3, c), (4, a), (5, "x y z"), (5, "X  y z"), (6, None), (6, None), (7, " "), (7, " ")]
    docs = documents(spark, rows).repartition(3)
    out = keep_one(docs)
    assert out.schema == docs.schema
    got = sorted((r.doc_id, (r.text or "").lower().split()) for r in out.collect())
    assert got == [(1, a.split()), (2, b.split()), (3, c.split()), (5, ["x", "y", "z"]), (6, []), (6, []), (7, []), (7, [])]


def plain_vectors(rows):
    ok = [i for i, (v, e) in enumerate(rows) if v is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    g, n = Groups(range(len(rows))), [0] * len(rows)
    unit = {i: np.array(rows[i][1], dtype=np.float64) / np.linalg.norm(np.array(rows[i][1], dtype=np.float64)) for i in ok}
    for a in ok:
        for b in ok:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                n[a] += 1
                n[b] += 1
                g.tie(a, b)
    least = {}
    for i in ok:
        least[g.find(i)] = min(least.get(g.find(i), rows[i][0]), rows[i][0])
    part = [least[g.find(i)] if i in unit else rows[i][0] for i in range(len(rows))]
    return sorted(((v, n[i], part[i], part[i] == v) for i, (v, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("block", [512, 20])
def test_vectors(spark, block):
    r = np.random.default_rng(2)
    rows = [(i, list(map(float, np.float32(x)))) for i, x in enumerate(r.normal(size=(300, 64)))]
    centre = r.normal(size=64)
    rows += [(1000 - i, list(map(float, np.float32(centre + 0.2 * r.normal(size=64))))) for i in range(150)]
    rows += [(2000 + i, rows[5][1]) for i in range(40)] + [(3000, None), (3001, []), (3002, [0.0] * 64), (3003, [float("nan")] * 64), (3004, [None] * 64), (3005, [float("inf")] * 64), (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (None, rows[5][1]), (3008, [2 * x for x in rows[7][1]])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, n_links int").repartition(4)
    got = sorted((tuple(x) for x in near_vectors(df, block=block).collect()), key=repr)
    want = plain_vectors(rows)
    want = sorted(((v, n, p, True if v is None else k) for v, n, p, k in want), key=repr)
    assert got == want
    assert near_vectors(df.limit(0)).count() == 0


def test_vector_recall(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    got = {tuple(x) for x in near_vectors(table).collect()}
    want = set(plain_vectors([tuple(x) for x in table.select("vec_id", "embedding").collect()]))
    assert len(got & want) >= 0.99 * len(want)


@pytest.mark.parametrize("block", [512, 20])
def test_vector_links_of_dense_group(spark, block):
    """Cosines around 0.85, so the neighbour of most equal signs often fails: every link that a bucket holds counts."""
    r = np.random.default_rng(11)
    centre = r.normal(size=64)
    centre *= 8 / np.linalg.norm(centre)
    x = np.float32(centre + 0.42 * r.normal(size=(400, 64)))
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    cosines, (a, b) = unit @ unit.T, np.triu_indices(400, 1)
    assert 0.83 < cosines[a, b].mean() < 0.87
    buckets = [set(c.ravel().tolist()) for c in codes(unit, 12, 3)]
    bits, linked = signs(unit), cosines >= 0.9
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= most_signs(0.9)
    g = Groups(range(400))
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        if linked[i, j] and near[i, j] and buckets[i] & buckets[j]:
            g.tie(i, j)
    part = [g.find(i) for i in range(400)]
    want = [(i, sum(linked[i, j] and i != j and part[i] == part[j] for j in range(400)), part[i], part[i] == i) for i in range(400)]
    df = spark.createDataFrame([(i, list(map(float, e))) for i, e in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = sorted(tuple(x) for x in near_vectors(df, block=block).collect())
    found, there = sum(n for _, n, *_ in got), int(linked[a, b].sum()) * 2
    print(f"links found {found // 2} of {there // 2}")
    assert got == want and found >= 0.99 * there
