import hashlib

import pytest

from assaylake.llm import decontaminate as d

from .helpers import documents, simple_words


def plain(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = simple_words(text)
        if item is not None and w:
            k = min(n, len(w))
            for i in range(len(w) - k + 1):
                windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = simple_words(text)
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if items_ := windows.get(tuple(w[i : i + k])):
                    found |= items_
                    hit |= set(range(i, i + k))
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


@pytest.mark.parametrize("most", [d.MOST_BROADCAST_WINDOWS, 3])
def test_cases(spark, most):
    long = " ".join(f"w{i}" for i in range(30))
    items = [(1, long), (10, long), (2, "Short item, here"), (3, ""), (4, None), (None, "no id at all"), (5, "É à 9")]
    docs = [(1, f"a b {long.upper()}! c"), (2, " ".join(long.split()[5:14])), (3, "x short-ITEM here short item here"), (4, None), (5, ""), (6, "é À 9 É à 9"), (6, "É à 9"), (None, long), (7, "w " * 20_000 + long)]
    got = d.find_contamination(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), most_broadcast=most)
    assert rows(got) == plain(docs, items)


@pytest.mark.parametrize("most", [d.MOST_BROADCAST_WINDOWS, 3])
def test_whole_table(spark, tiny, most):
    docs, items = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert any(w[5] for w in want)
    if most == 3:
        docs = docs.filter("length(text) < 3000")
        want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert rows(d.find_contamination(docs, items, most_broadcast=most)) == want


@pytest.mark.parametrize("most", [d.MOST_BROADCAST_WINDOWS, 3])
def test_removal(spark, most):
    long = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(1, long)], "item_id long, text string")
    docs = documents(spark, [(1, f"Before, {long}, after.", "en", "s", 9), (2, "clean", "en", "s", 5), (3, None), (None, "x")])
    kept = d.decontaminate(docs, items, most_broadcast=most)
    assert kept.schema == docs.schema and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "None"]
    cut = {r.doc_id: r for r in d.decontaminate(docs, items, mode="span", most_broadcast=most).collect()}
    assert cut[1].text == "Before, , after." and cut[1].n_chars == 16 and cut[2].text == "clean" and cut[3].text is None
    with pytest.raises(ValueError):
        d.decontaminate(docs, items, mode="other")


def test_empty(spark):
    docs, items = documents(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert d.find_contamination(docs, items).count() == 0
    assert d.find_contamination(documents(spark, [(1, "a")]), items).collect()[0].contaminated is False


@pytest.mark.parametrize("most", [d.MOST_BROADCAST_WINDOWS, 3])
def test_removal_by_row(spark, most):
    """A null or repeated doc_id changes nothing: each row goes by its own text."""
    long, more = " ".join(f"w{i}" for i in range(14)), " ".join(f"v{i}" for i in range(40))
    items = spark.createDataFrame([(1, long), (2, more)], "item_id long, text string")
    given = [(None, f"null id {long}"), (None, "null id, clean"), (1, f"hit {long} end"), (1, "clean one"), (1, "clean one"), (2, f"a {long} b"), (2, f"a {long} b"), (2, f"x {more} y"), (2, None), (3, "short")]
    docs = documents(spark, given)
    clean = [(i, t) for i, t in given if not t or "w0" not in t and "v0" not in t]
    kept = [(r.doc_id, r.text) for r in d.decontaminate(docs, items, most_broadcast=most).collect()]
    assert sorted(kept, key=repr) == sorted(clean, key=repr)
    cut = [(r.doc_id, r.text) for r in d.decontaminate(docs, items, mode="span", most_broadcast=most).collect()]
    want = [(i, t and t.replace(long, "").replace(more, "")) for i, t in given]
    assert sorted(cut, key=repr) == sorted(want, key=repr)
