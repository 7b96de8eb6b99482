import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assaylake.llm import packing, token_counts
from assaylake.llm.common import UnitCache

from .helpers import documents

HARD = ["", " ", "  a  b", "a <|endoftext|> b", "<|endoftext|>", "it's  o k\n\n b c d", "a\tb c", "▁ a ▁b", "a ▁", " lead", "trail ", "日本 語 text", "a \n b", "1 2  3\n", "s 's 't 're x", "<s> </s> a", "a \x00 b", "x\x1c y", "É² ½ x", "don't we'll a_b 12ab ab12 'sup !!! \nfoo\n\nbar x\n y", "a​b c", " x y", "w" * 300 + " " + "v" * 300]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.TOKENIZER))
    return lambda text: len(m.encode(text))


@pytest.fixture(scope="module")
def caches() -> tuple[UnitCache, UnitCache]:
    return packing.encoder(packing.TOKENIZER), token_counts.counter(token_counts.TOKENIZER)


def test_units_equal_the_libraries(caches, library, pieces, spark, tiny):
    texts = HARD + [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").select("text").collect()]
    for text in texts:
        assert caches[0].value(text) == packing.pack_ids(library(text)), text[:80]
        assert caches[1].value(text) == pieces(text), text[:80]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" ab'sé.\n\t▁<|>1 ½ß語")), max_size=30))
def test_units_equal_the_libraries_on_any_text(caches, library, pieces, text):
    assert caches[0].value(text) == packing.pack_ids(library(text))
    assert caches[1].value(text) == pieces(text)


def test_counts(spark, tmp_path, pieces):
    rows = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (None, "é " * 9000), (1, "a b"), *((10 + i, t) for i, t in enumerate(HARD))]
    docs, cache = documents(spark, rows), str(tmp_path / "cache")
    want = sorted(((i, len((t or "").encode()), pieces(t or ""), pieces(t or "") > 4096) for i, t in rows), key=repr)
    for more in (0, 0, 1):  # a second run adds nothing to the cache; a new text adds one row
        docs = documents(spark, [*rows, (99, "something new")]) if more else docs
        got = sorted((tuple(r) for r in token_counts.count_tokens(docs, cache).collect()), key=repr)
        assert [g for g in got if g[0] != 99] == want
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows}) + more
    assert token_counts.count_tokens(documents(spark, []), str(tmp_path / "other")).count() == 0


def check_packing(rows, docs, library, size=2048):
    ids = {}
    for doc, text in docs:
        ids.setdefault(doc, []).append([*library(text or ""), 1])
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        if len(ids[doc]) == 1:
            own, at = ids[doc][0], 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(own) and r.length > 0
                assert r.ids_crc32 == zlib.crc32(np.asarray(own[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(own)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size and at & (at - 1) == 0
    assert sum(r.length for r in rows) == sum(len(x) for own in ids.values() for x in own)


def test_packing(spark, tiny, library):
    table = spark.read.parquet(f"{tiny}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    check_packing(packing.pack(table).collect(), docs, library)
    check_packing(packing.pack(table, window_tokens=9000).collect(), docs, library)
    odd = [(1, None), (2, ""), (3, "x " * 20_000), (4, "same"), (5, "same"), (None, "no id"), (6, "a <|endoftext|> b")]
    check_packing(packing.pack(documents(spark, odd).repartition(3)).collect(), odd, library)
    assert packing.pack(documents(spark, [])).count() == 0


def test_balance():
    lengths = [100, 2048, 5000, 1, 700, 700, 700, 3]
    out = packing.balance(lengths, 2048, 1.0, 1 / 2048)
    for d, n in enumerate(lengths):
        assert sum(p[2] for p in out if p[0] == d) == n
    full = [sum(p[2] for p in out if p[3] == s) for s in {p[3] for p in out}]
    assert sorted(full, reverse=True) == packing.sequence_lengths(sum(lengths), 2048)
    even = packing.balance([512] * 4000, 2048, 1.0, 1 / 2048)  # equal documents: equal costs
    assert {sum(1 for p in even if p[3] == s) for s in {p[3] for p in even}} == {4}


def plain_balance(lengths, size, linear, quadratic):
    """Every document looks through all sequences for the cheapest with room."""
    room = packing.sequence_lengths(sum(lengths), size)
    cost, filled, out = [0.0] * len(room), [0] * len(room), []
    for doc in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start = 0
        while start < lengths[doc]:
            seq = min((i for i in range(len(room)) if filled[i] < room[i]), key=lambda i: (cost[i], i))
            take = min(lengths[doc] - start, room[seq] - filled[seq])
            out.append((doc, start, take, seq, filled[seq]))
            filled[seq], start, cost[seq] = filled[seq] + take, start + take, cost[seq] + linear * take + quadratic * take * take
    return out


def test_balance_beside_plain():
    r = np.random.default_rng(4)
    for n in (1, 7, 60, 300):
        lengths = [int(x) for x in r.integers(1, 400, n)] + [3000] * (n // 50)
        assert packing.balance(lengths, 256, 1.0, 1 / 256) == plain_balance(lengths, 256, 1.0, 1 / 256)
