import hashlib
import itertools
import re
from math import log10

import pytest

from assaylake.llm import secret_scan as s

from .helpers import documents

PATTERNS = [
    (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    (r"AKIA[A-Z0-9]+", 0, 18),
    (r"[0-9a-f]+", 0, 16),
]


def plain_base(text):
    found = [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if len(m[g]) >= n]
    joined = ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
    return tuple(sum(x[1] == k for x in found) for k in range(3)), joined


HARD = ["", None, "password: abcdefghijkl", "PassWord = 'short' password=\"longer-than-12/x\"", "token:token:abcdefghijklmn", "AKIA1234567890ABCD AKIA1234", "0123456789abcdef0 0123456789abcde", "api_key=deadbeefdeadbeefdeadbeef", "é secret : ÀÀ secret:  abcdefghijklé", "\u212aey \u017fecret=abcdefghijklmnop", "x" * 100_000 + "passwd=" + "y" * 30, "tokentoken=abcdefghijkl"]


def test_base(spark, tiny):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, HARD[2]), (2, HARD[2])] + [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").selectExpr("doc_id + 1000", "text").collect()]
    got = s.find_secrets(documents(spark, rows)).collect()
    want = sorted(((i, *plain_base(t)[0], hashlib.sha256(plain_base(t)[1].encode()).hexdigest()) for i, t in rows), key=repr)
    assert any(w[1] for w in want) and sorted((tuple(r)[:5] for r in got), key=repr) == want
    for r in got:
        kept = [x for x in r.spans.split(",") if x and not x.startswith("guess")]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == r.base_sha256
    assert s.find_secrets(documents(spark, [])).count() == 0


def test_guesses():
    text = 'login: letmein1 pwd: Zq8#kT!v2Lp9x auth=password123 bearer is 19990101'
    spans = s.guessed_spans(text, s.base_spans(text))
    assert [text[a:b] for a, _, b, _ in spans] == ["Zq8#kT!v2Lp9x"]


def brute_cost(value):
    """The cheapest of all cuts into spans."""
    low, each, n = value.lower(), s._alphabet(value), len(value)

    def costs(i, j):
        part, size = low[i:j], j - i
        if size == 1:
            yield each
        if size >= 3 and len(set(part)) == 1:
            yield each + log10(size)
        if size >= 3 and all(p in s.WALKS for p in zip(part, part[1:], strict=False)):
            yield log10(26 * 4 * size)
        if any(m.start() == 0 and m.end() == size for m in [s.DATE.match(value[i:])] if m):
            yield log10(150 * (365 if size > 4 else 1))
        if size >= 3 and (rank := s.RANKS.get(part) or s.RANKS.get(part.translate(s.LEET), 0) * 4):
            yield log10(rank + 1) + log10(2) * (1 if value[i:j] == part else 2)
        if 2 <= size <= 16 and i >= size and low[i - size : i] == part:
            yield log10(2)

    best = float("inf")
    for cuts in itertools.product((0, 1), repeat=n - 1):
        ends = [0, *(i + 1 for i, c in enumerate(cuts) if c), n]
        total = 0.0
        for i, j in zip(ends, ends[1:], strict=False):
            total += min(costs(i, j), default=float("inf"))
        best = min(best, total)
    return best


@pytest.mark.parametrize("value", ["password1", "aaaa1999", "qwerty12", "p4ssw0rd", "abcabc", "x9!kQz7", "1999-12-3", "Dragon99", "zzzzzz", "ababab19"])
def test_cost(value):
    assert s.guess_cost(value) == pytest.approx(brute_cost(value))


PROSE = ["The password is case-sensitive and long.", "Sorry, the token is unfortunately expired.", "See login: https://example.com/account/settings for more.", "The key: understanding your readers.", "Her secret is extraordinarily simple; the access token is refreshed.", "config key = /etc/app/settings.conf", "credentials: everyone's responsibility"]


def test_prose(spark):
    """Ordinary words after credential words are no secrets once the corpus has them; a random value is one all the same."""
    rows = [(i, t) for i, t in enumerate(PROSE * 6)] + [(1000 + i, f"Note {t} The pwd: Zq8#kT!v2Lp9x works, bearer: vkxqzwjbgfhp too.") for i, t in enumerate(PROSE)]
    got = {r.doc_id: r.spans for r in s.find_secrets(documents(spark, rows)).collect()}
    assert all(not got[i] for i in range(len(PROSE) * 6))
    assert all(x.count("guess") == 1 for i, x in got.items() if i >= 1000) or all(x.count("guess") == 2 for i, x in got.items() if i >= 1000)
    clean = s.redact(documents(spark, rows[: len(PROSE) * 6]))
    assert sorted(r.text for r in clean.collect()) == sorted(PROSE * 6)


def test_ranks(spark):
    docs = documents(spark, [(i, f"apple apple pear {'rare' * (i < 4)} É-été ab {'x' * 30}") for i in range(6)] + [(9, None)])
    ranks = s.learn_ranks(docs)
    assert {w: ranks[w] for w in ("pear", "été")} == {"pear": 2, "été": 3} and ranks["apple"] == 1 and "rare" not in ranks and "ab" not in ranks and "x" * 30 not in ranks
    assert s.learn_ranks(docs.limit(0)) == s.RANKS


def test_redact(spark):
    rows = [(1, "a password: abcdefghijkl b", "en", "x", 26), (2, "clean", "en", "x", 5), (3, None), (4, "AKIA1234567890ABCD"), (None, "pwd: Zq8#kT!v2Lp9x.")]
    docs = documents(spark, rows)
    out = s.redact(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.schema == docs.schema and got[1].text == "a password: [REDACTED] b" and got[1].n_chars == 24
    assert got[2].text == "clean" and got[3].text is None and got[4].text == "[REDACTED]" and got[None].text == "pwd: [REDACTED]."
    assert s.redact(documents(spark, [])).count() == 0
    long = ("word " * 200_000) + "pwd: Zq8#kT!v2Lp9x. " + "word " * 10
    again = [r.text for r in s.redact(documents(spark, [(7, long), (7, long), (7, ""), (8, None)])).collect()]
    assert sorted(again, key=str) == sorted([long.replace("Zq8#kT!v2Lp9x", "[REDACTED]")] * 2 + ["", None], key=str)
