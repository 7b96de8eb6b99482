"""Secret scans: fixed patterns, and guess costs of values in credential contexts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept
from .decontaminate import with_text

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs of 16 and more are the runs of [0-9a-f]+ that pass
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "guess")

#: Words near which a value may be a credential, what may stand between, and the value.
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "login")
CONTEXT = re.compile(
    r"""\b(?:pass(?:word|wd|phrase|code)?|pwd|(?:client[ _-]?)?secret|(?:access[ _-]?|auth[ _-]?)?token|(?:api|access|private|secret)[ _-]?key|auth(?:orization)?|bearer|credentials?|login)"""
    r"""["']?(?:\s{0,4}(?:=>|:=|[:=])\s{0,4}(?:bearer\s{1,4})?|\s{1,4}is\s{1,4})["']?([^\s"'<>,;(){}\[\]]{6,})""",
    re.I | re.A,
)
#: Values that take 10 to this power guesses or more are secrets.
LEAST_COST = 10.0

#: Common words and passwords, the most common first.
WORDS = """password the and for you that with this admin letmein welcome login monkey dragon master shadow sunshine princess
football baseball superman batman trustno iloveyou secret token test user root guest default changeme example none null true
false string value your have from they not are was but all can her his one our out day get has him how man new now old see two
way who boy did its let put say she too use love hello world home work time people water first would about which their there
summer winter spring autumn monday friday january june july august september october november december computer internet
server database system access key pass word name house mother father school green blue black white silver gold orange apple
company office market street river mountain flower happy lucky angel tiger lion eagle pepper cookie banana purple ginger""".split()
RANKS = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST_WORD = 20
#: Ranks that are learned from a corpus at most, and the documents that a learned word stands in at least.
MOST_RANKS, LEAST_DOCS = 100_000, 5
#: Values that are addresses or paths.
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://|www\.|mailto:|~?\.{0,2}/|[A-Za-z]:\\")
#: Rows of a keyboard.
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
WALKS = {(a, b) for row in KEYBOARD for x in (row, row[::-1]) for a, b in zip(x, x[1:], strict=False)}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
LEET = str.maketrans("430157@$", "aeoistas")


def _alphabet(value: str) -> float:
    if re.fullmatch(r"[0-9]+", value):
        return log10(10)
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return log10(16)
    kinds = sum(n for p, n in ((r"[a-z]", 26), (r"[A-Z]", 26), (r"[0-9]", 10), (r"[^A-Za-z0-9]", 33)) if re.search(p, value))
    return log10(max(kinds, 2))


def learn_ranks(docs: DataFrame, most: int = MOST_RANKS, least_docs: int = LEAST_DOCS) -> dict[str, int]:
    """Words by rank, the most common first: the fixed ones, and of docs(text) the `most` that stand in the most documents.

    Words are runs of 3 to 20 letters (a-z, A-Z in lower case, and characters above ASCII) in `least_docs` documents or
    more.  Spark counts them over all texts; the driver gets no more than `most` rows.
    """
    others = "".join(chr(b) for b in range(128) if not chr(b).isalpha())
    spaced = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + others, "abcdefghijklmnopqrstuvwxyz" + " " * len(others))
    words = docs.select(F.explode(F.array_distinct(F.split(spaced, " "))).alias("word")).filter(F.length("word").between(3, LONGEST_WORD))
    found = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_docs).orderBy(F.desc("n"), "word").limit(most)
    ranks = {r["word"]: i + 1 for i, r in enumerate(found.collect())}
    return ranks | {w: min(i, ranks.get(w, i)) for w, i in RANKS.items()}


def cost_of(value: str, ranks: dict[str, int] = RANKS) -> float:
    """log10 of the guesses for the cheapest way to cut the value into words, dates, repeats, walks and brute-force spans.

    Time is linear in the length: words, walks and dates have bounded lengths or are found once.
    """
    low = value.lower()
    plain = low.translate(LEET)
    each, n = _alphabet(value), len(value)
    best = [0.0] * (n + 1)
    best[1:] = [float("inf")] * n
    run = walk = 0  # length of the repeat and of the walk that end before position j
    dates = {}
    for at in range(n):
        if m := DATE.match(value, at):
            dates.setdefault(m.end(), []).append(at)
    for j in range(1, n + 1):
        best[j] = best[j - 1] + each
        run = run + 1 if j > 1 and low[j - 1] == low[j - 2] else 1
        walk = walk + 1 if j > 1 and (low[j - 2], low[j - 1]) in WALKS else 1
        if run >= 3:
            best[j] = min(best[j], best[j - run] + each + log10(run))
        if walk >= 3:
            best[j] = min(best[j], best[j - walk] + log10(26 * 4 * walk))
        for i in dates.get(j, ()):
            best[j] = min(best[j], best[i] + log10(150 * (365 if j - i > 4 else 1)))
        for size in range(3, min(j, LONGEST_WORD) + 1):
            i = j - size
            rank = ranks.get(low[i:j]) or (ranks.get(plain[i:j], 0) * 4)
            if rank:
                upper = 1 if value[i:j] == low[i:j] else 2
                best[j] = min(best[j], best[i] + log10(rank + 1) + log10(2) * upper)
        for size in range(2, min(j // 2, 16) + 1):  # a block that stands twice
            if low[j - size : j] == low[j - 2 * size : j - size]:
                best[j] = min(best[j], best[j - size] + log10(2))
    return best[n]


class Guesses:
    """Guess costs by one set of ranks, kept for values seen lately (long ones are not kept)."""

    def __init__(self, ranks: dict[str, int] = RANKS):
        self.costs = Kept(lambda value: cost_of(value, ranks), 50_000)

    def __call__(self, value: str) -> float:
        return self.costs[value]


guess_cost = Guesses()


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the base patterns' matches that pass."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]


def guessed_spans(text: str, base: list[tuple[int, int, int, int]], least: float = LEAST_COST, cost=guess_cost) -> list[tuple[int, int, int, int]]:
    """Values in credential contexts, outside the base spans, that are costly to guess and no addresses or paths."""
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".!?:")
        start, end = m.start(1), m.start(1) + len(value)
        if len(value) >= 6 and not any(a < end and start < b for a, _, b, _ in base) and not ADDRESS.match(value) and cost(value) >= least:
            out.append((start, 3, end, start))
    return out


def spans_text(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in sorted(spans))


def find_secrets(docs: DataFrame, least: float = LEAST_COST, ranks: dict[str, int] | None = None) -> DataFrame:
    """One row per document row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start, then kind; base_sha256 is the digest
    of the base spans, spans also holds those of kind `guess`: values after a credential word whose guess
    cost is at least 10^least, where the ranks of words are `ranks`, or learned from all docs; addresses and paths are
    none.  Texts of any length are read whole.  Null text is empty and has none.  Repeated rows and null doc_ids give a row
    each; an empty table gives none.  Extra columns are ignored.
    """

    known = docs.sparkSession.sparkContext.broadcast(learn_ranks(docs) if ranks is None else ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = Guesses(known.value)
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                text = t.as_py() or ""
                base = base_spans(text)
                n = [sum(k == kind for _, k, _, _ in base) for kind in range(3)]
                rows.append((*n, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(base + guessed_spans(text, base, least, cost))))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redacted(text: str | None, mark: str = "[REDACTED]", least: float = LEAST_COST, cost=guess_cost) -> str | None:
    """The text with each secret (of an assignment its value only) replaced by the mark."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for start, end in sorted((s, b) for _, _, b, s in base + guessed_spans(text, base, least, cost)):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, mark: str = "[REDACTED]", least: float = LEAST_COST, ranks: dict[str, int] | None = None) -> DataFrame:
    """docs, all columns and rows, with secrets in texts replaced; n_chars, where it exists, follows the new text.

    Ranks of words are `ranks`, or learned from all docs.  Null texts stay null and empty ones empty; texts of any length
    are read whole; repeated rows are all kept, each with its own text redacted; no rows give none.
    """
    known = docs.sparkSession.sparkContext.broadcast(learn_ranks(docs) if ranks is None else ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = Guesses(known.value)
        for batch in batches:
            old = batch.column("text").to_pylist()
            new = [redacted(t, mark, least, cost) for t in old]
            yield batch if new == old else with_text(batch, new)

    return docs.mapInArrow(run, docs.schema)
