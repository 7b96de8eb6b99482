"""Main text of web pages: containers are scored page by page, hosts vote on their paths, and the winners are re-read."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Hosts whose winning paths are broadcast (about 200 bytes each); with more, pages and paths are joined by shuffle.
MOST_BROADCAST_HOSTS = 100_000

TOKEN = re.compile(
    r"""<!--.*?(?:--\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+)|<""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary"}
#: A start tag that ends an open element of these, if no container lies between.
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("html body div article section main table ul ol dl td th blockquote aside nav header footer form fieldset figure".split())
CONTAINERS = frozenset("html body main article section div td table blockquote center".split())

#: Elements, and words of classes, ids and roles, that are not main text.
BOILERPLATE = frozenset("head nav footer aside form button select input dialog menu svg object canvas audio video map".split()) | RAW
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs"
    " header masthead footer sidebar aside complementary contentinfo cookie cookies consent gdpr notice notification alert popup modal overlay"
    " comment comments disqus respond replies share sharing social related recommended newsletter subscribe subscription signup login search"
    " pagination pager widget toolbar skip hidden".split()
)
#: Of these, words that a theme's wrapper of a whole article may bear as well.
AMBIGUOUS_WORDS = frozenset("header share sharing social search related recommended hidden skip widget toolbar overlay modal login notice promo subscribe newsletter".split())
#: An element that holds at least this share of a page's text outside links is no boilerplate by an ambiguous word alone.
MOST_OF_PAGE = 0.6
WORD = re.compile(r"[A-Za-z]+")
#: Names that begin so tell what a container has, not what it is.
PRESENCE = frozenset(("no", "has", "with", "without", "is", "not"))


class Page:
    """A page as a list of elements and a list of pieces of text in page order."""

    def __init__(self, text: str):
        self.parent, self.key, self.good, self.inside = [-1], [""], [True], [False]
        self.tag, self.named = [""], {}  # named: elements that only words of their attributes speak against
        self.pieces: list[tuple[int, str, bool]] = []  # element, decoded text, whether in a link; "" is a block's border
        self._read(text or "")
        if self.named:
            self._judge()

    def _judge(self) -> None:
        """Takes words of attributes as signs, not as proof, for elements that hold most of the page's text.

        Such an element stays if its words are ambiguous, or if a heading, article or main element lies in it, but not
        beside an article or main element with text that nothing speaks against.
        """
        n = len(self.tag)
        size, headed = [0] * n, [t in ("h1", "article", "main") for t in self.tag]
        for node, words, link in self.pieces:
            if not link and self.good[node]:
                size[node] += len(words.strip())
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
            headed[self.parent[i]] |= headed[i]
        clear, other = [True] * n, False
        for i in range(1, n):
            clear[i] = clear[self.parent[i]] and i not in self.named
            other |= clear[i] and self.good[i] and size[i] > 0 and self.tag[i] in ("article", "main")
        for i in range(1, n):
            found = self.named.get(i)
            kept = not found or not other and size[i] >= MOST_OF_PAGE * size[0] and (headed[i] or found <= AMBIGUOUS_WORDS)
            self.good[i] = self.good[i] and self.good[self.parent[i]] and kept

    def _read(self, text: str) -> None:
        stack, links, at, size = [0], 0, 0, len(text)
        while at < size:
            m = TOKEN.match(text, at)
            at = m.end()
            if (words := m[7]) is not None:
                self.pieces.append((stack[-1], html.unescape(words) if "&" in words else words, links > 0))
                continue
            name = m[2] or m[5]
            if name is None:
                if m[0] == "<":
                    self.pieces.append((stack[-1], "<", links > 0))
                continue
            name, end, rest = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
            if name in BLOCK:
                self.pieces.append((stack[-1], "", False))
            if end:
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] == name:
                        links -= sum(self.tag[x] == "a" for x in stack[i:])
                        del stack[i:]
                        break
                continue
            if name in VOID:
                continue
            shut = SAME.get(name) or ({"p"} if name in CLOSES_P else None)
            if shut:
                for i in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[i]]
                    if t in shut:
                        links -= sum(self.tag[x] == "a" for x in stack[i:])
                        del stack[i:]
                        if name not in ("td", "th", "tr"):
                            break
                    elif t in FENCE:
                        break
            node = self._add(stack[-1], name, rest)
            if rest.endswith("/") and name not in BLOCK and name not in RAW:
                continue
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(text, at)
                at = close.end() if close else size
                continue
            stack.append(node)
            links += name == "a"

    def _add(self, parent: int, name: str, rest: str) -> int:
        classes, words = "", set()
        if "=" in rest:
            found = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(rest)}
            names = [[w.lower() for w in WORD.findall(x)] for v in found.values() for x in v.split()]
            words = {w for x in names if x and x[0] not in PRESENCE for w in x}
            # generalised: classes in order, without digits
            classes = "".join("." + c for c in sorted({re.sub(r"\d+", "", c) for c in found.get("class", "").split()}) if c)
        inside = self.inside[parent] or name in ("article", "main")
        good = self.good[parent] and name not in BOILERPLATE and (name != "header" or self.inside[parent])
        if words and name not in ("html", "body") and (found := BOILERPLATE_WORDS & words):
            self.named[len(self.tag)] = found
        self.parent.append(parent)
        self.tag.append(name)
        self.key.append(f"{self.key[parent]}/{name}{classes}")
        self.good.append(good)
        self.inside.append(inside)
        return len(self.tag) - 1

    def best(self) -> tuple[str, float] | None:
        """(path, score) of the container of most text: text outside links counts for the nearest container, half for the next.

        If that lies inside an article, the outermost one is it; else the same with main.  So a headline or lead beside
        the body's own container, or the other sections of an article, are not left out.
        """
        scores: dict[int, float] = {}
        for node, words, link in self.pieces:
            if words and self.good[node] and not link and not words.isspace():
                size = len(words)
                share = 1.0
                while node >= 0 and share > 0.2:
                    if self.tag[node] in CONTAINERS:
                        scores[node] = scores.get(node, 0.0) + size * share * (1.2 if self.tag[node] in ("article", "main") else 1.0)
                        share /= 2
                    node = self.parent[node]
        if not scores:
            return None
        node = best = max(scores, key=lambda x: (scores[x], -x))
        around = []
        while node > 0:
            around.append(node)
            node = self.parent[node]
        for tag in ("main", "article"):
            best = next((x for x in reversed(around) if self.tag[x] == tag), best)
        return self.key[best], scores[best]

    def text(self, path: str | None) -> str:
        """Text of the elements at the path; of the page's best container where there is none; else of all that is no boilerplate."""
        chosen = self._below(path) if path is not None else None
        if chosen is None:
            found = self.best()
            chosen = self._below(found[0]) if found else [True] * len(self.tag)
        return " ".join("".join(words or " " for node, words, _ in self.pieces if chosen[node] and self.good[node] or not words).split())

    def _below(self, path: str) -> list[bool] | None:
        """Which elements lie at or below the path; None if no main text does."""
        under = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            under[i] = under[self.parent[i]] or (self.good[i] and self.key[i] == path)
        return under if any(words and under[node] and self.good[node] and not words.isspace() for node, words, _ in self.pieces) else None


def host(url: Column) -> Column:
    """Lower-case host of a URL; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): for each host the path with most votes, each page voting for its best container.

    Ties: more text, then the smaller path.  Votes are added up before they move, so a large host costs no more than others.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(x.as_py() or "").best() for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([x and x[0] for x in found], pa.string()), pa.array([int(x[1]) if x else 0 for x in found], pa.int64())], ["host", "path", "score"])

    votes = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string, score bigint").filter("path is not null")
    sums = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    return sums.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def extract_text(pages: DataFrame, most_broadcast: int = MOST_BROADCAST_HOSTS) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars (code points), path (the host's winning path, null if none).

    A page without text at its host's path gives the text of its own best container; one without any main
    text gives "".  Character references are decoded, white space inside a block is one space, and blocks
    are joined by one space in page order; nothing is cut.

    Null html is an empty page.  Pages without a host in their url form one group.  Repeated rows and null
    page_ids give a row each; an empty table gives none.  Extra columns are ignored.
    """
    paths = materialize(winning_paths(pages), "host-paths")
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    rows = rows.join(F.broadcast(paths) if paths.count() <= most_broadcast else paths, "host", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [Page(x.as_py() or "").text(p) for x, p in zip(batch.column("html"), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64()), batch.column("path")], ["page_id", "url", "text", "n_chars", "path"])

    return rows.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", "path").mapInArrow(read, "page_id bigint, url string, text string, n_chars bigint, path string")
