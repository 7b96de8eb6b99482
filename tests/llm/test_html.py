import pytest

from assaylake.llm import html_extract as h


def page(main, extra=""):
    return f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><header>Head <b>er</b></header><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class='ad top'>Buy</div>{main}<aside>Side</aside><section id=comments><p>I think so, too, and my comment is quite long, longer than the article is.</p></section>{extra}<footer>&copy; me</footer></body></html>"


CASES = [
    (page("<article><h1>A &amp; B</h1><p>one\n  two&nbsp;three<br>four<p>five <b>s</b>ix</article>"), "A & B one two three four five six"),
    (page("<div class=story12><p>x &lt;y&gt; z<p>q</div>"), "x <y> z q"),
    (page("<main><header><h1>Title</h1></header><form><input><p>no</p></form><p>Body<!-- no --> text</p></main>", "<div role=alert>Note</div>"), "Title Body text"),
    (page("<article><h1>Head</h1><p>lead</p><div class=body><p>" + "long body " * 40 + "</p></div></article>"), "Head lead " + ("long body " * 40).strip()),
    (page("<main><section><p>" + "one " * 90 + "</p></section><section><p>two</p></section><div class=related><p>teaser</p></div></main>"), "one " * 90 + "two"),
    (page("<main><p>intro of the site</p><article><div><p>" + "text " * 30 + "</p></div><div><p>end</p></div></article></main>"), "text " * 30 + "end"),
    ("<div class='related-work'><p>main text</p></div><div class=x><p>short</p></div>", "main text"),
    ("<div class='search-results article'><p>article</p></div>", "article"),
    ("<div class=ad><p>" + "buy " * 50 + "</p></div><div><p>short</p></div>", "short"),
    ("<div class='ad'><p>" + "buy " * 50 + "</p></div><article><p>short</p></article>", "short"),
    ("<div class='comments-open sidebar-right'><h1>Head</h1><p>" + "body " * 30 + "</p></div><div class=comments><p>no</p></div>", "Head " + ("body " * 30).strip()),
    ("", ""),
    (None, ""),
    ("just text & more &#233;", "just text & more é"),
    ("<nav>only menus</nav>", ""),
    ("<div><p>open <b>never closed <i>at all", "open never closed at all"),
    ("<p>a < b and <</p>", "a < b and <"),
    ("<article><p>" + "word " * 30_000 + "</p></article>", ("word " * 30_000).strip()),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_page(html, text):
    assert h.Page(html or "").text(None) == text


@pytest.mark.parametrize("word", sorted(h.BOILERPLATE_WORDS))
def test_wrapper(word):
    """A theme's wrapper of the whole article may bear any word; its own small parts with that word go."""
    body = f"<div class='{word}-theme'><h1>Head</h1><p>{'body ' * 20}</p><div class={word}><p>no</p></div></div>"
    assert h.Page(f"<body>{body}<footer>end</footer></body>").text(None) == "Head " + ("body " * 20).strip()


@pytest.mark.parametrize("most", [h.MOST_BROADCAST_HOSTS, 0])
def test_hosts(spark, most):
    """A host's winning path also picks the article on a page whose largest container is something else."""
    other = page("<div class='post 1'><p>short one</p></div><div class=extra><p>" + "links and teasers of other stories " * 5 + "</p></div>")
    rows = [(i, f"https://A.example/{i}", page(f"<div class='post {i}'><p>the article number {i} is long enough to win</p></div><div class=extra><p>t</p></div>")) for i in range(5)]
    rows += [(5, "https://a.example/x?y", other), (6, None, "<p>no host</p>"), (7, "//b.example", None), (None, "http://c.example/", "<p>c</p>"), (6, None, "<p>no host</p>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, PATH string").repartition(3)
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in h.extract_text(df, most).collect()), key=repr)
    want = [(i, u, f"the article number {i} is long enough to win") for i, u, _ in rows[:5]] + [(5, "https://a.example/x?y", "short one"), (6, None, "no host"), (7, "//b.example", ""), (None, "http://c.example/", "c"), (6, None, "no host")]
    assert got == sorted(((i, u, t, len(t)) for i, u, t in want), key=repr)
    assert h.extract_text(df.limit(0), most).count() == 0


def test_whole_table(spark, tiny):
    """The made pages hold one article each, in blocks that a plain reading can find."""
    import html
    import re

    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    got = {r.page_id: r.text for r in h.extract_text(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"</?(?:p|br|h1)[^>]*>", " ", article).replace("<b>", "").replace("</b>", "")).split())
