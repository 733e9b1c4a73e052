import html
import re

import pytest

from tidecast.llm import html_text as h
from tests.conftest import SF

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home">
<header class="site-header"><a href="/">Home</a></header><div class="cookie-notice">We use cookies</div>
<nav><ul><li><a href=1>One</a></li></ul></nav><aside>Side</aside>
<main><article id="post-1"><header><h1>Title &amp; <i>more</i></h1></header><p>One<br>two&nbsp;three &#x41;
 four</p><script>if (a<b) {document.write("</p><p>no")}</script><div class="ad-slot">Buy</div><blockquote><p>Said</p></blockquote>
<table><tr><td>a</td><td>b</td></tr></table><form><label>Mail</label><input></form><p hidden>gone</p><p style="display: none">gone</p></article>
<section id="comments"><article class="comment"><p>Nice!</p></article></section></main>
<div role="alert">Alert</div><footer>&copy; 2020</footer><!-- <p>no</p> --></body></html>"""


def _text(page, *others):
    return h.main_text(h.lines_of(page), [h.lines_of(o) for o in others])


def test_structure():
    assert _text(PAGE) == "Title & more\n\nOne two three A four\n\nSaid\n\na b"


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain text &lt;b&gt; only", "plain text <b> only"),
        ("<p>one<p>two<div>three</p>four", "one\n\ntwo\n\nthree\n\nfour"),
        ("<article><p>open", "open"),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
        ('<article><p title="x > y">t</p></article>', "t"),
        ("<div class='post-content'><p>in</p></div><p>out</p>", "in"),
        ("<article><div class=ad><div>x</div>y</div>z</article>", "z"),
        ("<article>a<script>never closed", "a"),
        ("<ul><li>x<li>y</ul>", "x\n\ny"),
        ("<article><p class=ad>x<p>y</article>", "y"),
    ],
)
def test_small_pages(page, text):
    assert _text(page) == text


REAL = "<h1>Title</h1><p>The first paragraph of the article.</p><p>And its second one, a little longer.</p>"
MENU = "<nav><a href=1>One</a></nav><div class='sidebar'><p>Side</p></div>"
WANT = "Title\n\nThe first paragraph of the article.\n\nAnd its second one, a little longer."


@pytest.mark.parametrize(
    "body",
    [
        f'<article class="post hentry has-comments">{REAL}</article>',
        f'<main class="with-sidebar">{REAL}</main>',
        f'<div class="layout no-sidebar"><article>{REAL}</article></div>',
        f'<div class="share-enabled"><article>{REAL}</article></div>',
        f'<div class="ad-supported"><article>{REAL}</article></div>',
        f'<article class="post category-notices tag-ads">{REAL}</article>',
        f'<div id="sidebar-wrapper"><article>{REAL}</article></div>',
        f'<div class="menuBarOpen"><div class="content">{REAL}</div></div>',
        f'<div class="promo">{REAL}</div>',
        f'<div class="overlay"><main>{REAL}</main><div class="comments"><p>I say.</p></div></div>',
        f'<form id="aspnetForm"><article>{REAL}</article><input></form>',
        f'<div class="layout-sidebar-right"><article>{REAL}</article><section id="comments"><article><p>{"A long comment. " * 40}</p></article></section></div>',
        f'<main><article>{REAL}</article><section class="comment-list"><p>{"A long comment. " * 40}</p></section></main>',
        f'<main><div class="post-content">{REAL}</div><div class="related"><p>{"Read this. " * 40}</p></div></main>',
        f'<div class="post-content">{REAL}</div><div id="comments"><p>{"A long comment. " * 40}</p></div>',
    ],
)
def test_names_count_less_than_content(body):
    assert _text(f"<body>{MENU}{body}<footer>End</footer></body>") == WANT


@pytest.mark.parametrize("name", "sidebar related-posts comments-area cookie-banner newsletter-signup share-buttons ad-slot site-footer page-footer sidebar-left main-menu breadcrumbs".split())
def test_names_of_furniture_still_tell(name):
    assert _text(f'<body><article>{REAL}</article><div class="{name}"><p>Gone.</p></div></body>') == WANT
    assert _text(f'<body><article>{REAL}<div class="{name}"><p>Gone.</p></div></article></body>') == WANT
    assert _text(f'<body><div class="{name}"><p>Gone.</p></div>{REAL}</body>') == WANT


PLAIN = "<body><div><a href=1>Home</a> <a href=2>News</a></div><div>Site name %s</div><p>Real text %s here.</p><p>Other %s text.</p><p>A third one, %s.</p><div>Write to us</div></body>"


def test_shared_lines_go_without_containers():
    a, b = PLAIN % ("X", 1, 1, 1), PLAIN % ("X", 2, 2, 2)
    assert _text(a, b) == "Real text 1 here.\n\nOther 1 text.\n\nA third one, 1."
    assert _text(a, a) == "Site name X\n\nReal text 1 here.\n\nOther 1 text.\n\nA third one, 1.\n\nWrite to us"  # a copy tells nothing
    assert _text(a) == _text(a, a)


def _longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines(monkeypatch):
    import random

    r = random.Random(4)
    for _ in range(200):
        a, b = (list(map(str, r.choices(range(6), k=r.randint(0, 12)))) for _ in "ab")
        keep = h.common(a, b)
        got = [x for x, k in zip(a, keep, strict=True) if k]
        it = iter(b)
        assert all(x in it for x in got) and len(got) == _longest(a, b)
    monkeypatch.setattr(h, "CELLS", 3)
    keep = h.common(["p", "a", "q", "b", "r"], ["x", "a", "y", "b", "z"])
    assert keep.tolist() == [False, True, False, True, False]


def test_query_gives_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = h.op7_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"(?s)<article>(.*?)(</article>|<footer|$)", pages[r.page_id].html)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", article))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_edge_rows(spark):
    rows = [(1, "http://www.a.example/x/1.html?q=1", PLAIN % ("X", 1, 1, 1)), (2, "https://a.example/x/2/", PLAIN % ("X", 2, 2, 2)), (3, None, PAGE), (4, "not a url", None), (5, "", ""), (5, "", "")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, lines string, part int")
    got = {r.page_id: r.text for r in h.extract(pages).collect()}
    assert got == {1: "Real text 1 here.\n\nOther 1 text.\n\nA third one, 1.", 2: "Real text 2 here.\n\nOther 2 text.\n\nA third one, 2.", 3: _text(PAGE), 4: "", 5: ""}
    assert h.extract(pages).count() == len(rows)
    assert h.extract(pages.limit(0)).count() == 0


SHARED = "<body><article><h1>Title %s</h1><div>Tell your friends</div><p>Body %s.</p><p>Said by both.</p><p><a href=1>More of this</a></p></article></body>"


def test_site_lines_go_from_articles(spark):
    rows = [(k, f"http://a.example/x/{k}", SHARED % (k, k)) for k in range(3)]
    want = {k: f"Title {k}\n\nBody {k}.\n\nSaid by both." for k in range(3)}
    assert _text(rows[0][2], rows[1][2]) == want[0]
    assert {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == want


def test_common_lines_at_any_size(monkeypatch):
    import random

    r = random.Random(5)
    monkeypatch.setattr(h, "CELLS", 8)
    for _ in range(200):
        a, b = (list(map(str, r.choices(range(4), k=r.randint(0, 30)))) for _ in "ab")
        got = [x for x, k in zip(a, h.common(a, b), strict=True) if k]
        it = iter(b)
        assert all(x in it for x in got) and len(got) == _longest(a, b)
    monkeypatch.undo()
    # 12,000 lines, of which one comes again at the end of the other page
    a, b = [f"s{k}" for k in range(6000)], [f"s{k}" for k in range(6000)]
    a = [x for k, s in enumerate(a) for x in (s, f"a{k}")]
    b = [x for k, s in enumerate(b) for x in (f"b{k}", s)] + ["s0", "end"]
    assert h.common(a, b).sum() == 6000


def test_short_text_under_long_menus():
    menu = "".join(f"<div>Menu {k}</div>" for k in range(20))
    a, b = (f"<body>{menu}<p>Text {k}.</p></body>" for k in "ab")
    assert _text(a, b) == "Text a."


def test_no_pair_is_lost_at_cuts(spark, monkeypatch):
    monkeypatch.setattr(h, "PART", 4)
    # a line stands on two pages that follow each other, so each pair tells something
    rows = [(k, f"http://a.example/x/{k:03}?q={k}", f"<p>Real {k}.</p><p>both {k // 2}</p><p>pair {(k + 1) // 2}</p>") for k in range(60)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Real {k}." for k in range(1, 59)} | {0: "Real 0.\n\npair 0", 59: "Real 59.\n\npair 30"}


def _brute_force(pages):
    """Texts of all pages (page_id, url, html), by sorting them and aligning each with the pages beside it."""

    def parts(p):
        rest = re.sub(r"^[a-z][a-z0-9+.-]*://|[?#].*$", "", (p[1] or "").lower())
        host = rest.split("/")[0]
        path = re.sub(r"(?:\.[a-z]{2,5})?/*$", "", rest[len(host) :])
        return re.sub(r"^(?:www|m)\.|:\d+$", "", host), re.sub(r"[^/]*$", "", path), path, p[0]

    rows = sorted(pages, key=parts)
    lines = [h.lines_of(p[2] or "") for p in rows]
    hosts = [parts(p)[0] for p in rows]
    return {p[0]: h.main_text(lines[k], [lines[j] for j in (k - 1, k + 1) if 0 <= j < len(rows) and hosts[j] == hosts[k]]) for k, p in enumerate(rows)}


@pytest.mark.parametrize("tag", ["article", "div"])
def test_all_pages_against_brute_force(spark, monkeypatch, tag):
    """All pages, as they are and with their article elements turned into plain boxes, so that differencing alone tells what is the site's."""
    monkeypatch.setattr(h, "PART", 24)
    pages = [(r.page_id, r.url, re.sub(r"<(/?)article", rf"<\1{tag}", r.html)) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = {r.page_id: r for r in h.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {k: r.text for k, r in got.items()} == _brute_force(pages)
    assert len(got) == len(pages) and sum(r.n_shared for r in got.values()) > 0
    if tag == "div":
        articles = {r.page_id: r.text for r in h.op7_html_extraction(spark, SF).collect()}
        lines = [(set(got[k].text.split("\n\n")), set(t.split("\n\n"))) for k, t in articles.items()]
        same = sum(len(x & y) for x, y in lines)
        assert same / sum(len(y) for _, y in lines) > 0.98 and same / sum(len(x) for x, _ in lines) > 0.98


def test_rows_equal_in_all_columns_and_very_long_pages(spark, monkeypatch):
    monkeypatch.setattr(h, "PART", 8)
    page = PLAIN % ("X", 1, 1, 1)
    rows = [(1, "http://a.example/x/1", page)] * 500 + [(2, "http://a.example/x/2", PLAIN % ("X", 2, 2, 2))]
    got = [(r.page_id, r.text) for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(got) == 501 and set(got) == {(k, f"Real text {k} here.\n\nOther {k} text.\n\nA third one, {k}.") for k in (1, 2)}
    long = ["".join(f"<p>own {k} {i}</p><div>site {i}</div>" for i in range(40_000)) for k in range(2)]
    got = h.extract(spark.createDataFrame([(k, f"http://b.example/{k}", t) for k, t in enumerate(long)], "page_id long, url string, html string")).collect()
    assert all(r.text == "\n\n".join(f"own {r.page_id} {i}" for i in range(40_000)) and r.n_shared == 40_000 for r in got)
