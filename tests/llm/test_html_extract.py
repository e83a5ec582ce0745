import html
import re
import time

import pytest
from binomia.llm import html_extract as X

P = "<p>" + "Lorem ipsum dolor sit amet, consectetur adipiscing elit sed do. " * 3 + "</p>"
T = " ".join(["Lorem ipsum dolor sit amet, consectetur adipiscing elit sed do."] * 3)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<html><body><div id=header><a href=/>Home</a> Site</div><div class='menu'><ul><li><a href=x>One</a></ul></div><div class=content><h1>Title</h1>{P}<p>Short.</p>{P}</div><div class='sidebar'>{P}</div><div id='comments'>{P}</div><div class=footer>foot</div></body></html>", f"Title {T} Short. {T}"),
        (f"<body><nav>n</nav><article><header><h1>T</h1></header><section>{P}{P}</section><section>{P}</section><section><p>Tiny.</p></section><div class='comments'>{P}{P}</div></article><aside>{P}</aside><footer>f</footer>", f"T {T} {T} {T} Tiny."),
        (f"<body><header>Site</header><main><div class='cookie-notice'>We use cookies</div><h1>Q</h1>{P}<ul><li>one<li>two</ul><blockquote>q</blockquote><pre>a  b\n c</pre><form><input value=2>sub</form></main><script>if(a<b)'</p>'</script></body>", f"Q {T} one two q a b c"),
        (f"<body><div><div><ul><li><a href=1>aaa</a><li><a href=2>bbb</a></ul></div><div><div><p>Hi</p>{P}</div><div>{P}{P}</div></div></div></body>", f"Hi {T} {T} {T}"),
        (f"<body><article><p>x<b>y</b>z &amp;amp; &eacute;&#8212;&nbsp;a<!-- no -->b</p>{P}</article>", f"xyz &amp; é— ab {T}"),
        (f"<body><nav>n</nav><article><h2>One</h2>{P}</article><aside>{P}</aside><article><h2>Two</h2>{P}{P}</article><article><h2>Three</h2><p>Tiny.</p></article><footer>f</footer></body>", f"One {T} Two {T} {T} Three Tiny."),
        (f"<body><div class='header-image article-body'><h1>H</h1>{P}{P}<div class='social-history'>{P}</div></div><div class='sidebar-left'>{P}</div><div class='site-footer'>{P}</div></body>", f"H {T} {T} {T}"),
        (f"<body><main><div class='post-header'><h1>H</h1></div>{P}</main><div class='page footer-links'>{P}</div><article class=teaser><a href=1>more</a> <a href=2>and more</a></article></body>", f"H {T}"),
        ("just text &amp; more <b>bold</b>x", "just text & more boldx"),
        ("<html><body><div class=nav>a</div><article><h1>A</h1><p>B</p></article></body>", "A B"),
        ("<body><nav>x</nav></body>", ""), ("", ""), ("<p", ""), ("<!-- x", ""),
    ],
)
def test_made_pages(page, want):
    assert X.extract(page) == want


def test_pages_against_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in X.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_broken_pages_take_linear_time():
    began = time.monotonic()
    for page in ("<div>" * 50_000 + "x", "<p>a" * 100_000, '<a href="' * 20_000, "</b>" * 100_000 + "<b>" * 1000 + "</i>" * 5000, "<" * 200_000, "<li>" * 20_000 + "</ul>" * 20_000, "<td>" * 50_000, "<script>" * 20_000):
        X.extract(page)
    assert time.monotonic() - began < 30


def test_edges(spark):
    rows = [(None, None, None), (1, None, ""), (2, "u", "<p>x"), (2, "u", "<p>x")]
    got = X.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'c' as text", "1 as n_chars")).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "", 0), ("2", "x", 1), ("2", "x", 1), ("None", "", 0)]
    assert X.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_pages_without_names(spark):
    """Element names, classes and ids that name the article are taken away: the choice is by density alone."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(400).collect()
    right = 0
    for r in pages:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        bare = re.sub(r"<(/?)(?:article|main|nav|aside|header|footer|section)\b[^>]*>", r"<\1div>", r.html)
        bare = re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", bare)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        right += X.extract(bare) == want
    print(right, len(pages))
    assert right >= 0.9 * len(pages)
