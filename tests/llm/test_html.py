"""Extraction of main texts: consensus, marks, long pages, and a plain version on all given pages."""

import re
import time
from html import unescape

import pytest

from keyspan.llm import html
from tests.conftest import SF

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><div class="cookie-notice">We use cookies</div><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
<div id="content" class="post post-12"><h1>Title &amp; more</h1><p>One <b>bold</b> word<br>next.<p>Two<ul><li>first<li>second</ul><div class="ad">Buy</div><aside>side</aside><form><input>Send</form>
<pre> x   y </pre><!-- hidden --><script>if (a < b) { "</p>" }</script><section class="comments"><p>reader says</section></div><footer>foot</footer></body></html>"""
PROSE = "<p>" + "A sentence of the article that goes on for a while. " * 6 + "</p>"
TEXT = " ".join(PROSE[3:-4].split())


def test_extraction():
    want = "Title & more\n\nOne bold word next.\n\nTwo\n\nfirst\n\nsecond\n\nx y"
    assert html.extract(PAGE, None) == html.extract(PAGE, html.vote(PAGE)[0]) == html.extract(PAGE, "/nowhere") == want
    for cut in range(0, len(PAGE), 7):
        html.extract(PAGE[:cut], None)


@pytest.mark.parametrize("name", ["content no-sidebar", "layout has-sidebar", "post comments-open", "wrapper header-fixed", "content", "related-work-page-content"])
def test_a_name_that_only_mentions_a_part(name):
    page = f'<html><body><nav><a href=x>menu</a></nav><div class="{name}"><h1>Title</h1>{PROSE}<div class="left-sidebar">side</div><div class="sidebar-left">side</div><div id=comments><p>{TEXT}</div></div><footer>f</footer></body></html>'
    assert html.extract(page, None) == html.extract(page, html.vote(page)[0]) == f"Title\n\n{TEXT}"


def test_a_mark_around_the_article_drops_nothing():
    for around in ("form", "aside", 'div class="widget"', 'div class="sidebar"'):
        page = f"<body><{around}><div class=x><h1>Title</h1>{PROSE}</div></{around.split()[0]}></body>"
        assert html.extract(page, html.vote(page)[0]) == f"Title\n\n{TEXT}"


def test_titles_stay():
    for inner in ('<div class="entry-header"><h1>Title</h1></div>', "<header><h1>Title</h1></header>", '<div class="header"><h1>Title</h1></div>'):
        page = f"<body><header><p>Site</header><div class=main>{inner}{PROSE}</div></body>"
        assert html.extract(page, None) == f"Title\n\n{TEXT}"
    page = f"<body><div class=content><h1>Title</h1><div class=lead>In short.</div><div class=body>{PROSE * 9}</div></div><div><a href=1>one</a> <a href=2>two</a></div></body>"
    assert html.extract(page, None) == "\n\n".join(["Title", "In short.", *[TEXT] * 9])


def test_names():
    yes = ["sidebar", "left-sidebar", "sidebar_left", "leftSidebar", "ad-slot", "main-nav", "site-header", "cookie-banner", "post-comments", "comments-list", "share-buttons"]
    no = ["has-sidebar", "no-sidebar", "comments-open", "header-fixed", "entry-header", "article-header", "content", "adventure", "menuhin", "formula", "", "12"]
    assert all(map(html.names_boilerplate, yes)) and not any(map(html.names_boilerplate, no))


def test_long_pages_take_time_in_proportion():
    for part in ("<div>x", "<b><p>x", "<a><div>", "<ul><li><span>x", "<p x='", "<table><tr><td>x", "<!-- x", "<h1>x", "<header><h1>a", '<div a="x', "</p>x", "<div class=sidebar>x", "<![CDATA[x"):
        page = part * (300_000 // len(part))
        start = time.process_time()
        html.extract(page, html.vote(page)[0])
        assert time.process_time() - start < 15, part
    page = "<div>" * 50_000 + "text" + "</div>" * 50_000
    assert html.extract(page, None) == "text"


def test_host_consensus(spark):
    odd = "<body><div class=main><p>short</div><div class=menu-list><p>" + "x " * 300 + "</div></body>"
    usual = "<body><div class=main><p>" + "text " * 50 + "</div><div class=other><p>y</div></body>"
    heavy = "<body><div class=main><p>short text</div><div class=other><p>" + "link farm " * 90 + "</div></body>"
    rows = [(i, f"http://h.example/{i}", usual) for i in range(5)] + [(9, "http://h.example/9", heavy), (10, "http://h.example/10", odd), (11, "http://other.example/", heavy), (12, "http://h.example/12", "<p>alone</p>")]
    got = {r["page_id"]: r["text"] for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).select("row.page_id", "text").collect()}
    assert html.vote(heavy)[0] == "/body/div.other" and got[11].startswith("link farm")
    assert got[9] == "short text" and got[10] == "short" and got[12] == "alone"


def plain(page):
    """The blocks of a given page's only article, by cutting its source."""
    article = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    blocks = [" ".join(unescape(re.sub(r"<[^>]*(?:>|$)", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1|ul|li)>", article)]
    return "\n\n".join(b for b in blocks if b)


def test_the_query_against_a_plain_version(spark):
    where = SF.replace("0.001", "0.01")
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{where}/pages.parquet").collect()}
    got = html.op9_html_text(spark, where).collect()
    assert len(got) == len(pages) and all(r["text"] == plain(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"] for r in got)
