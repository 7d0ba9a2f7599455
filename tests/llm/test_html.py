import os
import re
import time

import pytest

from threadloom.llm.html import Rules, blocks, extract, main_text

PROSE = "It was the best of the times and it was in the end the worst of them all, so they said to us and to you. "
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home of it</a></header><nav><ul><li><a href=x>One</a></li></ul></nav><div class="cookie-notice">We use the cookies on this site and you will like it.</div>
<article><h1>A title</h1><p><b>{PROSE}<br><p>Ok &amp; short&nbsp; one.</p><div class="ad">Buy it now and be happy with the thing</div><p>x</p><form><label>Mail</label></form></article>
<aside><p>{PROSE}</p></aside><section id="comments"><p>{PROSE}</p></section><footer>&copy; us</footer></body></html>"""


def test_article_only():
    assert main_text(PAGE) == f"A title {PROSE.strip()} Ok & short one. x"


def test_page_without_article_element():
    page = f"<body><div><a href=1>Menu one</a> <a href=2>two</a></div><h2>Head</h2><p>{PROSE * 3}</p><p>Short.</p><p>{PROSE * 2}</p><div><a href=3>more</a></div></body>"
    assert main_text(page) == f"Head {(PROSE * 3).strip()} Short. {(PROSE * 2).strip()}"


def test_bad_markup_does_not_lose_text():
    assert main_text("<article><p>cut <b>off <i") == "cut off"
    assert main_text("<article>a < b &lt;c&gt; <!-- open") .startswith("a < b <c>")
    assert main_text("<article><script>never ends") == ""
    assert [b.text for b in blocks("<P>x<BR/>y</P >z")] == ["x", "y", "z"]


def test_null_empty_and_long(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "y"), (None, "w", "<article>" + "<p>word of it</p>" * 30_000 + "</article>", "z"), (1, "u", None, "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 0, 30_000 * 11 - 1]
    assert extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string").filter("false")).count() == 0


def test_parts_of_an_article_that_are_none():
    page = f"""<body class="has-sidebar"><form id="aspnetForm"><div class="layout no-sidebar"><article><header class="entry-header"><h1><a href="#t">Title</a></h1></header>
<p class="notice">We use the cookies of this site for you</p><p>{PROSE}</p><ul><li>first of it<li class="ad">an advert for you<li>last of it</ul><p><a href="/x">All of this is a link to the rest</a></p>
<table><tr><td>cell<td class="promo">buy it<td>end</table><ul><li><a href=1>Read it</a><li><a href=2>And that</a></ul><div id="reader-comments"><article><p>{PROSE}</p></article></div><footer>by us</footer></article></div></form>"""
    assert main_text(page) == f"Title {PROSE.strip()} first of it last of it All of this is a link to the rest cell end"


def test_article_by_name_alone():
    page = f"""<body><div id="header">Site of it</div><div class="wrap"><div class="post-content"><h2>Head</h2><p>Short one</p><p>{PROSE}</p></div><div class="box">Some words of the site</div></div></body>"""
    assert main_text(page) == f"Head Short one {PROSE.strip()}"


PAGES = "/root/testdata/sf0.01/pages.parquet"


def without_names(html):
    """The page without any element or name that tells of its parts."""
    return re.sub(r' (class|id|role)="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer|header|aside|main|section)\b", r"<\1div", html))


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test tables")
def test_rules_find_the_text_without_names():
    import pyarrow.parquet as pq

    pages = pq.read_table(PAGES).column("html").to_pylist()
    named, bare = [main_text(p) for p in pages], [main_text(without_names(p)) for p in pages]
    assert sum(a == b for a, b in zip(named, bare)) >= 0.95 * len(pages)
    for rules in (Rules(links=9), Rules(short=0, long=0)):
        assert sum(a == main_text(without_names(p), rules) for a, p in zip(named, pages)) < sum(a == b for a, b in zip(named, bare))


def test_open_blocks_take_the_label_of_the_nearest():
    menu = "<div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>"
    page = f"<body>{menu}<div>Buy it now</div><div><h2>Head</h2><p>Short one.</p><p>{PROSE * 3}</p><p>Last words</p></div><div>&copy; us and all of the others</div></body>"
    assert main_text(page) == f"Head Short one. {(PROSE * 3).strip()} Last words"


def test_stop_words_length_and_links_decide():
    words = " ".join(f"Item{i}" for i in range(60))
    page = f"<body><div><p>{words}</p></div><div><p>{PROSE * 3}</p><p>{words}</p></div></body>"
    text = (PROSE * 3).strip()
    assert main_text(page) == f"{text} {words}" and main_text(page, Rules(stops=0, few_stops=0)) == f"{words} {text} {words}"
    linked = f"<body><div><p><a href=1>{PROSE}</a> and {PROSE}</p></div><div><p>{PROSE * 3}</p></div></body>"
    assert main_text(linked) == text and main_text(linked, Rules(links=0.9)).count("best") == 5
    two = f"<body><div><p>{PROSE}</p></div><div><a href=1>Menu</a></div><div><p>{PROSE * 3}</p></div></body>"
    assert main_text(two, Rules(long=500)) != main_text(two, Rules(long=50))


def test_markup_of_any_kind_takes_time_in_proportion():
    for part in ("<a x='y' z ", "<div>", '<a "', "<li>", "<table><tr><td>", "<p>a", "<div>a", "</b><div>", "<a href='"):
        started = time.time()
        assert main_text(part * 40_000) is not None
        assert time.time() - started < 8
    started = time.time()
    assert main_text("<div>" * 20_000 + "</b>" * 20_000) == ""
    assert time.time() - started < 5
