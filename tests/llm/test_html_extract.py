"""Main text against a plain reading of the marked article, and of handmade pages."""

import html
import re

from cloudframe.llm.html_extract import extract, html_query, main_text, smooth

DATA = "/root/testdata/sf0.01"


def plain(page):
    article = re.search(r"<article\b[^>]*>(.*?)(?:</article>|\Z)", page, re.S)[1]
    article = re.sub(r"<(script|style|form|aside|nav|footer)\b.*?</\1>|<!--.*?-->", "", article, flags=re.S)
    blocks = re.split(r"</?(?:p|h\d|div|ul|ol|li|section|blockquote|table|tr|td)\b[^>]*>", article)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b)).split()) for b in blocks)
    return " ".join(t for t in texts if t)


def test_whole_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = html_query(spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id])
        assert r.n_chars == len(r.text)


def test_parts_that_are_not_content():
    words = "The quick brown fox jumps over the lazy dog and runs far away. " * 4
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav>Home About</nav>
    <div class="cookie-notice">We use cookies</div><main><h1>Head &amp; line</h1><p>{words}</p><p>Short.</p>
    <script>var x = "</p>";</script><form>Sign up <input></form><aside>Related</aside></main>
    <section id="comments"><p>{words} by a reader</p></section><footer>&copy; 2024</footer></body></html>"""
    assert main_text(page) == f"Head & line {' '.join(words.split())} Short."


def test_without_marked_region():
    words = "Some long sentence that goes on and on with many words in it, as articles do. " * 3
    menu = "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(12))
    page = f"<body><div><ul>{menu}</ul></div><div><h2>Title</h2><p>{words}</p><p>{words}</p></div><div><a>x</a> <a>y</a> <a>z</a></div></body>"
    got = main_text(page)
    assert got == f"Title {' '.join(words.split())} {' '.join(words.split())}"


def test_smoothing_keeps_constants():
    assert abs(smooth([3.0] * 9) - 3).max() < 1e-12


def test_edge_cases(spark):
    rows = [(1, "u", None, "a"), (2, None, "", "b"), (None, "u", "<article><p>x</p>", "c"), (3, "u", "plain & text <b>only", "d"), (3, "u", "<article><p>" + "y " * 200_000, "e"), (4, "u", "<<<>>>&&&", "f")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.n_chars) for r in extract(pages).collect()}
    assert {(1, 0), (2, 0), (None, 1), (3, 399_999)} <= got and len(got) == 6
    assert extract(pages.limit(0)).count() == 0


LONG = " ".join(("The quick brown fox jumps over the lazy dog and runs far away. " * 4).split())


def test_names_of_wrappers_do_not_take_the_article():
    article = f"<article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article>"
    want = f"Head {LONG} Short."
    for name in ("layout has-sidebar", "no-sidebar", "elementor-widget-container", "search-page", "content-sidebar-wrap", "widget", "sidebar"):
        assert main_text(f'<body><div class="{name}">{article}</div><div class="sidebar">Aside words</div></body>') == want, name
    assert main_text(f'<body><div id="header"><div role="main"><p>{LONG}</p></div></div></body>') == LONG
    # no region marked: most of the text
    assert main_text(f'<body><div class="sidebar-left"><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div></body>') == f"Head {LONG} {LONG}"
    assert main_text(f'<body><div><div class="elementor-widget-container"><p>{LONG}</p></div><div class="elementor-widget-container"><p>{LONG}</p></div></div></body>') == f"{LONG} {LONG}"


def test_header_of_an_article_stays():
    for head in ('<header class="entry-header"><h1>Head</h1></header>', '<div class="post-header"><h1>Head</h1></div>', '<div class="header"><h1>Head</h1></div>', '<h1 id="search">Head</h1>'):
        assert main_text(f"<body><header>Site</header><article>{head}<p>{LONG}</p></article></body>") == f"Head {LONG}", head
    assert main_text(f'<body><div class="site-header">Site</div><div><div class="post-header"><h1>Head</h1></div><p>{LONG}</p><p>{LONG}</p></div></body>') == f"Head {LONG} {LONG}"


def test_names_still_set_aside():
    for name in ("cookie-notice", "sidebar", "td-footer-wrapper", "google-ad", "ad-banner-728x90", "comments-area", "related-posts", "widget"):
        part = f'<div class="{name}"><p>Not wanted.</p></div>'
        assert main_text(f"<body>{part}<article><p>{LONG}</p>{part}</article>{part}</body>") == LONG, name
    # teasers and readers' comments are often marked as articles
    for name in ("sidebar", "comments"):
        others = f'<div class="{name}"><article><p>One more.</p></article><article><p>And more.</p></article></div>'
        assert main_text(f"<body><article><h1>Head</h1><p>{LONG}</p></article>{others}</body>") == f"Head {LONG}", name
        assert main_text(f"<body><div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div>{others}</body>") == f"Head {LONG} {LONG}", name
    comments = "".join(f"<article><p>{LONG} {i}</p></article>" for i in range(9))
    assert main_text(f'<body><article><h1>Head</h1><p>{LONG}</p></article><div id="comments">{comments}</div></body>') == f"Head {LONG}"


def test_unmarked_page_keeps_its_short_lines():
    items = [f"item {i:05}" for i in range(8)]
    listed = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
    body = f"<div><h1>Head</h1>{f'<p>{LONG}</p>' * 6}{listed}{f'<p>{LONG}</p>' * 3}</div>"
    assert main_text(f"<body>{body}</body>") == " ".join(["Head", *[LONG] * 6, *items, *[LONG] * 3])
    assert main_text(f"<body><div><p>By A. Writer</p>{f'<p>{LONG}</p>' * 3}<p>That was all then.</p></div></body>") == " ".join(["By A. Writer", *[LONG] * 3, "That was all then."])
    assert main_text(f"<body><div><p>By A. Writer</p><p>{LONG}</p><p>The end.</p></div></body>") == f"By A. Writer {LONG} The end."


def test_unmarked_page_without_its_menus():
    menu = "<ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(9)) + "</ul>"
    text = f"<h1>Head</h1><p>By A. Writer</p><p>{LONG}</p>{menu}<p>{LONG}</p><p>End.</p>"
    between = " ".join(f"Item {i}" for i in range(9))
    for at in (menu, f"<div>{menu}</div>"):
        assert main_text(f"<body>{at}{text}{at}</body>") == f"Head By A. Writer {LONG} {between} {LONG} End."


def test_whole_table_without_article_tags(spark):
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        assert main_text(re.sub(r"</?article\b[^>]*>", "", r.html)) == plain(r.html), r.page_id


def test_readers_comments_marked_as_articles():
    comments = "".join(f'<article class="comment depth-1" id="comment-{i}"><p>{LONG} {i}</p></article>' for i in range(9))
    assert main_text(f"<body><article class='post comments-open'><h1>Head</h1><p>{LONG}</p></article><section>{comments}</section></body>") == f"Head {LONG}"
    assert main_text(f"<body><article><h1>Head</h1><p>{LONG}</p>{comments}</article></body>") == f"Head {LONG}"
    assert main_text(f'<body><article><div class="hidden-gems"><p>{LONG}</p></div></article></body>') == LONG


def test_smoothing_and_threshold_decide(monkeypatch):
    """A lone sentence among a page's menus is no content; without smoothing over its neighbours it would be."""
    from cloudframe.llm import html_extract as H

    menu = "".join(f'<div><a href="/{i}">Item {i}</a></div>' for i in range(4))
    lone = "<div>Here is a lone sentence that tells what this site is about and who made it.</div>"
    page = f"<body><div>{menu}{lone}{menu}</div><div><p>By A. Writer</p>{f'<p>{LONG}</p>' * 6}</div></body>"
    assert main_text(page) == " ".join(["By A. Writer", *[LONG] * 6])
    monkeypatch.setattr(H, "smooth", lambda values: values)
    assert "lone sentence" in main_text(page)


def test_cut_off_markup():
    import time

    began = time.perf_counter()
    assert main_text(f"<body><article><p>{LONG}</p>{'<a ' * 50_000}") == LONG
    assert main_text(f"<body><article><p>{LONG} a < b <img src='x") == f"{LONG} a < b"
    assert time.perf_counter() - began < 5


def test_other_articles_and_tools(monkeypatch):
    from cloudframe.llm import html_extract as H

    article = f"<main><article><h1>Head</h1><p>{LONG}</p></article></main>"
    assert main_text(f'<body>{article}<section class="stories"><article><h3>One more</h3><p>A teaser of it.</p></article></section></body>') == f"Head {LONG}"
    # parts of alike length are one text
    assert main_text(f"<body><article><p>{LONG}</p></article><article><p>{LONG}</p></article></body>") == f"{LONG} {LONG}"
    for name in ("sidebar-widget", "adsbygoogle", "author-bio", "more-stories", "newsletter-widget"):
        assert main_text(f'<body><article><p>{LONG}</p><div class="{name}"><p>Not wanted here.</p></div><p>{LONG}</p></article></body>') == f"{LONG} {LONG}", name
    # a part that is named like a tool and holds a paragraph
    tools = '<div class="share"><a href="/">Like</a> <a href="/">Send</a></div>'
    page = f'<body><article><p>{LONG}</p><section class="search"><p>{LONG}</p></section>{tools}<p>{LONG}</p><p>{LONG}</p></article></body>'
    assert main_text(page) == " ".join([LONG] * 4)
    # smoothing decides in marked pages too: a note among the links of a tool is none of the text
    links = "".join(f'<p><a href="/{i}">Go {i}</a></p>' for i in range(6))
    page = f'<body><article><p>{LONG}</p><p>{LONG}</p><div class="share">{links}<p>A note on how to send this page to friends.</p>{links}</div><p>{LONG}</p></article></body>'
    assert main_text(page) == " ".join([LONG] * 3)
    monkeypatch.setattr(H, "smooth", lambda values: values)
    assert "A note" in main_text(page)


def test_depth_costs_no_square():
    import time

    for depth, began in ((4_000, time.perf_counter()), (30_000, time.perf_counter())):
        named = '<div class="widget">' * depth + f"<p>{LONG}</p>" + "</div>" * depth
        main_text(f"<body>{named}<article><p>{LONG}</p></article></body>")
        deep = "".join(f"<div><p>{LONG[:30]} {i}</p>" for i in range(depth))
        main_text(f"<body>{deep}</body>")
        main_text("<body>" + "<div>" * depth + f"<p>{LONG}</p>" + "</section>" * depth)
        assert time.perf_counter() - began < 15, depth
