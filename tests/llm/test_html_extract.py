import html
import os
import re

import pytest
from pyspark.sql import types as T

from trackspark.llm.html_extract import extract, main_text

PROSE = "It was the first time that they had seen the river from the hill, and it was as wide as a lake in the light of the evening. "
PAGE = f"""<!doctype html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="</head><p>no</p>";</script></head><body class="nav-open">
<header><h1>Site name</h1><p>{PROSE}</p></header><nav><ul><li><a href="/a">Home<li><a href="/b">News</ul></nav>
<div class="cookie-notice">{PROSE * 3}</div><article class="no-comments"><h1>The  title&nbsp;here</h1><p>{PROSE * 2}<p>Short one.<br>next &lt;line&gt;
<p><b>{PROSE}<i>crossed</b></i></p><!-- {PROSE} --><aside>{PROSE * 2}</aside><ul><li><a href=x>Read this too</a></ul><form><p>{PROSE}</p></form>
<section id="comments"><p>{PROSE * 2}</p></section><p>{PROSE}</p></article><div class=sidebar>{PROSE}</div><footer>&copy; {PROSE}</footer>"""
P = PROSE.strip()


def test_article():
    assert main_text(PAGE) == "\n\n".join(["The title here", f"{P} {P}", "Short one. next <line>", f"{P} crossed", P])


def test_rules_without_a_main_element():
    page = f"<body><div><a href=a>Home</a> <a href=b>News</a></div><h2>Heading</h2><p>{PROSE * 2}</p><p>Short, between.</p><p>{PROSE * 3}</p><div>Short at the end</div><div><a>x y z</a></div><p>© 2020 them"
    assert main_text(page) == "\n\n".join(["Heading", f"{P} {P}", "Short, between.", f"{P} {P} {P}"])


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>never closed", "plain"])
def test_odd_pages(page):
    assert main_text(page) in ("", "<", "<p", "plain")


def test_main_without_decided_blocks():
    assert main_text("<nav><a>m</a></nav><article><p>x | y</p><p>zz</p></article>") == "x | y\n\nzz"


def test_query(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType())])
    long = f"<article>{'<p>' + PROSE}" * 5000
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, None), (None, None, None, None), (2, None, "", None), (3, "v", long, None)]
    got = extract(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert next(r for r in got if r.page_id == 3).text == "\n\n".join([P] * 5000)
    assert extract(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables")
def test_driver_pages(spark):
    """On pages whose article element is well marked, the text is that of the element."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in pages:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<p>|</p>|<h1>|</h1>", inner)]
        assert main_text(r.html) == "\n\n".join(filter(None, parts)), r.page_id


KEYWORDS = " ".join(f"Keyword{k}" for k in range(60))


def test_no_text_of_the_article_is_dropped_for_want_of_stop_words():
    code = "for (i = 0; i < n; i++) { total[i] = x[i] * y[i]; } " * 16
    japanese = "これは川を初めて見た日の話である。" * 24
    page = f"<article><p>{PROSE * 2}</p><pre>{html.escape(code)}</pre><p>{japanese}</p><p>{KEYWORDS}</p><p><math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><textarea>a &lt; b</textarea><p>{PROSE * 2}</p></article>"
    assert main_text(page).split("\n\n") == [f"{P} {P}", code.strip(), japanese, KEYWORDS, "x=2", "a < b", f"{P} {P}"]
    # without a main element, stop words decide, where the page is in a language that has them
    page = page.replace("article>", "div>")
    assert japanese not in main_text(page) and KEYWORDS not in main_text(page) and main_text(page).count(P) == 4
    assert main_text(f"<article><p>{KEYWORDS}</p><p>{KEYWORDS}</p></article>") == f"{KEYWORDS}\n\n{KEYWORDS}"


BODY = f"<nav><a href=x>Home</a></nav><div class=sidebar>{PROSE}</div><article><h1>Title</h1><p>{PROSE * 3}</p></article><section id=comments><article><p>{PROSE}</p></article></section>"


@pytest.mark.parametrize("wrap", ['<div id="page" class="site has-sidebar">{}</div>', "<form>{}</form>", '<form id="aspnetForm" class="search">{}</form>', '<div class="modal"><div class="widget">{}</div></div>', '<div class="sidebar-wrapper">{}</div>', "<dialog>{}</dialog>"])
def test_marked_elements_around_the_page_are_the_page(wrap):
    want = f"Title\n\n{P} {P} {P}"
    assert main_text("<body>" + wrap.format(BODY)) == want
    assert main_text("<body>" + wrap.format(BODY.replace("article>", "div>").replace("<section id=comments><div>", "<section id=comments><div class=comment>"))) == want


@pytest.mark.parametrize(("name", "stays"), [("legal-analysis", True), ("legal", False), ("legal-box", False), ("search-theory", True), ("no-comments", True), ("comments-closed", False), ("notice", False), ("with-ads", True), ("has-header", True), ("share-bar", False), ("header", True)])
def test_names_within_the_article(name, stays):
    part = "The part in question was as long as it is said to be, and it was about the matter of the page, so that all of it is here."
    got = main_text(f'<article><p>{PROSE * 2}</p><section class="{name}"><p>{part}</p></section><p>{PROSE}</p></article>')
    assert (part in got) == stays


def test_comments_longer_than_the_article_go():
    page = f"<body><div class=page><article><h1>T</h1><p>{PROSE}</p></article><div class=comments>{f'<article class=comment><p>{PROSE * 2}</p></article>' * 9}</div></div>"
    assert main_text(page) == f"T\n\n{P}"


@pytest.mark.parametrize("rule", ["STOP_WORDS", "LINKS", "SHORT", "LONG"])
def test_each_rule_decides_on_pages_without_tags(monkeypatch, rule):
    parts = [PROSE * 2, KEYWORDS, f'<a href=x>{"one two three " * 5}</a> and of the way it was to us in the end of it', PROSE * 2, "Short words", PROSE * 2, "The lines that it has are of the sort for a note to be of some use in it"]
    page = "<body>" + "".join(f"<div>{x}</div>" for x in parts)
    before = main_text(page)
    assert KEYWORDS not in before and "one two" not in before and "Short words" in before
    monkeypatch.setattr(f"trackspark.llm.html_extract.{rule}", {"STOP_WORDS": frozenset(), "LINKS": 2.0, "SHORT": 5, "LONG": 10_000}[rule])
    assert main_text(page) != before


def test_rules_of_both_passes():
    """Label by label, from the rules: links, length and stop words first, then the nearest decided neighbours."""
    text = {"good": PROSE * 2, "bad": KEYWORDS, "brief": "Some words here", "near": "Word " * 12 + "the and of"}
    link = "<div><a>Many words within one link of a page</a></div>"
    # blocks that stay, by rule: a brief block between unlike neighbours goes, a near one stays
    cases = {"good brief good": 3, "good brief bad good": 2, "good bad brief good": 2, "good bad near good": 3, "good bad brief bad good": 2, "good link brief good": 2, "good near bad brief": 2, "brief good": 2}
    for order, want in cases.items():
        parts = [link if k == "link" else f"<div>{text[k]}</div>" for k in order.split()]
        assert len(main_text("<body>" + "".join(parts)).split("\n\n")) == want, order


@pytest.mark.parametrize("part", ['<a "x', "<a 'x>", '<a b="', "<b>", "<i><div>", '<a ">" ', "</i>", "<!-- ", "<script>", "&amp", "<a b = = ", "<p><b>", "<li>", "<" , "<a\n", "<head>", "<head><script>", "<body>", "<title>", "<textarea>", "<div class=ad>", "<form><p>", "<main>", "<article class=comment>"])
def test_time_is_linear(part):
    import time

    now = time.time()
    main_text("<article>" + part * 60_000)
    assert time.time() - now < 8


def test_quotes():
    assert main_text('<article><p title="a > b" data-x=\'"\'>One</p><p "x>Two</p><p title=">Three</p><p>Four</p></article>') == "One\n\nTwo\n\nThree\n\nFour"
