import random
from collections import Counter

import pytest
from edges import none
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadspark.llm import html as h

BODY = "<p>First words of the article stand here.</p><p>And   more\n\twords &amp; signs&nbsp;follow.</p>"
WANT = "First words of the article stand here.\nAnd more words & signs follow."
NAV = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News and more</a></li></ul></nav>"
FOOT = "<footer>&copy; 2024 Some Company, all rights reserved</footer>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body>{NAV}<article>{BODY}</article>{FOOT}</body></html>",
        f"<body>{NAV}<div class='content'>{BODY}</div>{FOOT}",
        f"<body><header><h1>Site name</h1></header>{NAV}<main>{BODY}<aside><p>Read also this and that</p></aside></main><form><label>Your name</label><input></form>{FOOT}",
        f"<body><div class=\"cookie-notice\">We use cookies to make this site better for you</div><div id=main>{BODY}</div><div id='comments'><p>I am a reader and I think so too</p></div>",
        f"<body><div class=ad>Buy this now, it is cheap</div><article>{BODY.replace('</p><p>', '</p><div class=advert><p>Buy more of it today</p></div><p>')}</article><section class='related-posts'><p>Other posts you may like</p></section>",
        f"<BODY><SCRIPT>var a = '<p>not text</p>';</SCRIPT><!-- <p>hidden</p> -->{BODY}<noscript>Turn it on</noscript>",
        f"<article>{BODY}<article class='comment'><p>First!</p></article></article>",
        f"<article><p hidden>Not shown at all</p>{BODY}<div role=alert>Saved your settings</div></article>",
    ],
)
def test_main_text_of_templates(page):
    assert h.main_text(page, h.weigh({})) == WANT


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{NAV}<div class='content no-sidebar'><article>{BODY}</article></div>{FOOT}",
        f"<body>{NAV}<div id='page' class='has-header'>{BODY}</div>{FOOT}",
        f"<body>{NAV}<div class='site widget-ready'><article>{BODY}</article></div>{FOOT}",
        f"<body>{NAV}<div class='sidebar-left social'>{BODY}</div>{FOOT}",
        f"<body>{NAV}<div class='hfeed has-sidebar'><article>{BODY}</article></div>{FOOT}",
        f"<body>{NAV}<div class='post no-comments'>{BODY}</div>{FOOT}",
        f"<body>{NAV}<div class='legal-news'>{BODY}</div>{FOOT}",
        f"<body><form id='aspnetForm' method=post>{NAV}<div id=main>{BODY}</div><input type=hidden></form>{FOOT}",
        f"<body>{NAV}<div class='menu'><article>{BODY}</article><div class='related-posts'>Other posts</div></div><div class=comments>{'I think so too. ' * 20}</div>{FOOT}",
    ],
)
def test_class_words_do_not_drop_what_holds_the_main_text(page):
    assert h.main_text(page, h.weigh({})) == WANT


def test_headers_and_warnings_of_the_text_stay():
    w = h.weigh({})
    page = f"<body>{NAV}<article><div class='entry-header'><h1>The title</h1></div>{BODY}<div class='warning'><p>Mind this.</p></div><div class='share'>Tell your friends</div></article>{FOOT}"
    assert h.main_text(page, w) == f"The title\n{WANT}\nMind this."
    assert h.main_text(page.replace("article>", "div>"), w).startswith(f"The title\n{WANT}")
    inner = f"<body><div class='header'>Site name</div><div>{BODY}<p class='notice'>Mind this.</p>{BODY}</div><div class='legal'>All rights are reserved here</div>"
    assert h.main_text(inner, w) == f"{WANT}\nMind this.\n{WANT}"


def test_markup_within_words_and_broken_markup():
    w = h.weigh({})
    assert h.main_text("<article><h1>Ti<b>t</b>le</h1><p>one<br>two <i>three</i><p>four &lt;b&gt; &#233; &bogus; a < b</article>", w) == "Title\none two three\nfour <b> é &bogus; a < b"
    assert h.main_text("just text, no markup", w) == "just text, no markup"
    assert h.main_text("<p>open <a href='x>y'>link</a> text <b unclosed", w) == "open link text <b unclosed"
    assert h.main_text("<p>" + "<" * 5000 + "x", w).endswith("x") and h.main_text("<a href=\"" * 2000, w) is not None
    assert h.main_text("", w) == "" and h.main_text("<nav>Menu</nav>", w) == ""


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=14))
def test_best_region_equals_all_regions(scores):
    """Of regions of the largest sum the one that ends first, of these the shortest."""
    every = [(sum(scores[i:j]), -j, i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    total, end, start = max(every, default=(0, 0, 0))
    assert h.best_region(scores) == ((start, -end) if total > 0 else (0, 0))


def token_f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    common = sum((a & b).values())
    return 2 * common / max(1, sum(a.values()) + sum(b.values()))


def labelled_page(r):
    """A page, and its main text, of one of several layouts with boilerplate of all kinds around it."""
    words = lambda a, b: " ".join(r.choice("the of river stone and light a house over time we found it long after rain".split()) for _ in range(r.randint(a, b)))
    paragraphs = [words(8, 40) for _ in range(r.randint(2, 7))]
    title = words(3, 7)
    body = f"<h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in paragraphs)
    nav = "<nav><ul>" + "".join(f"<li><a href=/{i}>{words(1, 2)}</a></li>" for i in range(r.randint(3, 9))) + "</ul></nav>"
    side = f"<div class=sidebar><h3>{words(1, 2)}</h3><ul>" + "".join(f"<li><a href=/s{i}>{words(2, 4)}</a></li>" for i in range(r.randint(2, 6))) + "</ul></div>"
    comments = "<div id=comments>" + "".join(f"<div class=comment><p>{words(5, 15)}</p></div>" for _ in range(r.randint(0, 3))) + "</div>"
    notice = f"<div class='cookie-consent'>{words(6, 12)}<button>OK</button></div>"
    form = f"<form action=/search><label>{words(1, 2)}</label><input></form>"
    open_, close = r.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post'>", "</div>"), ("<div class='content no-sidebar'>", "</div>"), ("<div id=page class='has-header'><section>", "</section></div>"), ("<form id=aspnetForm><div>", "</div></form>"), ("<td>", "</td>")])
    return f"<html><body>{notice}{nav}{form}{open_}{body}{close}{side}{comments}<footer>{words(4, 9)}</footer></body></html>", "\n".join([title, *paragraphs])


def test_token_f1_of_labelled_pages():
    r = random.Random(11)
    scores = [token_f1(h.main_text(page, h.weigh({})), want) for page, want in (labelled_page(r) for _ in range(200))]
    assert sum(scores) / len(scores) >= 0.97 and min(scores) >= 0.8


def test_long_labelled_pages_count(spark):
    long = "<body><div>aa</div><article>" + "<p>word word</p>" * 20_000 + "</article></body>"
    df = spark.createDataFrame([(1, long)], "page_id long, html string")
    assert h.label_counts(df)["w", "p", "in"] == (40_000, 0)


def test_weights_of_labelled_pages_work_without_the_label(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    w = h.weigh(h.label_counts(pages))
    assert w["w", "p", ""] > 0 > w["t", "body", ""]
    for r in pages.limit(60).collect():
        bare = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert h.main_text(bare, w) == h.main_text(r.html, w)


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (None, "x", "<p>a b c</p>"), (3, "v", "<p>" + "word " * 60_000 + "</p>"), (4, "v", " \n ")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("text", "n_chars", "_raw", "_id")})
    got = h.extract(df)
    assert sorted(((r.page_id or 0, r.n_chars) for r in got.collect())) == [(0, 5), (1, 0), (2, 0), (2, 0), (3, 299_999), (4, 0)]
    assert set(got.columns) == {"page_id", "url", "text", "n_chars", "_raw", "_id"}
    assert h.extract(none(df)).count() == 0
