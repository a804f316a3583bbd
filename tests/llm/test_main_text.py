from __future__ import annotations

import html as markup
import re
import time

import numpy as np
import pytest
from stratacart.llm import main_text as m

LONG = "This is a long paragraph of the article, with quite some words in it, so that it counts. "
BODY = (
    f"<p>{LONG}</p><p>Short.</p><p>{LONG}</p><ul><li>one</li><li>two</li></ul>"
    "<p>End&nbsp;of  it &amp;\n more</p>"
)
ARTICLE = f"<h1>Title</h1>{BODY}"
TEXT = "\n".join(["Title", LONG.strip(), "Short.", LONG.strip(), "one", "two", "End of it & more"])
NAV = "<nav><a href='/'>Home</a> <a href='/b'>B</a></nav>"

PAGES = {
    "article": f"<body>{NAV}<article>{ARTICLE}</article><footer>c</footer></body>",
    "names": (
        f"<div class='topNav'><a>Home</a></div><div id='content'>{ARTICLE}</div>"
        f"<div class='side-bar'><p>{LONG}</p></div><div id='comments'><p>{LONG}</p></div>"
    ),
    "no names": (
        "<div><a href=x>Menu one</a> <a href=y>Menu two</a></div>"
        f"<div>{ARTICLE}</div><div><a>Legal</a> <a>Imprint</a></div>"
    ),
    "header of the article": f"<article><header><h1>Title</h1><p>By X</p></header>{BODY}</article>",
    "main": f"<main><article>{ARTICLE}</article><aside><p>{LONG * 3}</p></aside></main>",
    "form around": f"<form id=f>{NAV}<article>{ARTICLE}</article></form>",
    "comments": (
        f"<article>{ARTICLE}<section class='comments'><article class='comment'>"
        f"<p>{LONG * 4}</p></article></section></article>"
    ),
    "notice": f"<div class='cookie-notice'><p>{LONG}</p></div><article>{ARTICLE}</article>",
    "only a body": f"<body>{ARTICLE}</body>",
    "name of what is elsewhere": f"<div class='page has-sidebar'><div>{ARTICLE}</div></div>",
    "title outside": f"<body><h1>Title</h1><div class=content>{BODY}</div></body>",
    "broken": f"<![if IE]><article>{ARTICLE}</div></span><![endif]><!-- x <p>zz",
    "open menu": f"<nav><ul><li><a>x</a><article>{ARTICLE}</article>",
    "scripts": (
        f"<article><script>a='<p>no</p>';</script><style>p{{}}</style>{ARTICLE}"
        "<noscript>n</noscript><template><p>t</p></template></article>"
    ),
    "advert inside": f"<article>{ARTICLE.replace('Short', '<span class=ad>Buy</span>Short')}</article>",
    "related": (
        f"<article>{ARTICLE}</article><div class='related-posts'><article class='card'>"
        f"<h3><a>rel</a></h3><p>{LONG}</p></article></div>"
    ),
    "open paragraphs": f"<article>{ARTICLE.replace('</p>', '<br>')}</article>",
    "hidden": f"<article>{ARTICLE}<p hidden>no</p><p style='display: none'>no</p></article>",
}


@pytest.mark.parametrize("name", PAGES)
def test_the_article_and_nothing_else(name):
    assert m.main_text(PAGES[name]) == TEXT


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<p", ""), ("<!--", ""), ("text", "text"), ("<p>a<p>b", "a\nb"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<nav>x</nav>", ""),
        ("<article><p>a &lt;b&gt; <b>c</b>d</article>", "a <b> cd"), ("<p>a<br>b</p>", "a b"),
        ("<article><h1>Title</h1><p>Tiny.</p></article><footer>Long text here</footer>", "Title\nTiny."),
    ],
)
def test_odd_pages(html, text):
    assert m.main_text(html) == text


def test_long_pages_are_read_whole():
    words = [f"w{i}" for i in range(200_000)]
    assert m.main_text(f"<article><p>{' '.join(words)}</p></article>") == " ".join(words)
    many = "".join(f"<p>paragraph {i}</p>" for i in range(5_000))
    assert m.main_text(f"<article>{many}</article>").count("\n") == 4_999


@pytest.mark.parametrize(
    "html",
    ["<div>x" * 30_000, "<b>x" * 30_000, "<b>" * 30_000 + "x</i>" * 30_000, "<p><a>x" * 30_000,
     "<li><b>x" * 30_000, "<table><tr><td>x" * 10_000, "<!-- x" * 30_000, "<p x" * 30_000],
)
def test_the_work_does_not_grow_with_the_depth(html):
    start = time.process_time()
    m.main_text(html)
    assert time.process_time() - start < 10


def test_smoothing_keeps_the_mean_of_equal_ratios():
    assert np.allclose(m.smoothed(np.full(9, 3.0)), 3.0)
    one = m.smoothed(np.array([0.0, 0, 0, 10, 0, 0, 0]))
    assert one.argmax() == 3 and one[0] == 0 and 0 < one[1] < one[2] < one[3]


def test_short_lines_beside_long_ones_are_content():
    page = m.Lines()
    page.feed(f"<div><a>x</a></div><div><a>y</a></div><div><a>z</a></div>{ARTICLE}")
    page.close()
    chosen = m.content(page.page.lines)
    by_text = dict(zip((x.text for x in page.page.lines), chosen, strict=True))
    assert by_text["Short."] and not by_text["x"] and not by_text["y"]


def expected(html: str) -> str:
    """The article of the test pages, by their one template."""
    inside = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    lines = re.split(r"</?p>|</?h1>", inside)
    plain = [re.sub(r"</?b>", "", x).replace("<br>", " ") for x in lines]
    shown = [" ".join(markup.unescape(x).split()) for x in plain]
    return "\n".join(x for x in shown if x)


def test_table(spark):
    rows = [
        (1, "u", PAGES["article"], 7), (1, "u", PAGES["article"], 7), (None, None, None, None),
        (2, "v", "", 1),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = m.extract(table)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in found.collect())
    once = (1, "u", TEXT, len(TEXT))
    assert got == [(0, None, "", 0), once, once, (2, "v", "", 0)]
    assert m.extract(table.limit(0)).count() == 0
