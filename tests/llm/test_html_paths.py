import re
from html import unescape

import pytest
from gradeframe.llm import html_paths as H

import __spark_entry__ as entry

ARTICLE = "<article><h1>Head</h1><p>First &amp; foremost,\n text.<p>Second <a href=x>link</a> text.</p></article>"
MAIN = "Head\n\nFirst & foremost, text.\n\nSecond link text."
AROUND = [
    "<nav><ul><li><a href=/>Home</a></ul></nav>",
    "<header><p>Site name</p></header>",
    "<footer>&copy; all, of us.</footer>",
    "<aside><p>Read this, too.</p></aside>",
    '<div class="ad">Buy, now.</div>',
    '<div id="cookie-notice"><p>We use cookies, you know.</p></div>',
    '<div class="sidebar"><p>Other, things.</p></div>',
    "<form><p>Your mail, please.</p><input><button>Go</button></form>",
    '<section class="comments"><article><p>I am a reader, hello.</p></article></section>',
    '<div id="commentList"><p>Nice, thanks.</p></div>',
    "<script>if (a < b) document.write('<p>text</p>')</script>",
    "<style>p > b { margin: 0 }</style>",
    "<!-- <p>not here</p> -->",
    "<noscript><p>Switch it on.</p></noscript>",
    "<div hidden><p>Unseen.</p></div>",
]


@pytest.mark.parametrize("part", AROUND)
@pytest.mark.parametrize("before", [True, False])
def test_parts_beside_the_article_go(part, before):
    body = part + ARTICLE if before else ARTICLE + part
    assert H.main_text(f"<!doctype html><html><head><title>T</title></head><body>{body}</body></html>") == MAIN


@pytest.mark.parametrize("part", [p for p in AROUND if "<article>" not in p and "<header>" not in p])
def test_parts_within_the_article_go(part):
    assert H.main_text(f"<body>{ARTICLE.replace('<p>Second', part + '<p>Second')}") == MAIN


def test_ratios_find_text_without_an_article_tag():
    text = "<p>A long paragraph, with words and marks. It goes on for a while, as texts do.</p>" * 3
    links = "<ul>" + "<li><a href=x>Link</a></li>" * 8 + "</ul>"
    page = f"<body><div class=wrap><div>{links}</div><div><h2>Heading</h2>{text}</div><div><span>v 1</span></div></div>"
    found = H.main_text(page).split("\n\n")
    assert found == ["Heading"] + ["A long paragraph, with words and marks. It goes on for a while, as texts do."] * 3


def test_article_of_given_pages(spark, data):
    """Pages of the table, read by cutting the article out of the source."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    found = entry.queries()["op7_html_paths"](spark, data).collect()
    assert len(found) == len(html)
    for r in found:
        article = re.search(r"<article>(.*?)(</article>|$)", html[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<", "<"),
        ("a < b", "a < b"),
        ("<p", ""),
        ("<p>x</p", "x"),
        ("<script>never closed <p>x", ""),
        ("<!-- never closed <p>x", ""),
        ("</p></div>x", "x"),
        ("plain text, only.", "plain text, only."),
        ("<p>&#233;&#x4e2d;&lt;b&gt;&nbsp;x", "é中<b> x"),
        ('<article><p title="a>b">x</p></article>', "x"),
        ("<article></article><p>y</p>", "y"),
        ("<ARTICLE><P>x<BR>y</P></ARTICLE>", "x y"),
    ],
)
def test_odd_sources(html, text):
    assert H.main_text(html) == text


def test_edge_rows(spark):
    rows = [(1, None, None), (None, "u", ARTICLE), (None, "u", ARTICLE), (2, "v", "<article>" + "<p>x y" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    found = H.extract(pages).collect()
    assert sorted((r.n_chars for r in found)) == sorted([0, len(MAIN), len(MAIN), 50_000 * 5 - 2])
    assert H.extract(pages.limit(0)).count() == 0


STORY = "A long paragraph of the story, with words and marks. It goes on for a while, as texts do."
CARD = "<article><p>Short teaser.</p></article>"


@pytest.mark.parametrize("before", [True, False])
def test_a_teaser_article_does_not_hide_a_story_in_divs(before):
    story = f"<div><div>{f'<p>{STORY}</p>' * 3}</div></div>"
    page = f"<body>{CARD + story if before else story + CARD}</body>"
    assert H.main_text(page) == "\n\n".join([STORY] * 3)


@pytest.mark.parametrize("tag", ["aside", "nav", "footer", "div class=sidebar", "section id=related"])
def test_noise_around_an_article_counts(tag):
    card = f"<{tag}><article><p>{STORY} Read more of it.</p></article></{tag.split()[0]}>"
    assert H.main_text(f"<body>{card}<div><p>{STORY}</p><p>{STORY}</p></div>{card}</body>") == f"{STORY}\n\n{STORY}"


def test_a_frame_named_by_a_side_keeps_its_article():
    assert H.main_text(f"<body><div class=with-sidebar>{ARTICLE}<div class=sidebar>x, y.</div></div></body>") == MAIN


def test_ratios_decide_within_an_article():
    page = f"<article><div><p>{STORY}</p><p>{STORY}</p></div><div><span>v 1</span></div></article>"
    assert H.main_text(page) == f"{STORY}\n\n{STORY}"


WHOLE = f"<h1>Soup</h1><p>{STORY}</p><p>{STORY}</p>"


@pytest.mark.parametrize(
    "part, text",
    [
        ("<ul><li>salt</li><li>oil</li><li>two eggs</li></ul>", ["salt", "oil", "two eggs"]),
        ("<table><tr><th>Part</th><td>7</td></tr><tr><td>x</td><td>8 g</td></tr></table>", ["Part", "7", "x", "8 g"]),
        ("<figure><img src=a><figcaption>A pot</figcaption></figure>", ["A pot"]),
        ("<blockquote><p>Yes.</p></blockquote>", ["Yes."]),
        ("<h2><a href=x>How to cook it</a></h2>", ["How to cook it"]),
        ("<dl><dt>Time</dt><dd>1 h</dd></dl>", ["Time", "1 h"]),
        ("<pre>a  b</pre>", ["a b"]),
    ],
)
@pytest.mark.parametrize("frame", ["article", "div", "main"])
@pytest.mark.parametrize("place", ["before", "between", "after"])
def test_short_parts_of_the_article_stay(part, text, frame, place):
    story = [f"<p>{STORY}</p>"] * 2
    at = ("before", "between", "after").index(place)
    story.insert(at, part)
    want = [STORY] * at + text + [STORY] * (2 - at)
    body = f"<body><div class=site-nav>a, b.</div><{frame}><h1>Soup</h1>{''.join(story)}</{frame}><div class='page-footer'>c, d.</div>"
    assert H.main_text(body).split("\n\n") == ["Soup", *want]


@pytest.mark.parametrize(
    "frame", ['class="page has-sidebar no-header"', 'id="search-results-page"', 'class="with-ads"', 'class="newsletter-archive-page"', 'id="search"', 'class="widget"']
)
def test_names_of_the_page_hide_nothing(frame):
    assert H.main_text(f"<body><div {frame}>{WHOLE}</div></body>") == f"Soup\n\n{STORY}\n\n{STORY}"


@pytest.mark.parametrize(
    "name", ["site-header", "left_sidebar", "adSlot", "ad-slot-3", "cookie-notice", "footer-links", "related", "topNav", "shareBar", "nav wide"]
)
def test_names_of_parts_hide_them(name):
    for holder in ("article", "div"):
        page = f"<body><{holder}>{WHOLE}<div class='{name}'><p>Other, things. And more, of them.</p></div></{holder}></body>"
        assert H.main_text(page) == f"Soup\n\n{STORY}\n\n{STORY}"


def test_a_long_side_does_not_replace_an_article():
    side = f"<div class=sidebar>{f'<p>{STORY}</p>' * 9}</div>"
    assert H.main_text(f"<body><article>{WHOLE}</article>{side}</body>") == f"Soup\n\n{STORY}\n\n{STORY}"


def test_lists_of_links_go():
    links = "<ul><li><a href=x>One other page</a></li><li><a href=y>Another page</a></li></ul>"
    assert H.main_text(f"<body><article>{WHOLE}{links}</article>{links}</body>") == f"Soup\n\n{STORY}\n\n{STORY}"
