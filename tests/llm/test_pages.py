"""Main text of pages: those of the table, made-up ones, and very long ones."""

import html
import re
import time

import pytest

from stackloom.llm import pages, queries

PROSE = "It was in the early part of the year that they were told of the plan, and not all of them were on the side of those who made it. "
MORE = "What is left of the old town is on the other side of the river, and it is not as large as it was for most of the last century. "


def article(page):
    """The text of the table's pages: heading and paragraphs of their article."""
    found = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)
    inner = re.sub(r"<[^>]*$", "", found[1]) if found else ""
    parts = re.split(r"</?(?:p|h1)[^>]*>", inner)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts)
    return "\n".join(t for t in texts if t)


def test_query_extracts_the_articles(spark, sf_dir):
    got = {r.page_id: r for r in queries.op12_pages(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == article(r.html) and got[r.page_id].url == r.url and got[r.page_id].n_chars == len(got[r.page_id].text)


def rich(body, before="", after=""):
    return f"<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body>{before}{body}{after}</body></html>"


@pytest.mark.parametrize(
    "extra",
    [
        "<nav><a href=/>Home</a> <a href=/a>About us</a></nav>",
        f"<header><p>{MORE}</p></header>",
        f"<footer><p>{MORE}</p></footer>",
        f"<aside><p>{MORE}{MORE}</p></aside>",
        f'<div class="cookie-notice"><p>{MORE}</p><button>Accept</button></div>',
        f'<div id="sidebar-right"><p>{MORE}</p></div>',
        f'<div class="adBanner">{MORE}</div>',
        f'<section id="comments"><h2>2 comments</h2><div class="comment"><p>{MORE}{MORE}</p></div></section>',
        f'<form action="/s"><label>Name</label><p>{MORE}</p><textarea><p>{MORE}</p></textarea></form>',
        f"<script>var a = '<p>{MORE}</p>';</script><noscript><p>{MORE}</p></noscript><!-- <p>{MORE}</p> -->",
        "<ul><li><a href=/1>The first of the many stories that they have told</a></li><li><a href=/2>What it was like to be at the side of the river</a></li></ul>",
        f'<div style="display: none">{MORE}</div><p hidden>{MORE}</p>',
        f'<div role="dialog">{MORE}</div><dialog>{MORE}</dialog>',
        "<p>&copy; 2024 The Daily. All rights of the owner are reserved.</p>",
    ],
)
def test_what_is_not_main_text(extra):
    want = f"A title\n{PROSE.strip()}\n{MORE.strip()}\nShort end."
    for body in ("<article><h1>A title</h1><p>{}</p><p>{}</p><p>Short end.</p></article>", "<div><h1>A title</h1><p>{}</p><p>{}</p><p>Short end.</p></div>", "<main class=with-sidebar><div><header><h1>A title</h1></header><div>{}</div><div>{}</div><p>Short end.</div></main>"):
        inner = body.format(PROSE, MORE)
        assert pages.main_text(rich(inner, before=extra)) == want
        assert pages.main_text(rich(inner, after=extra)) == want


def test_markup_references_and_white_space():
    page = "<p>one&nbsp;&amp;amp; <b>t</b>wo\n\t three&#8217;s <a href='x>y'>fo</a>ur &lt;p&gt; 5 < 6 &unknown; " + PROSE + "</p>"
    assert pages.main_text(page) == "one &amp; two three’s four <p> 5 < 6 &unknown; " + PROSE.strip()
    assert pages.main_text(f"<p>{PROSE}<br>{MORE}<p>{PROSE}<br><br>{MORE}") == f"{PROSE}{MORE}\n{PROSE}\n{MORE}".replace(". \n", ".\n").strip()


def test_scripts_without_spaces_and_short_pages():
    text = "他说在那里的人是不知道的，因为这是我们的事情，也不是他们的。" * 6
    assert pages.main_text(f"<nav><a href=/>首页</a></nav><p>{text}</p>") == text
    assert pages.main_text("<article><h1>Only a title</h1><p>Few words</p></article>") == "Only a title\nFew words"
    assert pages.main_text("<p>Few words</p>") == "" and pages.main_text("") == "" and pages.main_text(None) == ""


def test_open_menu_doesnt_hold_the_page():
    assert pages.main_text(f"<nav><ul><li><a href=/>Home</a><article><h1>Title</h1><p>{PROSE}</p></article>") == f"Title\n{PROSE.strip()}"


def test_second_pass_follows_the_nearest_neighbour():
    labels = ["main", "open", "open", "open", "open", "rest", "open", "main"]
    found = [pages.Block("x", 0, "p", False, -1, label) for label in labels]
    pages.second_pass(found)
    assert [b.label for b in found] == ["main", "main", "main", "rest", "rest", "rest", "main", "main"]
    heading = [pages.Block("x", 0, tag, False, -1, label) for tag, label in (("p", "main"), ("h2", "open"), ("p", "rest"))]
    pages.second_pass(heading)
    assert heading[1].label == "rest"


@pytest.mark.parametrize(
    "page",
    ["<" * 10**6, "<a " * 333_333, "&" * 10**6, "&am" * 333_333, "<!--" * 250_000, "<b>" * 333_333, "<div>" * 200_000 + "x", '<a x=">" ' * 100_000, "</p>" * 250_000, "<nav>" * 100_000 + "<h1>x</h1>" * 50_000, "<script" * 140_000, "<p>x<br><br>" * 80_000, f"<div class='{'a-' * 500_000}'>x"],
    ids=range(13),
)
def test_a_million_characters_of_anything(page):
    at = time.monotonic()
    pages.main_text(page)
    assert time.monotonic() - at < 30


def test_odd_rows(spark):
    long = PROSE * 40_000
    rows = [(1, "u", None), (1, "u", ""), (None, None, f"<p>{PROSE}</p>"), (2, "v", f"<p>{long}</p>"), (2, "v", f"<p>{long}</p>")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in pages.extract(df).collect()), key=repr)
    want = [(1, "u", "", 0)] * 2 + [(0, None, PROSE.strip(), len(PROSE) - 1)] + [(2, "v", long.strip(), len(long) - 1)] * 2
    assert got == sorted(want, key=repr)
    assert pages.extract(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        pages.extract(df, keep=("page_id", "text"))
