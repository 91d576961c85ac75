"""What is the story of a page: comments never are, templates decide, marks count by their names."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.llm import html

URL = "https://a.org/x"

PAGES = [
    ('<div class="post"><p>Story</p></div><div class="comments"><article><p>reader one</p></article></div>', "Story"),
    ('<div class="story"><p>The story</p></div><article class="comment"><p>no</p></article>', "The story"),
    ('<article class="comment"><p>only a comment</p></article>', ""),
    ('<div class="overlay"><article><p>Real</p></article></div>', "Real"),
    ('<main><article><p>One and more words</p></article><div class="x-share-row">share</div><article class="reply"><p>No</p></article></main>', "One and more words"),
    ('<div class="advert-box">Buy</div><div class="google-ads">ads</div><div id="cookie-bar">eat</div><div class="site-nav-wrapper">Home</div><div class="has-sidebar"><p>The long story goes on</p></div>', "The long story goes on"),
    ('<div class="page-nav-layout"><p>All of the story is in this one.</p></div>', "All of the story is in this one."),
    ('<article><div class="ad-hoc-figures"><p>Content of an article</p></div></article>', "Content of an article"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_story(page, want):
    assert html.extract(URL, page, frozenset()) == want


def test_templates_decide_within_articles(spark):
    """A line that most pages of a host have goes; a paragraph that few share, or that is the story itself, stays."""
    page = "<html><body><article><h1>Title {0}</h1><p>Own words number {0} go on and on here.</p>{1}<p>Subscribe to our newsletter today.</p></article></body></html>"
    shared = "<p>A passage that eight of the pages quote.</p>"
    rows = [(i, f"{URL}{i}", page.format(i, shared if i < 8 else "")) for i in range(30)]
    copies = "<article><p>The same article on every page of its host.</p></article>"
    rows += [(100 + i, f"https://b.org/{i}", copies) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (200_000, 0):
        got = {r.page_id: r.text for r in html.main_text(df, most=most).collect()}
        assert got[3] == "Title 3\n\nOwn words number 3 go on and on here.\n\nA passage that eight of the pages quote."
        assert got[20] == "Title 20\n\nOwn words number 20 go on and on here."
        assert got[105] == "The same article on every page of its host."
    without = {r.page_id: r.text for r in html.main_text(df, many=10**6).collect()}
    assert without[20].endswith("Subscribe to our newsletter today.")


def test_templates_are_counted_by_host(spark):
    block = "<div><p>Opening hours: nine to five.</p></div>"
    rows = [(i, f"https://h{i % 3}.org/{i}", f"<body>{block if i % 3 else ''}<div><p>Text {i}</p></div></body>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html.templates(html.keyed(df))
    counts = Counter(r.site for r in found.where(F.col("prose")).collect())
    assert set(counts) == {"h1.org", "h2.org"}
    assert {r.text for r in html.main_text(df).collect()} == {f"Text {i}" for i in range(60)}
