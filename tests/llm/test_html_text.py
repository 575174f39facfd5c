"""Pages: the cut against brute force, whole pages against what they say."""

import html
import itertools
import random
import re

import pytest

from itemnorm.llm.html_text import extract, main_text, source_side


def test_minimum_cut_by_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 8)
        strength = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(0, 6)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(side):
            own = sum(c for i, c in enumerate(strength) if c > 0 and not side[i]) - sum(c for i, c in enumerate(strength) if c < 0 and side[i])
            return own + sum(c for i, j, c in edges if side[i] != side[j])

        assert cost(source_side(n, strength, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_articles_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", re.sub("</?b>", "", article)))
        assert got[r.page_id] == "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


BODY = "<h1>Title of it</h1><p>A long paragraph of text that goes on and on. It ends here.</p><p>Short.</p>"
TEXT = "Title of it\n\nA long paragraph of text that goes on and on. It ends here.\n\nShort."


@pytest.mark.parametrize("extra", [
    "<div class='cookie-notice'><p>We use cookies on this site, please accept all of them now.</p></div>",
    "<aside><p>Something that stands beside the text, with a full sentence.</p></aside>",
    "<div id=sidebar><ul><li><a href=x>One link</a></li><li><a href=y>Another link</a></li></ul></div>",
    "<form><p>Sign up for our mails, it takes a minute only.</p><button>Go</button></form>",
    "<section class='comments'><p>A reader says something long about this, in many words. Yes.</p></section>",
    "<script>var a = '<p>no text of the page</p>';</script><style>p{}</style><!-- <p>hidden</p> -->",
    "<header><p>The name of the site and its motto stand here.</p></header>",
])
def test_what_goes(extra):
    for page in (f"<body>{extra}<article>{BODY}</article></body>", f"<body><main>{BODY}</main>{extra}</body>"):
        assert extract(page) == TEXT


def test_odd_pages(spark):
    assert [extract(x) for x in (None, "", "<p", "<!-- x", "<script>a", "   ")] == [""] * 6
    assert extract("<article><p>x &amp;lt; y&nbsp;z<br>w &#233; and more words here.</article>") == "x &lt; y z w é and more words here."
    deep = "<div>" * 3000 + "<p>Some words that stand deep down in the page.</p>"
    assert extract(deep).startswith("Some words")
    rows = [(1, None, "u"), (1, f"<article>{BODY}" + "<p>And more of it, a sentence.</p>" * 3000, "v"), (None, "", "w")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = main_text(df).collect()
    assert sorted(len(r.text) for r in got) == [0, 0, len(TEXT) + 3000 * 29]
    assert main_text(df.limit(0)).count() == 0


def test_names_of_frames_do_not_lose_the_article():
    text = "This is the article of the page, and it has words enough to be one. " * 3
    for before, after in (
        ("<body class='single-post has-sidebar'><article>", "</article></body>"), ("<body class='with-comments'><main>", "</main></body>"),
        ("<div class='no-banner'><article>", "</article></div>"), ("<form id='aspnetForm'><article>", "</article></form>"),
        ("<div id='search-wrapper'><div class='promo'><article class='post'>", "</article></div></div>"),
    ):
        page = f"<html>{before}<p>{text}</p>{after}<aside class='sidebar'><p>Other things that one may read here, many of them.</p></aside></html>"
        assert extract(page) == text.strip(), before
    teaser = "<aside class='related'><article><p>Another article that is only shown beside this one, with words.</p></article></aside>"
    page = f"<div class='with-comments'><article><p>{text}</p></article>{teaser}<div class='comments'><article class='comment'><p>I liked this article very much, thank you.</p></article></div></div>"
    assert extract(page) == text.strip()
