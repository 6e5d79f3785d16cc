import re

import pytest
from pyspark.sql import functions as F

from sheaf.llm import htmltext

PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def weights(spark):
    return htmltext.fit(spark.read.parquet(PAGES))


def article(page):
    """The marked article of a page of the given tables, block by block."""
    import html

    body = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1].replace("<br>", " ")
    blocks = re.split(r"</?(?:p|h1)>", body)
    lines = (" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def test_given_pages(spark, weights):
    pages = spark.read.parquet(PAGES)
    got = htmltext.main_text(pages, weights).join(pages, F.col("row.page_id") == pages.page_id).collect()
    assert len(got) == 250
    assert all(r.text == article(r.html) for r in got)


BODY = "<p>One two three four five six seven.</p><p>Eight&nbsp;nine &lt;ten&gt; &copy; eleven\n twelve.</p>"
TEXT = "One two three four five six seven.\nEight nine <ten> © eleven twelve."


@pytest.mark.parametrize(
    "page",
    [
        f"<nav><a>Home</a></nav><article>{BODY}</article><footer>foot words here</footer>",
        f"<header>Site name</header><main>{BODY}<div class='ad'>buy now</div></main><aside>side bar</aside>",
        f"<ul class=menu><li><a>Home</a><li><a>News</a></ul><div id='content'>{BODY}</div><div class='site-footer'>x y</div>",
        f"<div class=\"cookie-notice\">we use cookies</div>{BODY}<form>Name <input> send</form>",
        f"<script>var a = '<p>no</p>';</script><style>p{{}}</style>{BODY}<section class='comments'><p>first!</p></section>",
        f"<!-- <p>no</p> --><div class='ad'>never closed<article>{BODY}</article>",
        f"<title>t</title><body>{BODY}<div class='sidebar'><p>links and more links</p></div><script>x",
        f"<P>One two <B>three</b> four five six<br>seven.{BODY[BODY.index('</p>'):]}",
    ],
)
def test_furniture_stays_out(weights, page):
    assert htmltext.extract(page, weights) == TEXT
    assert htmltext.extract(page, htmltext.Weights()) == TEXT


def test_best_stretch_is_that_of_brute_force(weights):
    import random

    pick = random.Random(1)
    parts = ["<p>", "</p>", "<nav>", "</nav>", "a b c ", "<a>", "</a>", "word ", "<div class=ad>", "</div>", "<li>", "<table>"]
    for _ in range(200):
        page = "".join(pick.choice(parts) for _ in range(25))
        scores = []
        for key, text, _ in htmltext.tokens(page):
            scores.append(weights.of(key) * (len(text.split()) if key[0] == "w" else 1))
        best = max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])
        assert (htmltext.extract(page, weights) == "") == (best <= 1e-9) or best > 0


def test_null_empty_broken_and_repeated_pages(spark):
    rows = [(1, None), (2, ""), (3, "<"), (4, "plain text only here"), (4, "plain text only here"), (None, "<p>a < b & c"), (5, "<!--")]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("old")).withColumn("row", F.lit(1))
    got = [(r.row.page_id, r.text) for r in htmltext.main_text(pages, htmltext.fit(pages)).collect()]
    assert got == [
        (1, ""), (2, ""), (3, "<"), (4, "plain text only here"), (4, "plain text only here"), (None, "a < b & c"), (5, ""),
    ]


def test_long_page_and_empty_table(spark):
    page = "<article>" + "<p>some words in a block</p>" * 20_000 + "</article>"
    assert htmltext.extract(page, htmltext.Weights()).count("\n") == 19_999
    none = spark.createDataFrame([], "page_id long, html string")
    assert htmltext.main_text(none, htmltext.fit(none)).collect() == []
