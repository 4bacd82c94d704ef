import html
import random
import re

import numpy as np
import pytest

from absentia.llm import html_text
from absentia.llm.boosting import Boosted, boost
from absentia.llm.queries import QUERIES


def article_text(page):
    """The article of a page of the tables, by its known layout."""
    body = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split())
              for b in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return html_text.train(pages)


def test_query_agrees_with_the_known_layout(spark, sf_dir, pages):
    want = {(r.page_id, r.url, article_text(r.html)) for r in pages.collect()}
    got = QUERIES["op6_html_text"](spark, sf_dir).collect()
    assert {(r.page_id, r.url, r.text) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_other_layouts(pages, model):
    rng, right = random.Random(5), []
    for r in pages.limit(60).collect():
        right.append(html_text.extract(html_text._other_layout(r.html, rng), model) == article_text(r.html))
    assert np.mean(right) > 0.95


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<div class="cookie-notice"><p>We use cookies</p></div><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav>
<div id="content"><h1>Head &amp; line</h1><p>First   part<br>goes <b>on</b>&nbsp;here, long enough to be read.
<p>Second &lt;part&gt; of the <a href="/x">text that goes</a> on for a while.<script>var t="</p>";</script>
<ul><li>item one of a list<li>item two of a list</ul><!-- gone --><div class="ad">Buy this now</div></div>
<aside><p>Side words</p></aside><section class="comments"><p>I disagree with you</p></section>
<footer>&copy; Site</footer></body>"""


def test_blocks_and_references(model):
    assert html_text.extract(PAGE, model) == "\n".join([
        "Head & line", "First part goes on here, long enough to be read.",
        "Second <part> of the text that goes on for a while.", "item one of a list", "item two of a list",
    ])


def test_broken_markup_does_not_crash(model):
    for page in ("", "   ", "text only", "<", "<p", "<p><b>a<p>b</i></div>", "<!-- never closed <p>x",
                 "<script>x", "<div " + "a='" * 50, "</p></p>", "<p>&am", "<article>" * 3_000 + "deep"):
        assert isinstance(html_text.extract(page, model), str)


def test_no_kept_element_within_a_rejected_one(model):
    rng = np.random.default_rng(2)
    page = html_text.parse(PAGE)
    for _ in range(200):
        state = html_text.decode(page, rng.normal(0, 2, len(page.elements)))
        for e, s in zip(page.elements[1:], state[1:]):
            above = state[e.parent]
            assert above != html_text._OUT or s == html_text._OUT
            assert above != html_text._MAIN or s != html_text._MIXED


def test_decoding_is_the_best_of_all():
    page = html_text.parse("<div>a<p>b</p><p>c<i>d</i></p></div><p>e</p>")
    n = len(page.elements)
    rng = np.random.default_rng(4)
    from itertools import product

    text = {node for node, t in page.pieces if t and not t.isspace()}
    for _ in range(20):
        odds = rng.normal(0, 2, n)

        def value(state):
            total = 0.0
            for i in range(1, n):
                above = state[page.elements[i].parent]
                if above == 0 and state[i] != 0 or above == 2 and state[i] == 1:
                    return -np.inf
                own = (-odds[i], -html_text.MIXED_COST - (abs(odds[i]) if i in text else 0), odds[i])
                along = above == 2 and page.elements[i].tag == "i"
                if along and state[i] != 2:
                    return -np.inf
                total += 0.0 if along else own[state[i]]
            return total

        most = max(value((1, *s)) for s in product(range(3), repeat=n - 1))
        assert abs(value(tuple(html_text.decode(page, odds))) - most) < 1e-9


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boost(x[:2000], y[:2000])
    assert ((model.log_odds(x[2000:]) > 0) == y[2000:]).mean() > 0.93
    assert boost(x[:5], np.ones(5)).log_odds(x[:5]).min() > 0


def test_odd_rows(spark, pages):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p>x</p>"), (2, "u", "<p>x</p>"), (3, "u", PAGE * 200)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "1 as text", "2 as n_chars")
    got = html_text.main_text(frame).collect()
    assert sorted((r.page_id or 0) for r in got) == [0, 1, 2, 2, 3]
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (1, None))
    assert html_text.main_text(frame.where("false")).count() == 0
    assert html_text.train(frame.where("false")).trees == []
    assert html_text.extract("<p>x</p>", Boosted(0.0, [])) == ""


def test_values_and_real_attributes_are_no_marks(spark):
    """Training reads such pages; none of them may end the query or override its labels."""
    tags = ['<a href="/map?x=1&y=2">', '<p data-y="50%">', '<rect y="12.5">', "<i title='id=nav y=x'>"]
    for tag in tags:
        raw = tag[tag.index(" "):-1]
        assert html_text._tokens(raw) == (0, 0, -1)
        assert html_text._tokens(raw, "yy") == (0, 0, -1)
    assert html_text._tokens(' class="x"yy="1" id=menu', "yy") == (0, 1, 1)
    body = "".join(f"{t}Some words of the article, long enough to count.</p>" for t in tags)
    page = f'<body><nav y="1"><a href="/">Home</a></nav><article>{body}</article></body>'
    frame = spark.createDataFrame([(i, "u", page) for i in range(4)], "page_id long, url string, html string")
    assert all("Home" not in r.text and "Some words" in r.text for r in html_text.main_text(frame).collect())


def _plain(page):
    parsed = html_text.parse(page)
    return [e.tag for e in parsed.elements], html_text.text_of(parsed, [True] * len(parsed.elements))


def test_tags_are_read_on_from_the_end_of_raw_elements():
    page = ("<script>if (a <b) { // don't\n}</script><article><p>It is one.</p>"
            "<p>We don't know.</p></article>")
    assert _plain(page) == (["#page", "article", "p", "p"], "It is one.\nWe don't know.")


@pytest.mark.parametrize("raw", [
    "<svg/>", '<svg class="x"/>', "<svg hidden/>", '<svg viewBox="0 0 1 1" />', "<svg a=0/>drawn</svg>",
    "<svg><path d='M0 0'/></svg>", "<datalist><option value=a><option value=b>hidden</datalist>",
    "<datalist><option>hidden</option><option>hidden</datalist>",
])
def test_raw_elements_end_where_they_do(raw):
    tags, text = _plain(f"<div>{raw}<p>One of two.</p></div><p>Two of two.</p><svg></svg>")
    assert text == "One of two.\nTwo of two."
    assert [x for x in tags if x != "datalist"] == ["#page", "div", "p", "p"]


WORDS = "Words of this story go on for long enough to be a paragraph of their own"
PLAIN = ('<html><body><div class="menu"><ul><li><a href="/">Home</a></li></ul></div>{0}'
         '<div class="footer"><p>All rights reserved</p></div></body></html>')
LAYOUTS = ['<div id="content">{0}</div>', '<div role="main">{0}</div>', "<div>{0}</div>", "{0}", "<main>{0}</main>"]


def _story(i):
    return "".join(f"<p>{WORDS}, {i} and {j}.</p>" for j in range(4)), "\n".join(
        f"{WORDS}, {i} and {j}." for j in range(4))


@pytest.mark.parametrize("layout", LAYOUTS)
def test_tables_without_an_article(spark, layout):
    rows = [(i, "u", PLAIN.format(layout.format(_story(i)[0]))) for i in range(40)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(frame).collect()}
    assert got == {i: _story(i)[1] for i in range(40)}


def test_labels_of_one_kind_only(spark):
    frame = spark.createDataFrame([(1, "u", "<nav><a href='/'>Home</a></nav><p>x</p>")],
                                  "page_id long, url string, html string")
    model = html_text.train(frame)
    assert html_text.extract(PLAIN.format(LAYOUTS[0].format(_story(1)[0])), model) == _story(1)[1]


def test_rare_layouts_are_in_the_sample(spark):
    rows = [(i, "u", PLAIN.format(_story(i)[0])) for i in range(300)]
    rows += [(300, "u", PLAIN.format(f'<div class="rare">{_story(300)[0]}</div>'))] + [(None, "u", rows[0][2])] * 50
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    chosen = html_text._sample(frame, 20)
    assert len(chosen) == 20 == len(set(chosen)) and sum("rare" in c for c in chosen) == 1
