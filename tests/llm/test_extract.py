"""The block labeller: its parser on awkward markup, its gradients, and its labels on layouts that it hasn't seen."""

from __future__ import annotations

import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import extract, layouts
from riskframe.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def model(spark, sf):
    return extract.fit(spark.read.parquet(f"{sf}/pages.parquet"))


def texts(page: str) -> list[str]:
    return [b.text for b in extract.blocks(page)]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("", []),
        ("plain text", ["plain text"]),
        ("<p>a&amp;b &lt;i&gt; &#233;&nbsp;&#x1F600; &copy;", ["a&b <i> é \U0001f600 ©"]),
        ("<p>one<p>two<br>three <b>fo</b>ur", ["one", "two three four"]),
        ("<script>var t='</p><p>no';</script><style>p{}</style>yes", ["yes"]),
        ("<SCRIPT>x</Script >yes<script>never closed", ["yes"]),
        ("a<!-- no <p> -->b<!-- never closed", ["ab"]),
        ("<div title=\"a > b\" data-x='<p>'>x</div>", ["x"]),
        ("<div title=\"odd>x</div>y", ["x", "y"]),
        ("x < y <3 a<b", ["x < y <3 a"]),
        ("keep <unfinished", ["keep"]),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", ["a", "b", "c", "d", "e"]),
        ("</p></div>stray</span>", ["stray"]),
        ("<html><head><title>no</title><body>yes", ["yes"]),
        ("<form>a<button>b</form>c<select><option>d</select>e", ["a", "ce"]),
        ("<p> \t\n one    two \n</p><p> </p>", ["one two"]),
        ("<![CDATA[x]]>y<?php z ?><!DOCTYPE html>w", ["yw"]),
        ("<textarea><p>no</textarea><noscript><p>no</p></noscript><p>yes", ["yes"]),
    ],
)
def test_blocks(page, expected):
    assert texts(page) == expected


def test_paths_and_links():
    a, b = extract.blocks('<body><div class="siteNav topBar"><a href="/">home page</a></div><article id="x"><p>Some <a>link</a>')
    assert a.names == ("", "body", "div") and b.names == ("", "body", "article", "p")
    assert a.links == 9 and b.links == 4 and len(a.path) > len(set(b.leaf))
    assert extract.blocks('<div class="advertising">x')[0].leaf[-1] == extract.blocks('<div class="advert">x')[0].leaf[-1]  # words that begin alike


@pytest.mark.parametrize("page", ["<a <a " * 100000, '<a "' * 100000 + ">", "<div>" * 30000 + "x" + "</div>" * 30000, "<p>x" * 50000, "<!--" * 100000, "&amp" * 100000, "</nav>" * 100000, "<button>" * 20000 + "</button>" * 20000])
def test_malformed_pages_take_time_in_proportion(page):
    began = time.perf_counter()
    extract.blocks(page)
    assert time.perf_counter() - began < 10


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(2)
    pages = [extract.blocks(layouts.compose(s, [["some", "words", "to", "write"]])) for s in (3, 4, 5)] + [[]]
    s = extract.sequences(pages)
    y = rng.integers(0, 2, len(s.measures)).astype(np.float32)
    m = extract.Labeller()
    m.weights = {k: v.astype(np.float64) for k, v in m.weights.items()}

    def loss() -> float:
        p = np.concatenate([m._read(s)[0]])
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    for k, g in m.gradients(s, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was = m.weights[k][at]
        m.weights[k][at] = was + 1e-2
        up = loss()
        m.weights[k][at] = was - 1e-2
        down = loss()
        m.weights[k][at] = was
        assert g[at] == pytest.approx((up - down) / 2e-2, rel=2e-2), k


def test_context_of_the_whole_page_counts():
    """The same block has another probability when a far block changes: both directions carry."""
    m = extract.Labeller()
    page = extract.blocks("".join(f"<p>word {i}</p>" for i in range(9)))
    other = extract.blocks("<nav>menu</nav>" + "".join(f"<p>word {i}</p>" for i in range(1, 9)))
    late = extract.blocks("".join(f"<p>word {i}</p>" for i in range(8)) + "<nav>menu</nav>")
    p, q, r = m.probabilities([page, other, late])
    assert abs(p[4] - q[4]) > 1e-6 and abs(p[4] - r[4]) > 1e-6
    assert np.allclose(m.probabilities([page])[0], p, atol=1e-5)  # whichever pages it is read with


def article(page: str) -> str:
    """Text of the only article element, by another way."""
    inner = re.sub("<[^>]*>", "", re.sub(r"</?(p|h1)>|<br>", " ", re.search(r"<article>(.*?)</article>", page, re.S)[1]))
    return " ".join(html.unescape(inner).split())


def test_given_pages(spark, sf, model):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = extract.extract(spark.read.parquet(f"{sf}/pages.parquet"), model).collect()
    assert sorted(r["page_id"] for r in found) == sorted(pages)
    wrong = [r["page_id"] for r in found if r["text"] != article(pages[r["page_id"]]["html"])]
    assert len(wrong) <= len(pages) / 200
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"] for r in found)


def test_layouts_not_learned_from(model):
    right = every = 0
    for seed in range(10**6, 10**6 + 150):
        page = extract.blocks(layouts.compose(seed, []))
        y = np.array([layouts.MARK in b.text for b in page], bool)
        for b in page:
            b.text = b.text.replace(layouts.MARK, "")
        right += int(((model.probabilities([page])[0] >= 0.5) == y).sum())
        every += len(page)
    assert right > 0.98 * every


#: Main blocks begin with a star; names of classes differ from those learned from.
SITES = [
    '<div id="hdr"><a href="/">My Site</a><ul class="mnu"><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></div><div class="cols"><div class="lhs"><h1>*Big news today</h1><p>*The town council met on Monday to discuss the new road. It was agreed that work would begin soon.</p><p>*Second paragraph with <a href=x>a link</a> inside, and more words to read here.</p><div class="advertising">Buy cheap shoes here, the best in town.</div><p>*Third paragraph closes the story.</p></div><div class="rhs"><h3>Most read</h3><ul><li><a href=a>Story one about cats</a></li><li><a href=b>Story two about dogs</a></li></ul></div></div><div id="ftr">&copy; 2020 My Site. All rights reserved.</div>',
    '<header><h2>The Daily</h2><nav><a href=/>a</a> <a href=/b>b</a></nav></header><main><article><h1>*Title &amp; more</h1><p>*One&nbsp;two three four five six seven.</p><ul><li>*First point of the list</li><li>*Second point</li></ul><blockquote>*Quoted words from someone.</blockquote></article><section id="comments"><h2>3 comments</h2><div class="cmt"><b>Joe</b><p>I do not agree with this piece at all, it is wrong.</p></div><div class="cmt"><b>Ann</b><p>Great read, thanks for writing it.</p></div><form><label>Name</label><input><textarea></textarea></form></section></main><aside><p>About the author: she writes about food and travel.</p></aside><footer><p>Contact us at 12 Street.</p></footer>',
    '<div class="cookie-bar">We use cookies on this site. <button>OK</button></div><div class="top"><a href=/>Logo</a></div><div class="story__text"><p>*Alpha beta gamma delta epsilon zeta eta theta iota kappa.</p><p>*Lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega.</p></div><div class="sidebar-right"><p>Subscribe to our weekly letter and never miss a thing.</p></div><div class="bottom-links"><a href=a>Terms</a> <a href=b>Privacy</a></div>',
    '<nav><ul><li><a href=a>Home</a><li><a href=b>Sport</a></ul></nav><div role="main"><h1>*Bread</h1><p>*Bread is made of flour and water, and takes a day.</p><h2>*Method</h2><ol><li>*Mix everything in a bowl.</li><li>*Bake for an hour.</li></ol></div><div class="newsletter"><form><p>Get recipes by mail</p><input></form></div><div class="footer"><p>Copyright 2021 Bread Co.</p></div>',
    '<div class="site-header"><p>Site tagline goes here</p></div><div class="alert">This site will be down on Sunday.</div><article class="post"><header><h1>*Travel notes</h1></header><p>*We left early and walked along the river until noon.</p><div class="share-buttons"><a href=x>Facebook</a><a href=y>Twitter</a></div><p>*In the evening it rained, so we stayed inside and read.</p><div class="related"><h3>Related</h3><a href=q>Another trip we made</a></div></article><div class="comments"><p class="comment">Lovely trip! I went there once.</p><p class="comment">Where is this?</p></div><footer>Legal notice. All rights reserved.</footer>',
]


def test_sites_written_by_hand(model):
    right = every = 0
    for site in SITES:
        page = extract.blocks(f"<html><body>{site}</body></html>")
        y = np.array([b.text.startswith("*") for b in page])
        for b in page:
            b.text = b.text.removeprefix("*")
        right += int(((model.probabilities([page])[0] >= 0.5) == y).sum())
        every += len(page)
    assert right >= 0.93 * every


def test_odd_pages(spark, model):
    long = "<html><body><nav><a href=x>menu</a></nav><article>" + "".join(f"<p>Paragraph number {i} of a very long article, which goes on and on.</p>" for i in range(20000)) + "</article></body></html>"
    small = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><p>Some text that is long enough to be read.</p></article></body></html>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "   "), (None, "v", small), (5, "w", small), (5, "w", small), (6, "x", long), (7, "y", "<script>only"), (8, "z", "\x00<p>\x01 &#0; &#xD800; \x85"), (9, "q", "<" * 5000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("text", "n_chars", "t", "id", "h")})
    found = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in extract.extract(docs.repartition(3), model).collect()]
    by_id = {r[0]: r for r in found}
    assert len(found) == len(rows)
    assert all(by_id[i][2:] == ("", 0) for i in (1, 2, 3, 7)) and by_id[2][1] is None
    assert by_id[None][2] == by_id[5][2] == "Some text that is long enough to be read." and found.count(by_id[5]) == 2
    assert by_id[6][2].startswith("Paragraph number 0") and by_id[6][2].count("Paragraph number") > 19900
    assert all(len(r[2]) == r[3] for r in found)


def test_empty_table_and_no_sample(spark):
    none = spark.createDataFrame([], SCHEMA)
    learned = extract.fit(none, composed=60)  # from composed pages alone
    assert extract.extract(none, learned).count() == 0
    p = extract.blocks("<nav><a href=x>a</a></nav><article><p>Words to read here, and more of them.</p></article>")
    assert learned.probabilities([p, []])[1].shape == (0,)


def test_same_model_however_pages_are_dealt(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    a, b = (extract.fit(x, sample=30, composed=40).weights for x in (pages, pages.orderBy(F.desc("page_id")).repartition(5)))
    assert all(np.array_equal(a[k], b[k]) for k in a)


def test_query_covers_all_pages(spark, sf):
    found = QUERIES["op13_html_text"](spark, sf)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
