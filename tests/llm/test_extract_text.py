"""HTML extraction: messages against full enumeration, held-out layouts, planted pages, edge rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodgeflow.llm import extract_text as X
from lodgeflow.llm.dom import Forest
from lodgeflow.llm.labelled_pages import labelled_pages


@pytest.fixture(scope="module")
def model():
    return X.default_model()


def test_messages_equal_full_enumeration():
    rng = np.random.default_rng(3)
    forest = Forest()
    forest.add("<div><p>a</p><ul><li>b</li></ul></div>c<nav>d</nav>")
    forest.add("<p>x</p>")
    tree = X.Tree(forest)
    n = len(forest.parent)
    score, edge = rng.normal(size=n) * 2, rng.normal(size=(X.KINDS, 2, 2)) * 2
    p, both, total = X.marginals(tree, score, edge)
    weight, ones, pairs = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for y in itertools.product((0, 1), repeat=n):
        s = sum(score[i] for i in range(n) if y[i])
        s += sum(edge[tree.kind[i], y[tree.parent[i]], y[i]] for i in range(n) if tree.parent[i] >= 0)
        weight += np.exp(s)
        ones += np.exp(s) * np.array(y)
        for i in range(n):
            if tree.parent[i] >= 0:
                pairs[i, y[tree.parent[i]], y[i]] += np.exp(s)
    assert np.allclose(p, ones / weight) and np.allclose(both, pairs / weight) and np.isclose(total, np.log(weight))


def test_held_out_layouts(model):
    forest = Forest()
    for page in labelled_pages(300, seed=99):
        forest.add(page)
    text = np.array([t is not None for t in forest.text])
    right = (model.content(forest) > 0.5) == (np.array(forest.label) == 1)
    assert text.sum() > 5000 and right[text].mean() > 0.99


FURNITURE = ('<header><h1>Site name</h1><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav></header>'
             '<div class="cookie-bar notice">We use cookies to improve your stay. Accept them all, please.</div>'
             '<div class="ad-box ad">Buy our wonderful shoes, now cheaper.</div>')
AFTER = ('<aside class="sidebar"><h3>More</h3><ul><li><a href=1>One thing</a><li><a href=2>Other thing</a></ul></aside>'
         '<section id="comments"><h2>Comments</h2><div class="comment"><b>Ann</b><p>I liked this article very much, thank you.</p></div></section>'
         '<form action=/s><label>Search</label><input><button>Go</button></form><footer>&copy; 2026 Site. All rights reserved.</footer>')
BODY = ('<h1>The title</h1><p>First &amp; longest paragraph of the text, with <b>bold</b> and <a href=x>a link</a>.\n It goes on,  and on.'
        '<p>Second one&nbsp;here.<script>if (1 < 2) write("<p>no</p>")</script><ul><li>item one<li>item two</ul>Short.')
WANT = "The title First & longest paragraph of the text, with bold and a link. It goes on, and on. Second one here. item one item two Short."


@pytest.mark.parametrize("start,end", [("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<div class=content>", "</div>"),
                                       ('<div id="content">', "</div>"), ('<div class="post-content">', "</div>"), ("<main>", "</main>")])
def test_planted_pages(model, start, end):
    page = f"<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style></head><body>{FURNITURE}{start}{BODY}{end}{AFTER}</body></html>"
    assert model.texts([page]) == [WANT]
    inside = start + BODY.replace("<p>Second", '<div class="advert">Cheap watches, today only.</div><p>Second') + AFTER.split("<form")[0] + end
    assert model.texts([f"<body>{FURNITURE}{inside}<footer>Contact us</footer>"]) == [WANT]


def test_markup_of_all_kinds():
    forest = Forest()
    forest.add("a<!-- <p>x --><b>b</b>c<br>d<p>e<div>f</p></div>g &lt;p&gt; &am &amp<TEXTAREA>no</TextArea><a href='>'>h</a> <p title=\"a>b\">i<p don't>j's</p>"
               "<svg><text>no</text></svg><td>k<td>l</td></b></table>1 < 2 <3 &#x41;&nonentity;<script>never closed <p>z")
    got = " ".join("".join((" " if forest.broken[i] else "") + "".join(t) for i, t in enumerate(forest.text) if t is not None).split())
    assert got == "abc d e f g <p> &am & h i j's k l 1 < 2 <3 A&nonentity;"


def test_edge_rows(spark, model):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    long = "<article><h1>Long</h1>" + "<p>some words of it.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", " \n "), (4, "u", "<"), (5, "u", deep), (6, "u", long), (6, "u", long), (None, "u", f"<article>{BODY}</article>"),
            (7, "u", "<nav><a href=x>only a menu</a></nav>"), (8, "u", "<p " * 5000), (9, "u", "<!--"), (10, "u", "</article>" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("k0", F.lit(1)).withColumn("words", F.lit("x"))
    got = X.extract_text(df, keep=("url",), model=model)
    assert got.columns == ["page_id", "url", "text"]
    got = got.collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(text[i] == "" for i in (1, 2, 3, 7, 8, 9, 10)) and text[None] == WANT
    assert text[6] == "Long" + " some words of it." * 20_000 and [r.url for r in got if r.page_id == 2] == [None]
    assert X.extract_text(df.limit(0), model=model).collect() == []
