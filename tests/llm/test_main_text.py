import itertools

import numpy as np
import pytest

from placework.llm import main_text as M
from placework.llm.labelled_pages import labelled_pages
from placework.operators.html import html_trees


@pytest.fixture(scope="module")
def model(spark):
    return M.fit_main_text(spark)


def trees(spark, pages, weights_of):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string").coalesce(1)
    nodes = html_trees(df).toArrow().combine_chunks().column("nodes")
    return M.read_trees(nodes.chunk(0), weights_of)


def test_messages_give_exact_marginals(spark, model):
    tree = trees(spark, ["<div><p>a b c</p><a href='x'>d</a></div><p>e</p>"], model.weights_of)
    own = M._potentials(tree, model.weights)
    kinds = np.where(tree.only, M._KIND_COUNT, [M._KINDS.get(t, 0) for t in tree.tags])
    edges = np.concatenate([model.edges, M._SAME[None]])
    total, main = 0.0, np.zeros(len(own))
    for states in itertools.product((0, 1), repeat=len(own)):
        energy = sum(o for o, s in zip(own, states) if s)
        energy += sum(edges[kinds[k], states[p], states[k]] for k, p in enumerate(tree.parent) if p >= 0)
        total += np.exp(energy)
        main += np.exp(energy) * np.array(states)
    p, _, _ = M.sum_product(tree, model.weights, model.edges)
    assert np.allclose(p, main / total)


def test_text_of_unseen_pages(spark, model):
    tree = trees(spark, labelled_pages(150, seed=77), model.weights_of)
    p, _, _ = M.sum_product(tree, model.weights, model.edges)
    text = tree.tags == "#text"
    assert ((p > 0.5) == M._labels(tree))[text].mean() > 0.97


def extract(spark, model, *pages):
    df = spark.createDataFrame([(k, "u", p, "own") for k, p in enumerate(pages)], "page_id long, url string, html string, nodes string")
    return {r.page_id: r for r in M.extract_main_text(df, model).collect()}


def test_a_page_with_everything_around(spark, model):
    page = (
        "<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>"
        "<div class='sidebar'><p>Read this other thing about the side topics today.</p></div><article><h1>Big news</h1>"
        "<p>This is the first paragraph with a <a href=q>link</a>&nbsp;and&amp;more text to read for all.</p>"
        "<div class='advertisement'>Buy now our things</div><p>Second   paragraph\n here.<script>x()</script></p>"
        "<section class='comments'><div class='comment'><p>I like this very much and say many words.</p></div></section>"
        "</article><aside>Related things</aside><form><label>Name</label></form><div class='cookie-notice'>We use cookies</div>"
        "<footer>c 2020</footer></body></html>"
    )
    row = extract(spark, model, page)[0]
    assert row.text == "Big news This is the first paragraph with a link and&more text to read for all. Second paragraph here."
    assert row.n_chars == len(row.text)


def test_hard_pages(spark, model):
    long_page = "<article><h1>Title of it</h1>" + "<p>many words in here and there</p>" * 20_000 + "</article>"
    out = extract(spark, model, None, "", "<<<>>", long_page, "<nav><a href=x>Home</a></nav>")
    assert [out[k].text for k in (0, 1, 4)] == ["", "", ""]
    assert out[3].text == "Title of it" + " many words in here and there" * 20_000
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert M.extract_main_text(none, model).collect() == []


def test_stored_articles(spark, model):
    import html as entities
    import os
    import re

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("test tables are not here")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in M.extract_main_text(pages, model).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:h1|p|br)>", " ", article))
        assert got[r.page_id] == " ".join(entities.unescape(plain).split())


LONG = "Many people came to see the new bridge over the river and stayed there until late in the evening."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<html><body><nav><a href=x>Home</a> <a href=y>News</a></nav>{LONG}<footer>c 2020</footer></body></html>", LONG),
        (LONG, LONG),
        (f"<html><body><div><a href=x>Home</a></div><div>{LONG}<br><br>{LONG}</div></body></html>", f"{LONG} {LONG}"),
        (
            f"<html><body><table><tr><td><a href=x>Home</a><a href=y>News</a><a href=z>About</a></td><td>{LONG}<br>{LONG}</td></tr></table></body></html>",
            f"{LONG} {LONG}",
        ),
        (
            "<html><body><nav><a href=x>Home</a></nav><article>" + "".join(f"<p><a href='/{k}'>{LONG}</a></p>" for k in range(8)) + "</article></body></html>",
            " ".join([LONG] * 8),
        ),
        (f"<html><body><article><h1>News</h1><p>{LONG}</p><div class='message'><p>{LONG}</p></div></article></body></html>", f"News {LONG} {LONG}"),
        (f"<html><body><article><h1>News</h1><p>{LONG}</p><div class='ad-free'><p>{LONG}</p></div></article></body></html>", f"News {LONG} {LONG}"),
        ("<html><body>" + "<div>" * 3000 + f"<p>{LONG}</p><p>{LONG}</p>" + "</div>" * 3000 + "</body></html>", f"{LONG} {LONG}"),
    ],
    ids=["body", "no tags", "breaks", "table", "link article", "message", "ad-free", "deep"],
)
def test_plain_layouts_keep_their_text(spark, model, page, text):
    assert extract(spark, model, page)[0].text == text
