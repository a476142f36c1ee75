import pytest
from pyspark.sql import functions as F

from placework.operators import pages
from placework.operators.html import html_nodes, html_trees


def trees(spark, *bodies):
    rows = [(i, f"http://h.ro/{i}", b) for i, b in enumerate(bodies)]
    return html_trees(spark.createDataFrame(rows, "page_id long, url string, html string"))


def tags(spark, body):
    rows = html_nodes(spark.createDataFrame([(0, body)], "page_id long, html string")).orderBy("node_id").collect()
    return [(r["tag"], r["parent_id"], r["text"]) for r in rows]


def test_broken_pages(spark):
    assert tags(spark, "<p><b>x<br><p>y</p>") == [
        ("p", None, None), ("b", 1, None), ("#text", 2, "x"), ("br", 2, None), ("p", None, None), ("#text", 5, "y"),
    ]
    assert tags(spark, '<script>"</p>"</script>') == [("script", None, None), ("#raw", 1, '"</p>"')]
    assert tags(spark, "") == [] and tags(spark, None) == []
    assert tags(spark, "</p>a &lt; b<!-- <i> --><ul><li>1<li>2</ul>") == [
        ("#text", None, "a < b"), ("ul", None, None), ("li", 2, None), ("#text", 3, "1"), ("li", 2, None), ("#text", 5, "2"),
    ]
    assert tags(spark, "<table><tr><td>1<td>2<tr><td><table><tr><td>3</table>") [0][0] == "table"
    assert tags(spark, "<SCRIPT>var a = '<b>'") == [("script", None, None), ("#raw", 1, "var a = '<b>'")]
    assert tags(spark, "a<!-- never closed <b>") == [("#text", None, "a")]


@pytest.mark.parametrize("piece", ["<a '", "<!--", "<a ", "<script ", "<a '>", "<x y=\""])
def test_hostile_pages_take_linear_time(piece):
    from time import perf_counter

    from placework.operators.html import _Nodes

    start = perf_counter()
    _Nodes().add_page(piece * 100_001)
    assert perf_counter() - start < 10


def test_attributes_and_subtrees(spark):
    page = trees(spark, "<div class='a b' id=x data-q>t<p>u</p></div><div class=b>v</div>")
    hits = pages.match_elements(page, "div", {"class": "b"}, ["id", ("class", "^(.)")]).orderBy("node_id").collect()
    assert [(r["value_0"], r["value_1"]) for r in hits] == [("x", "a"), (None, "b")]
    nodes = F.col("nodes")
    texts = page.select(F.transform(pages.find_all(nodes, "div"), lambda d: pages.text_of(nodes, d)).alias("t"))
    assert texts.collect()[0]["t"] == ["tu", "v"]


def test_page_without_the_thing(spark):
    page = trees(spark, "<p>nothing</p>")
    assert pages.page_title(page).collect()[0]["title"] is None
    assert pages.page_table(page).count() == 0
    assert pages.wiki_table(page).count() == 0
    record = pages.listing_record(page).collect()[0]
    assert record["status"] == "error" and record["capacity"] == '{"unknown":[]}' and record["images"] == []
    assert pages.wiki_page(page).collect()[0]["latitude"] is None


def test_content_lines(spark):
    long = "Words enough to be a line of prose in the page content"
    page = trees(
        spark,
        f"<p>{long}</p><h2>{long}</h2><p>short</p>"
        f"<p>{long} <b>bold, <i>nested!!</i></b> end</p>"
        f"<p>{long} <i>calm.</i> end</p><span><p>{long} inside</p></span>"
        "<p>" + "many, marks; here: " * 6 + "</p>",
    )
    lines = [r["line"] for r in pages.page_content(page).collect()]
    assert lines == [long, f"{long} end", f"{long} calm end"]


def test_first_value_of_a_label_counts(spark):
    row = "<tr><td>{}</td><td>{}</td></tr>"
    body = "<table>" + "".join(
        row.format(a, b)
        for a, b in [("x", "y"), ("Telefon :", "NU deţinem"), ("Telefon :", "071"), ("Adresa:", "one"), ("Adresa:", "two")]
    ) + "</table>"
    got = pages.detail_fields(trees(spark, body)).collect()[0]
    assert got["phone"] == "071" and got["address"] == '{"adresa":"one"}' and got["county"] is None


def test_thumbnails_are_the_fallback(spark):
    thumbs = "".join(f"<a class='x hotel_thumbs_sprite' href='/max300/{i}'></a>" for i in range(15))
    page = trees(spark, "<a class=hotel_thumbs_sprite href='#'></a>" + thumbs)
    for limit, number in ((11, 11), (None, 15)):
        got = pages.listing_record(page, limit).collect()[0]
        assert got["images"] == [f"/max1024x768/{i}" for i in range(number)]


def test_last_section_of_a_heading_counts_at_the_first_place(spark):
    import json
    import time

    def section(head, item):
        return f"<div class=facilitiesChecklistSection><h5>{head}</h5><ul><li>{item}</li></ul></div>"

    body = section("b", 1) + section("a", 2) + section("b", 3)
    got = pages.listing_record(trees(spark, body)).collect()[0]
    assert got["facilities"] == '{"b":["3"],"a":["2"]}'
    start = time.perf_counter()
    df = spark.createDataFrame([("u", [(f"k{i % 20_000}", [str(i)]) for i in range(50_000)])], "url string, e array<struct<k:string,v:array<string>>>")
    kept = pages._last_by_key(df, "e").collect()[0]["e"]
    assert [e["k"] for e in kept] == [f"k{i}" for i in range(20_000)] and kept[5]["v"] == ["40005"]
    assert time.perf_counter() - start < 20
    assert json.loads(got["facilities"])["b"] == ["3"]


def test_table_headings_keep_their_places(spark):
    table = "<table><tr><th></th><th>A</th></tr><tr><td title=x data-k=1>1</td><td>2</td></tr></table>"
    cells = lambda **kw: [(c["key"], c["text"], c["value"]) for c in pages.page_table(trees(spark, table), **kw).collect()[0]["cells"]]
    assert cells() == [("", "1", "x"), ("a", "2", None)]
    assert cells(skip_cells=1) == [("a", "2", None)]
    several = pages.page_table(trees(spark, table), value_of=["title", "data-k"]).collect()[0]["cells"][0]["value"]
    assert several.asDict() == {"title": "x", "data-k": "1"}


def test_prices_in_text_order(spark):
    block = "<div class=rc><a href=/a>5 lei <b>20 lei</b></a> 30 lei</div><div class=rc><a href=/b>no</a></div>"
    got = [(r["href"], r["price"]) for r in pages.result_prices(trees(spark, block)).collect()]
    assert got == [("/a", "20 lei")]
