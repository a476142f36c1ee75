"""Page extraction over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages
from ..operators.html import html_nodes, html_trees
from ..functions.text import squash_spaces
from ..session import spread
from . import render
from .registry import query, table


def stored_trees(spark, sf, *columns):
    return html_trees(table(spark, sf, "pages").select("page_id", *columns, "html"))


@query(
    "h1_html_nodes",
    r"""WITH p AS (SELECT page_id, regexp_replace(html, '(?s)<script>.*?</script>|<!--.*?-->', '', 'g') AS html FROM pages),
             t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM p
                   UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '<(script)>', 1)) FROM pages)
        SELECT page_id, tag, count(*) AS nodes FROM t GROUP BY page_id, tag""",
)
def h1(spark, sf):
    nodes = html_nodes(table(spark, sf, "pages").select("page_id", "html"))
    return nodes.filter(~F.startswith("tag", F.lit("#"))).groupBy("page_id", "tag").agg(F.count("*").alias("nodes"))


@query(
    "h2_match_elements",
    r"""SELECT page_id, 'href' AS way, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS value FROM pages
        UNION ALL
        SELECT page_id, 'group', unnest(regexp_extract_all(html, '<a href="/([^"/])[^"]*"', 1)) FROM pages
        UNION ALL
        SELECT page_id, 'class', unnest(regexp_extract_all(html, '<div class="(ad)"', 1)) FROM pages""",
)
def h2(spark, sf):
    trees = stored_trees(spark, sf)
    href = pages.match_elements(trees, "a", None, ["href", ("href", "^/([^/])")])
    ads = pages.match_elements(trees, "div", {"class": "ad"}, ["class"])
    either = F.stack(F.lit(2), F.lit("href"), F.col("value_0"), F.lit("group"), F.col("value_1"))
    return (
        href.select("page_id", either.alias("way", "value"))
        .filter("value IS NOT NULL")
        .unionByName(ads.select("page_id", F.lit("class").alias("way"), F.col("value_0").alias("value")))
    )


@query("h3_page_links", """SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""")
def h3(spark, sf):
    return pages.page_links(stored_trees(spark, sf)).select("page_id", "href")


@query(
    "h4_page_images",
    """SELECT p_partkey AS page_id, 0 AS pos, 'http://h.ro/' || p_partkey || '/img/' || p_brand || '.png' AS image_url
       FROM part UNION ALL SELECT p_partkey, 1, 'http://h.ro/' || p_partkey || '/' || p_size || '.jpg' FROM part""",
)
def h4(spark, sf):
    rendered = spread(table(spark, sf, "part")).select(
        F.col("p_partkey").alias("page_id"),
        render.html("http://h.ro/", F.col("p_partkey")).alias("url"),
        render.html(
            '<p><img src="img/', F.col("p_brand"), '.png"><img alt="none"></p><img src=\'', F.col("p_size"), ".jpg'/>"
        ).alias("html"),
    )
    return pages.page_images(html_trees(rendered)).select("page_id", "pos", "image_url")


_TITLE_SQL = """trim(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1),
    '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'))"""


@query("h5_page_title", f"SELECT page_id, {_TITLE_SQL} AS title FROM pages")
def h5(spark, sf):
    return pages.page_title(stored_trees(spark, sf))


@query("h6_page_metadata", "SELECT s_suppkey AS page_id, s_name || ' <' || s_nationkey || '>' AS content FROM supplier")
def h6(spark, sf):
    rendered = spread(table(spark, sf, "supplier")).select(
        F.col("s_suppkey").alias("page_id"),
        render.html(
            '<head><meta charset="utf-8"><meta name="author" content="x"><meta name="description" content="',
            F.col("s_name"), " &lt;", F.col("s_nationkey"), '&gt;"><meta name="description" content="second"></head>',
        ).alias("html"),
    )
    return pages.page_metadata(html_trees(rendered), "description")


@query(
    "h7_page_table",
    """SELECT c_custkey AS page_id, row_no, CASE row_no WHEN 0 THEN c_name ELSE c_mktsegment END AS nume,
              CASE row_no WHEN 0 THEN '/c/' || c_custkey ELSE 'tip' END AS link,
              CASE row_no WHEN 0 THEN c_nationkey::VARCHAR ELSE '' END AS judet
       FROM customer CROSS JOIN (SELECT unnest([0, 1]) AS row_no)""",
)
def h7(spark, sf):
    rendered = spread(table(spark, sf, "customer")).select(
        F.col("c_custkey").alias("page_id"),
        render.html(
            "<table><tr><th></th><th>Nume</th><th>Judeţ</th></tr><tr><td>1<td><a href='/c/", F.col("c_custkey"), "'>",
            F.col("c_name"), "</a><td>", F.col("c_nationkey"), "</tr><tr><td>2</td><td title=tip>", F.col("c_mktsegment"),
            "&nbsp</td><td></td></tr></table><table><tr><td>not this one</td></tr></table>",
        ).alias("html"),
    )
    rows = pages.page_table(html_trees(rendered), skip_cells=1)
    name, county = pages.cell(F.col("cells"), "nume"), pages.cell(F.col("cells"), "judet")
    return rows.select(
        "page_id", "row_no", F.replace(name["text"], F.lit(" "), F.lit("")).alias("nume"),
        name["value"].alias("link"), county["text"].alias("judet"),
    )


def detail_pages(spark, sf):
    """customer as detail pages: page_id, url, status, html."""
    rows = (
        spread(table(spark, sf, "customer"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    images = render.html(
        '<img src="zz_a', F.col("c_custkey"), '.JPG"><img src="plain.png"><img src="zz_b">', "<img alt=x>"
    )
    return rows.select(
        F.col("c_custkey").alias("page_id"),
        render.html("/place/", F.col("c_custkey")).alias("url"),
        F.when(F.col("c_nationkey") == 24, 404).otherwise(200).alias("status"),
        render.detail_page(
            F.initcap("r_name"), F.replace("n_name", F.lit("_"), F.lit("-Sat-")), F.col("c_mktsegment"),
            F.when(F.col("c_acctbal") < 0, "NU deţinem").otherwise(render.html("07", F.col("c_custkey"))),
            render.html(F.lit(44) + F.col("c_nationkey") % 4, ".5"), render.html(F.col("c_custkey") % 180, ".25"), images,
        ).alias("html"),
    )


@query(
    "h8_detail_fields",
    """SELECT c_custkey AS page_id, r_name[1] || lower(r_name[2:]) AS county,
              replace(n_name, '_', '-Sat-') AS city, '{"localitate":"' || replace(n_name, '_', '-Sat-') || '","judet":"'
              || r_name[1] || lower(r_name[2:]) || '","adresa":"' || c_mktsegment || '"}' AS address,
              CASE WHEN c_acctbal < 0 THEN '{}' ELSE '{"telefon":"07' || c_custkey || '"}' END AS contacts,
              CASE WHEN c_acctbal >= 0 THEN '07' || c_custkey END AS phone
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       WHERE r_name NOT LIKE '% %'
       UNION ALL
       SELECT c_custkey, 'Middle East', replace(n_name, '_', '-Sat-'), '{"localitate":"' || replace(n_name, '_', '-Sat-') ||
              '","judet":"Middle East","adresa":"' || c_mktsegment || '"}',
              CASE WHEN c_acctbal < 0 THEN '{}' ELSE '{"telefon":"07' || c_custkey || '"}' END,
              CASE WHEN c_acctbal >= 0 THEN '07' || c_custkey END
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       WHERE r_name LIKE '% %'""",
)
def h8(spark, sf):
    return pages.detail_fields(html_trees(detail_pages(spark, sf).select("page_id", "html")))


def listing_pages(spark, sf):
    """customer as listing pages: page_id, url, html."""
    rows = spread(table(spark, sf, "customer")).join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return rows.select(
        F.col("c_custkey").alias("page_id"),
        render.html("https://www.lodging.example/hotel/", F.col("c_custkey"), ".ro.html").alias("url"),
        render.listing_page(
            render.html(F.lit(20) + F.col("c_custkey") % 60, ".", F.lit(10000) + F.col("c_custkey")), render.html("25.", F.lit(100) + F.col("c_nationkey")),
            F.col("c_name"), F.col("n_name"), F.concat(F.lit("Str. "), F.col("c_mktsegment")),
            render.html(F.lit(100) + F.col("c_nationkey"), ",50"), F.col("c_custkey"),
        ).alias("html"),
    )


@query(
    "h9_page_json_ld",
    """SELECT s_suppkey AS page_id, CASE WHEN s_nationkey < 20 THEN 'de la ' || s_nationkey || ' lei' END AS price_range,
              CASE WHEN s_nationkey < 20 THEN s_name END AS street FROM supplier""",
)
def h9(spark, sf):
    record = render.html(
        '{"@type":"Hotel","priceRange":"de la ', F.col("s_nationkey"), ' lei","address":{"streetAddress":"',
        F.col("s_name"), '"}}',
    )
    script = F.when(F.col("s_nationkey") < 20, record).when(F.col("s_nationkey") < 22, "not json").otherwise("")
    rendered = spread(table(spark, sf, "supplier")).select(
        F.col("s_suppkey").alias("page_id"),
        render.html('<script>var a=1;</script><script type="application/ld+json">', script, "</script>").alias("html"),
    )
    read = pages.page_json_ld(html_trees(rendered))
    return read.select(
        "page_id", F.col("ld.priceRange").alias("price_range"), F.col("ld.address.streetAddress").alias("street")
    )


@query(
    "h10_listing_record",
    """SELECT c_custkey AS page_id, (20 + c_custkey % 60) || '.' || (10000 + c_custkey) AS latitude, '25.' || (100 + c_nationkey) AS longitude,
              NULL::VARCHAR AS status, 'Str. ' || c_mktsegment || ', ' || n_name AS address,
              'Long ' || c_name || 'by the lake' AS long_description, 'Short ' || c_name AS short_description,
              '{"Natural":["Lake ' || n_name || '","Hill"]}' AS surroundings,
              '{"Food":["Bar","' || c_name || '"]}' AS facilities, '{"3":["1 bed"]}' AS capacity,
              '/img/max1024x768/' || c_custkey || '.jpg /img/max1024x768/b.jpg' AS images
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def h10(spark, sf):
    found = pages.listing_record(html_trees(listing_pages(spark, sf).select("page_id", "html")), thumb_limit=11)
    return found.withColumn("images", F.array_join("images", " "))


@query(
    "h11_wiki_table",
    """SELECT c_custkey AS page_id, true AS is_data, 0 AS row_no, c_name AS title, '/w/' || c_custkey AS href,
              '/c/' || n_nationkey AS city_href, n_name AS city, c_mktsegment AS type
       FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey < 15
       UNION ALL
       SELECT c_custkey, false, 1, n_name, '/later/' || c_custkey, NULL, NULL, NULL
       FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey >= 15""",
)
def h11(spark, sf):
    rows = spread(table(spark, sf, "customer")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    data = render.html(
        "<table class='wikitable sortable datatable'><tr><td><a title='", F.col("c_name"), "' href='/w/", F.col("c_custkey"),
        "'>x</a></td><td><a href='/c/", F.col("n_nationkey"), "'>\n", F.col("n_name"), "</a></td><td>n</td><td>",
        F.col("c_mktsegment"), " and more</td></tr><tr><td>too</td><td>few</td></tr></table>",
    )
    names = render.html(
        "<table class=wikitable><tr><td><a href='/first'>", F.col("n_name"), " x</a></td><td>b<td>c</tr><tr><td><a href='/later/",
        F.col("c_custkey"), "'>", F.col("n_name"), "</a></td><td>b<td>c</tr><tr><td></td><td>b<td>c</tr></table>",
    )
    rendered = rows.select(
        F.col("c_custkey").alias("page_id"),
        render.html("<table class=other></table>", F.when(F.col("c_nationkey") < 15, data).otherwise(names)).alias("html"),
    )
    return pages.wiki_table(html_trees(rendered))


@query(
    "h12_wiki_page",
    """SELECT conv_id * 1000 + turn AS page_id, replace(text, chr(10), ' ') || 'end' AS description,
              CASE WHEN role = 'user' THEN round(45 + turn / 60.0 + 12 / 3600.0, 6)::DOUBLE END AS latitude,
              CASE WHEN role = 'user' THEN round(-(25 + turn / 60.0), 6)::DOUBLE END AS longitude FROM conversations""",
)
def h12(spark, sf):
    escaped = F.col("text")
    for raw, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", " ")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(written))
    spot = F.when(
        F.col("role") == "user",
        render.html(
            "<span class=latitude>45°", F.col("turn"), "′12″N</span><span class=longitude>25°", F.col("turn"), "′00″V</span>"
        ),
    ).otherwise("<span class=latitude>45°1′N</span>")
    rendered = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"),
        render.html(
            "<p>outside</p><div class='x mw-content-ltr'>", spot, "<p>", escaped, "</p><ul><li>not this</ul><p>end</div>"
        ).alias("html"),
    )
    found = pages.wiki_page(html_trees(rendered))
    return found.select(
        "page_id", "description", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude")
    )


def result_pages(spark, sf):
    """part as one search result page each, with two result blocks."""
    name, size = F.col("p_name"), F.col("p_size")
    first = render.result_block(
        render.html("http://shop.example/", F.col("p_partkey")), name, render.html("only ", size, " Euro ", F.col("p_brand"))
    )
    second = render.html('<div class="rc"><a href="/none">', F.col("p_type"), "</a> no price</div>")
    return spread(table(spark, sf, "part")).select(
        F.col("p_partkey").alias("page_id"), render.result_page(F.concat(first, second)).alias("html")
    )


@query(
    "h13_result_items",
    """SELECT p_partkey AS page_id, 0 AS pos, 'http://shop.example/' || p_partkey AS href,
              p_name || 'only ' || p_size || ' Euro ' || p_brand || ' and 40 lei' AS text FROM part
       UNION ALL SELECT p_partkey, 1, '/none', p_type || ' no price' FROM part""",
)
def h13(spark, sf):
    return pages.result_items(html_trees(result_pages(spark, sf)))


@query(
    "h14_result_prices",
    """SELECT p_partkey AS page_id, 0 AS pos, 'http://shop.example/' || p_partkey AS href,
              CASE WHEN p_size >= 10 THEN p_size || ' Euro' ELSE '40 lei' END AS price FROM part""",
)
def h14(spark, sf):
    return pages.result_prices(html_trees(result_pages(spark, sf)))


@query("h15_page_content")
def h15(spark, sf):
    return pages.page_content(stored_trees(spark, sf)).select("page_id", "key", "line")


@query(
    "h15_content_lines",
    r"""WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))),
                                  '[\s\x0b\x{85}\p{Z}]+', ' ', 'g')) AS line FROM documents),
             c AS (SELECT *, regexp_replace(line, '[!-/:-@\[-`{-~]', '', 'g') AS clean FROM l)
        SELECT DISTINCT doc_id AS page_id, md5(line) AS key, line FROM c
        WHERE length(line) - length(clean) < 15 AND length(clean) > 40""",
)
def h15_lines(spark, sf):
    escaped = F.col("text")
    for raw, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "</p><p>")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(written))
    rendered = spread(table(spark, sf, "documents").select("doc_id", "text")).select(
        F.col("doc_id").alias("page_id"), render.html("<body><p>", escaped, "</p></body>").alias("html")
    )
    return pages.page_content(html_trees(rendered)).select("page_id", "key", "line")


_PUNCTUATION_SQL = r"'[!-/:-@\[-`{-~]', '', 'g'"


def _inline_sql(text):
    clean = f"regexp_replace({text}, {_PUNCTUATION_SQL})"
    return f"CASE WHEN length({text}) - length({clean}) < 2 THEN {clean} ELSE ' ' END"


@query(
    "h15_inline_marks",
    rf"""WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))),
                                  '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g')) AS line FROM documents),
             w AS (SELECT doc_id, string_split(line, ' ') AS w FROM l WHERE line <> ''),
             p AS (SELECT doc_id, array_to_string(w[1:4], ' ') AS a, trim(array_to_string(w[5:9], ' ')) AS b,
                          array_to_string(w[10:12], ' ') AS c, array_to_string(w[13:14], ' ') AS d, array_to_string(w[15:], ' ') AS e FROM w),
             t AS (SELECT doc_id, trim(regexp_replace(a || ' ' || {_inline_sql('b')} || ' ' || c || ' ' || {_inline_sql('d')} || ' ' || e,
                                                      ' +', ' ', 'g')) AS line FROM p),
             c AS (SELECT *, regexp_replace(line, {_PUNCTUATION_SQL}) AS clean FROM t)
        SELECT DISTINCT doc_id AS page_id, md5(line) AS key, line FROM c
        WHERE length(line) - length(clean) < 15 AND length(clean) > 40""",
)
def h15_inline(spark, sf):
    """Lines of documents as paragraphs in which some words are marked: a mark inside a mark, and a mark by itself."""
    escaped = F.col("text")
    for raw, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(written))

    def paragraph(words):
        some = lambda at, n: F.array_join(F.slice(words, at, n), " ")
        rest = F.array_join(F.slice(words, F.lit(15), F.greatest(F.size(words), F.lit(1))), " ")
        return render.html(
            "<p>", some(1, 4), " <span>", some(5, 3), " <i>", some(8, 2), "</i></span> ", some(10, 3), " <b>", some(13, 2), "</b> ", rest, "</p>"
        )

    # Each line is squashed and split once: what a function of an element uses several times is an element itself.
    lines = F.filter(F.transform(F.split(escaped, "\n"), squash_spaces), lambda line: line != "")
    body = F.array_join(F.transform(F.transform(lines, lambda line: F.split(line, " ")), paragraph), "")
    rendered = spread(table(spark, sf, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("page_id"), render.html("<body>", body, "</body>").alias("html"))
    return pages.page_content(html_trees(rendered)).select("page_id", "key", "line")
