"""Filters, windows, paging and set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.records import first_valid_address, unpack_json
from ..operators import paging, select, sets, windows
from ..operators.html import html_trees
from ..operators.pages import page_links
from .registry import query, table
from .scalars import components


@query(
    "f1_select_match",
    """SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
       UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, NULL FROM orders
       WHERE o_orderpriority = '5-LOW'""",
)
def f1(spark, sf):
    orders = table(spark, sf, "orders")
    equal = select.select_rows(orders, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    emptied = orders.withColumn(
        "o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    )
    return equal.unionByName(select.select_rows(emptied, {"o_orderpriority": None}))


@query("f2_select_like", "SELECT * FROM customer WHERE c_mktsegment ILIKE '%build%' AND c_nationkey = 3")
def f2(spark, sf):
    return select.select_rows(table(spark, sf, "customer"), {"c_mktsegment": "build", "c_nationkey": 3}, "like")


@query(
    "f3_select_exclude",
    """SELECT c_custkey, c_mktsegment FROM customer
       WHERE c_mktsegment NOT ILIKE '%mach%' AND c_nationkey IS DISTINCT FROM 3""",
)
def f3(spark, sf):
    match = {"c_mktsegment": "mach", "c_nationkey": 3}
    return select.select_rows(table(spark, sf, "customer"), match, "exclude", ["c_custkey", "c_mktsegment"])


@query("f4_select_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def f4(spark, sf):
    return select.select_rows(table(spark, sf, "orders"), columns=["o_orderkey", "o_totalprice"])


@query(
    "f5_select_limit",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 25",
)
def f5(spark, sf):
    return select.select_rows(
        table(spark, sf, "orders"), {"o_orderstatus": "O"}, columns=["o_orderkey", "o_custkey"], limit=25,
        order="o_orderkey",
    )


@query(
    "f6_first_row",
    """(SELECT 'match' AS mode, * FROM customer WHERE c_mktsegment = 'FURNITURE' ORDER BY c_custkey LIMIT 1)
       UNION ALL (SELECT 'like', * FROM customer WHERE c_mktsegment ILIKE '%auto%' ORDER BY c_custkey LIMIT 1)
       UNION ALL (SELECT 'exclude', * FROM customer WHERE c_mktsegment NOT ILIKE '%o%' ORDER BY c_custkey LIMIT 1)""",
)
def f6(spark, sf):
    customer = table(spark, sf, "customer")
    found = [
        select.first_row(customer, {"c_mktsegment": value}, mode, order="c_custkey").select(
            F.lit(mode).alias("mode"), "*"
        )
        for mode, value in (("match", "FURNITURE"), ("like", "auto"), ("exclude", "o"))
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "f7_valid_links",
    r"""WITH l AS (SELECT page_id, url AS page, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS root FROM pages),
             c AS (SELECT page_id, page, unnest([page, root || '/a.html#x.y.z', root || '/a.pdf', root,
                          root || '/b.php5?q=a.b', '/The', root || '/x/a.b.c.htm', 'http://a.ro/i.html']) AS url FROM l),
             f AS (SELECT *, string_split(url, '#')[1] AS cut,
                          regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM c)
        SELECT page_id, url FROM f
        WHERE length(cut) - length(replace(cut, '.', '')) <= 3 AND host <> '' AND contains(page, host)
          AND NOT (regexp_matches(cut, '\.\w+$') AND NOT regexp_matches(cut, '\.(htm|php)\w*$'))""",
)
def f7(spark, sf):
    page, root = F.col("url"), F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)
    tails = ["/a.html#x.y.z", "/a.pdf", "", "/b.php5?q=a.b"]
    links = F.array(
        page, *[F.concat(root, F.lit(t)) for t in tails], F.lit("/The"), F.concat(root, F.lit("/x/a.b.c.htm")),
        F.lit("http://a.ro/i.html"),
    )
    rows = table(spark, sf, "pages").select("page_id", page.alias("page"), F.explode(links).alias("url"))
    return select.valid_links(rows, F.col("page")).select("page_id", "url")


@query(
    "f8_quality_lines",
    r"""WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))),
                                  '[\s\x0b\x{85}\p{Z}]+', ' ', 'g')) AS line FROM documents),
             c AS (SELECT *, regexp_replace(line, '[!-/:-@\[-`{-~]', '', 'g') AS clean FROM l)
        SELECT doc_id, line FROM c WHERE length(line) - length(clean) < 15 AND length(clean) > 40""",
)
def f8(spark, sf):
    return select.quality_lines(table(spark, sf, "documents").select("doc_id", "text"))


@query(
    "f9_needs_enrichment",
    """SELECT c_custkey, true AS needs_address, c_nationkey < 10 AS needs_key FROM customer
       WHERE c_mktsegment <> 'BUILDING' AND c_acctbal < 3000""",
)
def f9(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", "fixed").otherwise("new").alias("stage"),
        F.when(F.col("c_acctbal") >= 3000, F.col("c_name")).alias("address"),
        F.col("c_nationkey").alias("city_id"),
        F.when(F.col("c_nationkey") >= 10, F.md5("c_name")).alias("geo_hash_id"),
    )
    return select.needs_enrichment(rows).select("c_custkey", "needs_address", "needs_key")


@query(
    "f10_filter_components",
    """SELECT c_custkey, 4::BIGINT AS kept, c_mktsegment || ',' || c_name || ',' || n_name || ',' || r_name AS names
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def f10(spark, sf):
    rows = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    built = components(F.col("c_mktsegment"), F.col("c_name"), F.col("n_name"), F.col("r_name"))
    kept = select.keep_address_components(rows.select("c_custkey", built.alias("address_components")))
    parts = F.col("address_components")
    return kept.select(
        "c_custkey",
        F.size(parts).cast("bigint").alias("kept"),
        F.array_join(F.transform(parts, lambda p: p["short_name"]), ",").alias("names"),
    )


@query(
    "w1_first_per_key",
    """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER
         (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1""",
)
def w1(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return windows.first_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "w2_top_k_per_key",
    """SELECT l_partkey, n, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey
         ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey)::INT AS n FROM lineitem) WHERE n <= 10""",
)
def w2(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_suppkey"]
    return windows.top_k_per_key(rows, ["l_partkey"], order, 10, rank="n").drop("l_linenumber", "l_suppkey")


@query(
    "w3_number_within",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (row_number() OVER (PARTITION BY l_orderkey
         ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::BIGINT AS n FROM lineitem""",
)
def w3(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return windows.number_within(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).withColumn(
        "n", F.col("n").cast("bigint")
    )


@query(
    "w4_first_valid_address",
    """SELECT c_custkey, '{"route":"Calea ' || c_custkey || '","locality":"' || n_name ||
         '","administrative_area_level_1":"' || r_name || '","country":"RO"}' AS address
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def w4(spark, sf):
    rows = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    street = F.concat(F.lit("Calea "), F.col("c_custkey").cast("string"))
    candidates = F.array(
        *[
            F.struct(components(street, city, county, F.lit("RO")).alias("address_components"))
            for city, county in (
                (F.lit("elsewhere"), F.col("r_name")),
                (F.col("n_name"), F.lit("elsewhere")),
                (F.col("n_name"), F.col("r_name")),
                (F.concat(F.col("n_name"), F.lit(" Nord")), F.col("r_name")),
            )
        ]
    )
    text = rows.select("c_custkey", "n_name", "r_name", F.to_json(candidates).alias("body"))
    schema = "array<struct<address_components:array<struct<types:array<string>,short_name:string>>>>"
    found = first_valid_address(unpack_json(F.col("body"), schema), F.col("n_name"), F.col("r_name"))
    return text.select("c_custkey", found.alias("address"))


@query(
    "l1_page_urls",
    """WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey),
            p AS (SELECT c_nationkey, unnest(range(n // 20 + 1)) AS page_no FROM c)
       SELECT c_nationkey, page_no, 'http://h.ro/' || c_nationkey || '&start=' || page_no * 20 || '&order=' AS page_url
       FROM p""",
)
def l1(spark, sf):
    counts = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("count"))
    plan = counts.withColumn("url", F.concat(F.lit("http://h.ro/"), F.col("c_nationkey").cast("string")))
    return paging.page_urls(plan).select("c_nationkey", "page_no", "page_url")


@query("l2_offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def l2(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return paging.offset_page(orders, "o_orderkey", offset=40)


@query(
    "l2_paged",
    """SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 20)::BIGINT AS page_no FROM orders""",
)
def l2_paged(spark, sf):
    return paging.paged(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("l3_collect_pages", "SELECT s_nationkey, s_name AS name, 'p' || s_suppkey AS place_id FROM supplier")
def l3(spark, sf):
    supplier = table(spark, sf, "supplier").withColumn("page_no", F.floor(F.col("s_suppkey") / 20))
    result = F.struct(
        F.col("s_name").alias("name"), F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("place_id")
    )
    # A rendered response holds at most the 20 suppliers of a key range.
    rendered = supplier.groupBy("s_nationkey", "page_no").agg(F.collect_list(result).alias("results"))
    responses = rendered.select(
        "s_nationkey", "page_no",
        F.to_json(
            F.struct(
                F.lit("OK").alias("status"),
                F.concat(F.lit("t"), F.col("page_no").cast("string")).alias("next_page_token"),
                "results",
            )
        ).alias("body"),
    )
    empty = rendered.select("s_nationkey", "page_no", F.lit('{"status":"ZERO_RESULTS","results":[]}').alias("body"))
    return paging.collect_pages(responses.unionByName(empty)).select("s_nationkey", "name", "place_id")


_HREF_SQL = """SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS url FROM pages"""


def _hrefs(spark, sf):
    trees = html_trees(table(spark, sf, "pages").select("page_id", "html"))
    return page_links(trees).select("page_id", F.col("href").alias("url"))


@query("a6_distinct_urls", f"SELECT DISTINCT url FROM ({_HREF_SQL})")
def a6(spark, sf):
    return sets.distinct_urls(_hrefs(spark, sf))


@query("u1_union_urls", f"SELECT url FROM ({_HREF_SQL}) UNION SELECT url FROM pages")
def u1(spark, sf):
    return sets.union_urls(_hrefs(spark, sf), table(spark, sf, "pages"))


@query(
    "u2_unvisited",
    """SELECT c_custkey AS key, c_name FROM customer
       WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def u2(spark, sf):
    queue = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return sets.unvisited(queue, urgent.select(F.col("o_custkey").alias("key")), "key")


@query(
    "u3_platform_rows",
    """SELECT c_name AS platform, 'u' || c_custkey AS url, c_acctbal::VARCHAR AS avg_price FROM customer
       UNION ALL SELECT s_name, 's' || s_suppkey, NULL FROM supplier
       UNION ALL SELECT p_brand, NULL, p_retailprice::VARCHAR FROM part""",
)
def u3(spark, sf):
    own = table(spark, sf, "customer").select(
        F.col("c_name").alias("platform"),
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("url"),
        F.col("c_acctbal").cast("string").alias("avg_price"),
    )
    maps = table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("url"), F.col("s_name").alias("platform")
    )
    search = table(spark, sf, "part").select(
        F.col("p_retailprice").cast("string").alias("avg_price"), F.col("p_brand").alias("platform")
    )
    return sets.platform_rows(own, maps, search)
