"""Sources, sinks, the link graph and streams over whole tables."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..operators.aggregates import crawl_progress
from ..operators.graph import crawl_frontier
from ..schemas import CATALOGUE
from ..session import spread, work_folder
from ..plans.crawl import crawl_pages, save_crawl
from ..sources import catalogue, files
from ..streaming.new_keys import read_new_keys, stream_new_keys, write_new_keys
from .registry import query, table


@query(
    "s1_read_listing_csv",
    """SELECT p_partkey::VARCHAR AS "Hotel ID", p_name || ', "' || p_type || '"' || chr(10) || 'x' AS "URL",
              p_brand AS "City", NULL::VARCHAR AS "Hotels" FROM part""",
)
def s1(spark, sf):
    folder = work_folder(spark, "csv")
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("Hotel ID"),
        F.concat("p_name", F.lit(', "'), "p_type", F.lit('"\nx')).alias("URL"),
        F.col("p_brand").alias("City"),
        F.lit(None).cast("string").alias("Hotels"),
    )
    rows.write.csv(folder, header=True, escape='"')
    return files.read_listing_csv(spark, folder)


@query(
    "s1_columns_by_header",
    """SELECT p_partkey::VARCHAR AS "Hotel ID", p_name AS "URL", p_brand AS "City", NULL::VARCHAR AS "Hotels",
              p_size::VARCHAR AS "Stars" FROM part""",
)
def s1_by_header(spark, sf):
    folder = work_folder(spark, "csv")
    rows = table(spark, sf, "part").select(
        F.col("p_brand").alias("City"), F.col("p_size").alias("Stars"), F.col("p_name").alias("URL"), F.col("p_partkey").alias("Hotel ID")
    )
    rows.write.csv(folder, header=True)
    return files.read_listing_csv(spark, folder)


@query("s2_read_literal_lines", "SELECT c_name || '''s, \"x\"' AS name, c_custkey AS key, c_acctbal AS balance, NULL::VARCHAR AS none FROM customer")
def s2(spark, sf):
    folder = work_folder(spark, "literals")
    said = F.concat(
        F.lit("('"), "c_name", F.lit("\\'s, \"x\"', "), F.col("c_custkey").cast("string"), F.lit(", "),
        F.col("c_acctbal").cast("string"), F.lit(", None)"),
    )
    files.write_lines(table(spark, sf, "customer").select(said.alias("value")), folder)
    return files.read_literal_lines(spark, folder, "name STRING, key BIGINT, balance DOUBLE, none STRING")


@query("s3_write_lines", "SELECT p_name || ' ț ' || p_partkey AS value FROM part")
def s3(spark, sf):
    folder = work_folder(spark, "lines")
    files.write_lines(
        table(spark, sf, "part").select(F.concat("p_name", F.lit(" ț "), "p_partkey").alias("item")), folder, "item"
    )
    return spark.read.text(folder)


@query("s4_write_sitemap", "SELECT url || '&a=<1>' AS loc FROM pages")
def s4(spark, sf):
    folder = work_folder(spark, "sitemap")
    files.write_sitemap(table(spark, sf, "pages").select(F.concat("url", F.lit("&a=<1>")).alias("url")), folder)
    return files.read_sitemap(spark, folder)


@query(
    "s5_catalogue",
    """SELECT c_custkey AS id, c_name AS title, c_nationkey::BIGINT AS city_id, c_acctbal AS latitude,
              NULL::VARCHAR AS status, 14::INT AS columns FROM customer""",
)
def s5(spark, sf):
    folder = work_folder(spark, "catalogue")
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("city_id"),
        F.col("c_acctbal").alias("latitude"),
    )
    catalogue.save_table(rows, folder, "booking_listings")
    read = catalogue.load_catalogue(spark, folder, tables=["booking_listings"])["booking_listings"]
    width = F.lit(len(read.columns) if "check" not in CATALOGUE["booking_listings"] else 0)
    return read.select("id", "title", "city_id", "latitude", "status", width.alias("columns"))


def _catalogue(spark, sf):
    """All catalogue tables from region, nation, customer and supplier."""
    customer, supplier = table(spark, sf, "customer"), table(spark, sf, "supplier")
    nation = table(spark, sf, "nation")
    of_nation = nation.select("n_nationkey", F.col("n_regionkey").alias("county_id"))

    def owners(df, prefix, key):
        id_, name, city = F.col(f"{prefix}_{key}"), F.col(f"{prefix}_name"), F.col(f"{prefix}_nationkey")
        placed = df.join(of_nation, city == F.col("n_nationkey"))
        return placed.select(
            id_.alias("id"), F.concat(F.lit(prefix), id_.cast("string")).alias("geo_hash_id"), name.alias("title"), city.alias("city_id"), "county_id"
        )

    lodgings, places = owners(customer, "c", "custkey"), owners(supplier, "s", "suppkey")
    child = lambda df, column: df.select("id", "geo_hash_id", F.lit(column).alias("type"), F.col("title").alias(column))
    return {
        "account_county": table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")),
        "account_city": nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("county_id"), F.col("n_name").alias("name")),
        "booking_listings": lodgings,
        "booking_listings_content": child(lodgings, "content"),
        "booking_listings_facility": child(lodgings, "content"),
        "booking_listings_platform": child(lodgings, "url"),
        "biserici_romania": places,
        "interest_points": places,
        "interest_points_platform": child(places, "url"),
        "interest_points_content": child(places, "content"),
        "interest_points_facility": child(places, "content"),
    }


_SHOWN = {"account_county": "name", "account_city": "name", "booking_listings_platform": "url", "interest_points_platform": "url"}
_LINKED = {"account_county": None, "account_city": "county_id"}
_CATALOGUE_SQL = """SELECT 'account_county' AS name, r_regionkey::BIGINT AS id, NULL::VARCHAR AS link, r_name AS said, 3 AS columns FROM region
   UNION ALL SELECT 'account_city', n_nationkey, n_regionkey::VARCHAR, n_name, 8 FROM nation
   UNION ALL SELECT t.name, c_custkey, 'c' || c_custkey, c_name, t.n FROM customer, (VALUES ('booking_listings', 14),
             ('booking_listings_content', 5), ('booking_listings_facility', 4), ('booking_listings_platform', 6)) t(name, n)
   UNION ALL SELECT t.name, s_suppkey, 's' || s_suppkey, s_name, t.n FROM supplier, (VALUES ('biserici_romania', 14), ('interest_points', 14),
             ('interest_points_content', 5), ('interest_points_facility', 4), ('interest_points_platform', 6)) t(name, n)"""


@query("s5_all_tables", _CATALOGUE_SQL)
def s5_all(spark, sf):
    """All eleven tables, checked, written and read back."""
    folder = work_folder(spark, "catalogue")
    catalogue.save_catalogue(_catalogue(spark, sf), folder)
    shown = []
    for name, df in catalogue.load_catalogue(spark, folder, check=True).items():
        said = _SHOWN.get(name, "content" if "type" in df.columns and name != "booking_listings" else "title")
        link = _LINKED.get(name, "geo_hash_id")
        link = F.lit(None).cast("string") if link is None else F.col(link).cast("string")
        shown.append(df.select(F.lit(name).alias("name"), "id", link.alias("link"), F.col(said).alias("said"), F.lit(len(df.columns)).alias("columns")))
    return functools.reduce(lambda a, b: a.unionByName(b), shown)


@query(
    "s5_key_violations",
    """SELECT 'booking_listings_content' AS "table", 'unknown' AS rule, 'geo_hash_id' AS "column", 'x' || c_custkey % 100 AS value,
              count(*) AS rows FROM customer WHERE c_custkey % 5 = 0 GROUP BY c_custkey % 100
       UNION ALL SELECT 'account_city', 'unknown', 'county_id', '77', count(*) FROM nation WHERE n_regionkey = 2
       UNION ALL SELECT 'interest_points', 'repeated', 'id', s_suppkey::VARCHAR, 2 FROM supplier WHERE s_nationkey < 5
       UNION ALL SELECT 'interest_points', 'missing', 'id', NULL, count(*) FROM supplier WHERE s_nationkey = 7 HAVING count(*) > 0
       UNION ALL SELECT 'booking_listings', 'unknown', 'city_id', '99', count(*) FROM customer WHERE c_nationkey = 3 HAVING count(*) > 0""",
)
def s5_violations(spark, sf):
    tables = _catalogue(spark, sf)
    key = F.col("id")
    tables["booking_listings_content"] = tables["booking_listings_content"].withColumn(
        "geo_hash_id", F.when(key % 5 == 0, F.concat(F.lit("x"), (key % 100).cast("string"))).otherwise(F.col("geo_hash_id"))
    )
    tables["booking_listings"] = tables["booking_listings"].withColumn("city_id", F.when(F.col("city_id") == 3, 99).otherwise(F.nullif("city_id", F.lit(4))))
    tables["account_city"] = tables["account_city"].withColumn("county_id", F.when(F.col("county_id") == 2, 77).otherwise(F.col("county_id")))
    points = tables["interest_points"].withColumn("id", F.when(F.col("city_id") != 7, key))
    tables["interest_points"] = points.unionByName(points.filter("city_id < 5"))
    return catalogue.key_violations(tables)


@query(
    "s6_load_pages",
    """SELECT page_id, CASE WHEN length(html) < 2000 THEN 'failed' ELSE 'ok' END AS part FROM pages""",
)
def s6(spark, sf):
    snapshot = table(spark, sf, "pages").withColumn("status", F.when(F.length("html") < 2000, 404).otherwise(200))
    usable, failed = files.load_pages(snapshot)
    return usable.select("page_id", F.lit("ok").alias("part")).unionByName(
        failed.select("page_id", F.lit("failed").alias("part"))
    )


@query(
    "s7_load_posts",
    """SELECT o_orderkey AS post_id, o_orderstatus AS post_type, o_orderpriority AS title, 'one' AS way FROM orders
         WHERE o_orderstatus = 'F'
       UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority, 'all' FROM orders""",
)
def s7(spark, sf):
    folder = work_folder(spark, "posts")
    files.save_posts(
        table(spark, sf, "orders").select(
            F.col("o_orderkey").alias("post_id"), F.col("o_orderstatus").alias("post_type"),
            F.col("o_orderpriority").alias("title"),
        ),
        folder,
    )
    posts = spark.read.schema("post_id BIGINT, title STRING, post_type STRING").parquet(folder)
    one = files.load_posts(posts, "F").withColumn("way", F.lit("one"))
    return one.unionByName(files.load_posts(posts).withColumn("way", F.lit("all")))


@query("s8_image_inventory", "SELECT DISTINCT 'c_nationkey=' || c_nationkey AS folder FROM customer")
def s8(spark, sf):
    folder = work_folder(spark, "images")
    table(spark, sf, "customer").select("c_nationkey", F.col("c_name").alias("value")).write.partitionBy(
        "c_nationkey"
    ).text(folder)
    found = files.image_inventory(spark, folder).filter("length > 0 AND path LIKE '%/part-%'")
    return found.select(F.substring_index("path", "/", 1).alias("folder")).distinct()


@query(
    "s8_image_lengths",
    """SELECT 'c_nationkey=' || c_nationkey AS folder, sum(length(c_name) + 1)::BIGINT AS bytes
       FROM customer GROUP BY c_nationkey""",
)
def s8_lengths(spark, sf):
    folder = work_folder(spark, "images")
    table(spark, sf, "customer").select("c_nationkey", F.col("c_name").alias("value")).write.partitionBy(
        "c_nationkey"
    ).text(folder)
    found = files.image_inventory(spark, folder).filter("path LIKE '%/part-%'")
    return found.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.sum("length").alias("bytes"))


def crawl(spark, sf):
    """customer keys as pages in a tree with eight links each, links back to the root and bad links."""
    key = F.col("c_custkey")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    address = lambda k: F.concat(F.lit("http://h.ro/p"), k.cast("string"), F.lit(".html"))
    parent = F.floor((key - 1) / 8)
    down = customer.filter("c_custkey > 0").select(
        address(parent).alias("src"),
        F.when(key % 2 == 0, address(key)).otherwise(F.concat(F.lit("../p"), key.cast("string"), F.lit(".html"))).alias("dst"),
    )
    back = customer.select(address(key).alias("src"), F.lit("../p0.html").alias("dst"))
    bad = customer.select(address(key).alias("src"), F.explode(F.array(F.lit("/p1.html"), F.lit("../p.pdf"), F.lit("http://a.ro/x.html"))).alias("dst"))
    failed = customer.filter("c_nationkey = 24").select(address(key).alias("url"))
    seeds = customer.filter("c_custkey = 0").select(address(key).alias("url"))
    return crawl_frontier(spark, down.unionByName(back).unionByName(bad), seeds, "http://h.ro/", failed)


_CRAWL_SQL = """WITH RECURSIVE v AS (
         SELECT c_custkey, c_nationkey, 0 AS round FROM customer WHERE c_custkey = 0
         UNION ALL
         SELECT c.c_custkey, c.c_nationkey, v.round + 1 FROM v JOIN customer c ON (c.c_custkey - 1) // 8 = v.c_custkey
         WHERE c.c_custkey > 0 AND v.c_nationkey <> 24)"""


@query(
    "g1_crawl_frontier",
    f"{_CRAWL_SQL} SELECT 'http://h.ro/p' || c_custkey || '.html' AS url, c_nationkey <> 24 AS ok, round FROM v",
)
def g1(spark, sf):
    return crawl(spark, sf).select("url", "ok", "round")


_STORED_SQL = """WITH RECURSIVE v(k, round) AS (
         SELECT 0::BIGINT, 0 UNION ALL
         SELECT 8 * v.k + i, round + 1 FROM v JOIN customer ON c_custkey = v.k AND c_nationkey <> 24, range(1, 9) t(i)),
       w AS (SELECT 'http://h.ro/p' || k || '.html' AS url, coalesce(c_nationkey <> 24, false) AS ok, round
             FROM v LEFT JOIN customer ON c_custkey = k)"""


def stored_pages(spark, sf):
    """customer keys as stored pages with links to eight others; pages of one nation have status 404, of another 301."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    links = F.transform(
        F.sequence(8 * key + 1, 8 * key + 8), lambda k: F.concat(F.lit('<li><a class=x href="../p'), k.cast("string"), F.lit('.html">go</a>'))
    )
    return spread(table(spark, sf, "customer")).select(
        F.concat(F.lit("http://h.ro/p"), key.cast("string"), F.lit(".html")).alias("url"),
        F.when(nation == 24, 404).when(nation == 3, 301).otherwise(200).alias("status"),
        F.concat(F.lit("<html><body><a href='http://a.ro/x.html'>out</a><a name=top>top</a><ul>"), F.array_join(links, ""),
                 F.lit("</ul><p><a href=../p0.html>home</a> <a href='../p.pdf'>print</a></body></html>")).alias("html"),
    )


def _stored_crawl(spark, sf):
    seeds = spark.createDataFrame([("http://h.ro/p0.html",)], "url string")
    return crawl_pages(spark, stored_pages(spark, sf), seeds, "http://h.ro/")


@query("g1_crawl_stored_pages", f"{_STORED_SQL} SELECT url, ok, round FROM w")
def g1_stored(spark, sf):
    return _stored_crawl(spark, sf).select("url", "ok", "round")


@query("s4_crawl_sitemap", f"{_STORED_SQL} SELECT DISTINCT url AS loc FROM w WHERE ok")
def s4_crawl(spark, sf):
    folder = work_folder(spark, "crawled")
    save_crawl(_stored_crawl(spark, sf), folder)
    return files.read_sitemap(spark, f"{folder}/sitemap")


@query(
    "a10_crawl_progress",
    f"""{_CRAWL_SQL} SELECT round, count(*) AS queued, count(*) FILTER (c_nationkey <> 24) AS visited,
          count(*) FILTER (c_nationkey = 24) AS failed FROM v GROUP BY round""",
)
def a10(spark, sf):
    return crawl_progress(crawl(spark, sf))


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("t1_stream_new_keys", "SELECT DISTINCT user_id, event_type FROM events")
def t1(spark, sf):
    folder = work_folder(spark, "stream")
    fresh = stream_new_keys(event_stream(spark, sf).select("user_id", "event_type"), ["user_id", "event_type"])
    writer = fresh.writeStream.format("parquet").option("path", f"{folder}/out")
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id BIGINT, event_type STRING").parquet(f"{folder}/out")


@query("t1_write_new_keys", "SELECT DISTINCT user_id FROM events")
def t1_table(spark, sf):
    folder = work_folder(spark, "stream")
    write_new_keys(event_stream(spark, sf), ["user_id"], f"{folder}/out", f"{folder}/state").awaitTermination()
    return read_new_keys(spark, f"{folder}/out", "user_id BIGINT").select("user_id")
