"""Lookups and matches over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import joins
from .registry import query, table


def cities(spark, sf):
    """nation as the city table, with names of two words for some."""
    nation = table(spark, sf, "nation")
    spaced = F.replace("n_name", F.lit("_"), F.lit(" "))
    return nation.select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.when(F.col("n_nationkey") < 12, spaced).otherwise(F.replace("n_name", F.lit("_"), F.lit("-"))).alias("name"),
        F.col("n_regionkey").cast("bigint").alias("county_id"),
    )


def counties(spark, sf):
    return table(spark, sf, "region").select(
        F.col("r_regionkey").cast("bigint").alias("id"),
        F.initcap("r_name").alias("name"),
        F.substring("r_name", 1, 2).alias("code"),
    )


CITY_SQL = """city AS (SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS county_id,
                replace(n_name, '_', CASE WHEN n_nationkey < 12 THEN ' ' ELSE '-' END) AS name FROM nation)"""


@query(
    "j1_with_children",
    """SELECT o_orderkey, 0::BIGINT AS chunk, count(l_orderkey) AS child_count, min(l_partkey) AS lowest,
              max(l_partkey) AS highest, coalesce(string_agg(l_linenumber || ':' || l_partkey, ','
                ORDER BY l_linenumber, l_partkey), '') AS listed
       FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def j1(spark, sf):
    parents = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    children = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey")
    nested = joins.with_children(parents, children, "key", 1000, ["l_linenumber", "l_partkey"])
    listed = F.transform(
        "children", lambda c: F.concat_ws(":", c["l_linenumber"].cast("string"), c["l_partkey"].cast("string"))
    )
    keys = F.transform("children", lambda c: c["l_partkey"])
    return nested.select(
        F.col("key").alias("o_orderkey"),
        "chunk",
        F.size("children").cast("bigint").alias("child_count"),
        F.array_min(keys).alias("lowest"),
        F.array_max(keys).alias("highest"),
        F.array_join(listed, ",").alias("listed"),
    )


@query(
    "j2_with_dimensions",
    f"""WITH {CITY_SQL} SELECT c_custkey, name AS city_name, r_name[1] || lower(r_name[2:]) AS county_name,
              r_name[1:2] AS county_code FROM customer
        LEFT JOIN city ON id = c_nationkey LEFT JOIN region ON r_regionkey = county_id""",
)
def j2(spark, sf):
    facts = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("city_id"))
    regions = counties(spark, sf).withColumn("name", F.concat(F.substring("name", 1, 1), F.lower(F.expr("substr(name, 2)"))))
    return joins.with_dimensions(facts, cities(spark, sf), regions).select(
        "c_custkey", "city_name", "county_name", "county_code"
    )


@query(
    "j3_resolve_county",
    """SELECT c_custkey, 'name' AS way, r_regionkey::BIGINT AS county_id, r_regionkey IS NOT NULL AS county_found
       FROM customer JOIN nation ON n_nationkey = c_nationkey
       LEFT JOIN region ON r_regionkey = n_regionkey AND c_mktsegment <> 'BUILDING'
       UNION ALL
       SELECT c_custkey, 'code', n_regionkey::BIGINT, true
       FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def j3(spark, sf):
    rows = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_mktsegment", "r_name")
    )
    said = F.when(F.col("c_mktsegment") == "BUILDING", "Nicăieri").otherwise(
        F.replace("r_name", F.lit("A"), F.lit("Ă"))
    )
    by_name = joins.resolve_county(rows, counties(spark, sf), name=said).withColumn("way", F.lit("name"))
    by_code = joins.resolve_county(rows, counties(spark, sf), code=F.substring("r_name", 1, 2)).withColumn(
        "way", F.lit("code")
    )
    return by_name.unionByName(by_code).select("c_custkey", "way", "county_id", "county_found")


_J4_SQL = f"""WITH {CITY_SQL},
         s AS (SELECT c_custkey, lower(CASE WHEN c_mktsegment = 'BUILDING' THEN 'ation-' || c_nationkey
                 WHEN c_mktsegment = 'MACHINERY' THEN 'TION' ELSE 'none' END) AS said,
                 CASE WHEN c_acctbal < 0 THEN 2 ELSE n_regionkey END AS county
               FROM customer JOIN nation ON n_nationkey = c_nationkey),
         m AS (SELECT c_custkey, min(a.id) AS first, min(b.id) AS second FROM s
               LEFT JOIN city a ON a.county_id = county AND contains(lower(a.name), said)
               LEFT JOIN city b ON b.county_id = county AND contains(lower(b.name), replace(said, '-', ' '))
               GROUP BY c_custkey)
        SELECT c_custkey, coalesce(first, second) AS city_id FROM m"""


@query("j4_resolve_city", _J4_SQL)
def j4(spark, sf):
    return _city_of_text(spark, sf, cities(spark, sf))


@query("j4_accented_names", _J4_SQL)
def j4_accents(spark, sf):
    return _city_of_text(spark, sf, accented(cities(spark, sf)))


def accented(city):
    """The same cities with accents in their names, of both forms in use."""
    return city.withColumn("name", F.translate("name", "AINRST", "ĂÎŃŔȘŢ"))


def _city_of_text(spark, sf, city):
    said = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("ATION-"), F.col("c_nationkey").cast("string")))
        .when(F.col("c_mktsegment") == "MACHINERY", "TION")
        .otherwise("none")
    )
    rows = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey", said.alias("said"),
            F.when(F.col("c_acctbal") >= 0, F.col("n_regionkey").cast("bigint")).alias("county"),
        )
    )
    found = joins.resolve_city(
        rows, city, F.col("said"), F.col("county"), F.lit(2).cast("bigint")
    )
    return found.select("c_custkey", "city_id")


_J5_SQL = f"""WITH {CITY_SQL},
         s AS (SELECT c_custkey, n_regionkey AS county, lower(n_name[1:6]) || '-' AS said
               FROM customer JOIN nation ON n_nationkey = c_nationkey)
        SELECT c_custkey, min(id) AS city_id FROM s
        LEFT JOIN city ON county_id = county AND contains(lower(name), said) GROUP BY c_custkey"""


@query("j5_resolve_city_prefix", _J5_SQL)
def j5(spark, sf):
    return _city_of_prefix(spark, sf, cities(spark, sf))


@query("j5_accented_names", _J5_SQL)
def j5_accents(spark, sf):
    return _city_of_prefix(spark, sf, accented(cities(spark, sf)))


def _city_of_prefix(spark, sf, city):
    rows = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    rows = rows.select(
        "c_custkey", F.replace("n_name", F.lit("_"), F.lit("-Sat-")).alias("said"),
        F.col("n_regionkey").cast("bigint").alias("county"),
    )
    found = joins.resolve_city_prefix(rows, city, F.col("said"), F.col("county"))
    return found.select("c_custkey", "city_id")


@query(
    "j6_skip_known",
    """SELECT * FROM customer WHERE c_custkey NOT IN
         (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')""",
)
def j6(spark, sf):
    known = table(spark, sf, "orders").filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
    return joins.skip_known(table(spark, sf, "customer"), known.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(
    "j7_match_points",
    """WITH r AS (SELECT c_custkey, c_custkey % 40 AS a, c_nationkey AS b FROM customer),
            p AS (SELECT s_suppkey, s_suppkey % 40 AS a, s_nationkey AS b FROM supplier)
       SELECT c_custkey, count(s_suppkey) > 0 AS points_here,
              count(CASE WHEN s_suppkey % 7 = c_custkey % 7 THEN 1 END) AS matches,
              min(CASE WHEN s_suppkey % 7 = c_custkey % 7 THEN s_suppkey END) AS point_id
       FROM r LEFT JOIN p ON r.a = p.a AND r.b = p.b GROUP BY c_custkey""",
)
def j7(spark, sf):
    def spot(key, nation):
        return [
            (45 + (F.col(key) % 40) / 1000.0).alias("latitude"),
            F.lit(25.5).alias("longitude"),
            F.col(nation).cast("bigint").alias("city_id"),
        ]

    rows = table(spark, sf, "customer").select(
        "c_custkey", *spot("c_custkey", "c_nationkey"), F.concat(F.lit("/p"), (F.col("c_custkey") % 7).cast("string")).alias("url")
    )
    supplier = table(spark, sf, "supplier")
    points = supplier.select(
        F.col("s_suppkey").alias("id"), F.sha2("s_name", 256).alias("geo_hash_id"), *spot("s_suppkey", "s_nationkey")
    )
    urls = F.array(
        F.struct(F.lit(1).alias("k"), F.concat(F.lit("places.example/p"), (F.col("s_suppkey") % 7).cast("string")).alias("url")),
        F.struct(F.lit(2).alias("k"), F.lit("elsewhere").alias("url")),
    )
    platforms = supplier.select(
        F.sha2("s_name", 256).alias("geo_hash_id"), "s_suppkey", F.explode(urls).alias("u")
    ).select("geo_hash_id", (F.col("s_suppkey") * 10 + F.col("u.k")).alias("id"), "u.url")
    matched = joins.match_points(rows, points, platforms, "places.example")
    return matched.select("c_custkey", "points_here", "matches", "point_id")


@query(
    "j8_match_with_fallback",
    """WITH p AS (SELECT c_custkey, c_custkey % 900 AS spot, c_name AS title FROM customer),
            o AS (SELECT o_orderkey, o_custkey * 2 AS spot, 'Customer#' || lpad((o_custkey + 100)::VARCHAR, 9, '0') AS title
                  FROM orders),
            s AS (SELECT spot, min(c_custkey) AS id FROM p GROUP BY spot),
            t AS (SELECT title, min(c_custkey) AS id FROM p GROUP BY title)
       SELECT o_orderkey, coalesce(s.id, t.id) AS point_id, CASE WHEN s.id IS NOT NULL THEN 'coordinates'
              WHEN t.id IS NOT NULL THEN 'title' ELSE 'missing' END AS match_kind
       FROM o LEFT JOIN s ON s.spot = o.spot LEFT JOIN t ON t.title = o.title""",
)
def j8(spark, sf):
    points = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("title"),
        (F.col("c_custkey") % 900 / 1000.0).alias("latitude"), F.lit(25.0).alias("longitude"),
    )
    posts = table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") + 100).cast("string"), 9, "0")).alias("title"),
        (F.col("o_custkey") * 2 / 1000.0).alias("latitude"), F.lit(25.0).alias("longitude"),
    )
    return joins.match_with_fallback(posts, points).select("o_orderkey", "point_id", "match_kind")


def spots(part, name, shift=0.0):
    """part on a grid of points about 5 m apart, as dense for a large table as for a small one."""
    row, column = F.floor(F.col("p_partkey") / 100), F.col("p_partkey") % 100
    return part.select(
        F.col("p_partkey").alias("id"),
        name.alias("name"),
        (45.0 + row * 0.00005 + F.lit(shift)).alias("latitude"),
        (25.0 + column * 0.00007).alias("longitude"),
    )


@query(
    "j9_nearby_pairs",
    """WITH g AS (SELECT p_partkey, p_name, 45.0::DOUBLE + (p_partkey // 100) * 0.00005::DOUBLE AS lat,
                         25.0::DOUBLE + (p_partkey % 100) * 0.00007::DOUBLE AS lon FROM part),
            b AS (SELECT p_name || 's' AS p_name, lat + 0.00002::DOUBLE AS lat, lon FROM g),
            n AS (SELECT g.p_name AS left_name, b.p_name AS right_name,
                    2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.lat - g.lat) / 2), 2)
                      + cos(radians(g.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - g.lon) / 2), 2))) AS metres
                  FROM g JOIN b ON b.lat BETWEEN g.lat - 0.001 AND g.lat + 0.001
                    AND b.lon BETWEEN g.lon - 0.001 AND g.lon + 0.001
                  WHERE 2.0 * least(length(g.p_name), length(b.p_name))
                        / (length(g.p_name) + length(b.p_name)) > 0.8)
       SELECT left_name, right_name, round(metres, 3) AS metres FROM n WHERE metres <= 10""",
)
def j9_pairs(spark, sf):
    part = table(spark, sf, "part")
    pairs = joins.nearby_pairs(
        spots(part, F.col("p_name")), spots(part, F.concat("p_name", F.lit("s")), 0.00002)
    )
    return pairs.select("left_name", "right_name", F.round("metres", 3).alias("metres"))


@query("j9_match_nearby")
def j9(spark, sf):
    part = table(spark, sf, "part")
    right = spots(part, F.concat("p_name", F.lit("s")), 0.00002).withColumn("place_id", F.concat(F.lit("p"), "id"))
    matched = joins.match_nearby(spots(part, F.col("p_name")), right)
    return matched.select("left_id", "right_id", "place_id", F.round("ratio", 6).alias("ratio"))


@query(
    "j9_match_built_names",
    """WITH p AS (SELECT p_partkey, length(p_name) AS l, p_partkey % 12 AS k FROM part)
       SELECT p_partkey AS left_id, p_partkey AS right_id, round(2.0::DOUBLE * l / (2 * l + k), 6) AS ratio
       FROM p WHERE 2.0::DOUBLE * l / (2 * l + k) > 0.8""",
)
def j9_built(spark, sf):
    """Names and themselves with letters added that occur in neither, each pair at a place of its own."""
    part = table(spark, sf, "part").withColumn("k", (F.col("p_partkey") % 12).cast("int"))
    at = [
        F.col("p_partkey").alias("id"),
        (40.0 + (F.col("p_partkey") % 1000) * 0.001).alias("latitude"),
        (20.0 + F.floor(F.col("p_partkey") / 1000) * 0.001).alias("longitude"),
    ]
    left = part.select(*at, F.col("p_name").alias("name"))
    right = part.select(*at, F.concat("p_name", F.repeat(F.lit("Z"), F.col("k"))).alias("name"))
    return joins.match_nearby(left, right).select("left_id", "right_id", F.round("ratio", 6).alias("ratio"))


@query(
    "j10_find_term",
    """WITH t AS (SELECT p_name AS name, p_brand AS taxonomy, p_partkey AS term_id FROM part),
            f AS (SELECT name, min((taxonomy, term_id)) AS term FROM t GROUP BY name),
            o AS (SELECT name, min(term_id) AS term_id FROM t WHERE taxonomy = 'Brand#7' GROUP BY name)
       SELECT p_partkey, f.term[2] AS any_term, f.term[1] AS any_taxonomy, o.term_id AS one_term
       FROM part LEFT JOIN f ON f.name = p_name LEFT JOIN o ON o.name = p_name""",
)
def j10(spark, sf):
    part = table(spark, sf, "part")
    terms = part.select(
        F.col("p_brand").alias("taxonomy"), F.col("p_partkey").alias("term_id"), F.col("p_name").alias("name")
    )
    rows = part.select("p_partkey", "p_name")
    found = joins.find_term(rows, terms, F.col("p_name")).withColumnsRenamed(
        {"term_id": "any_term", "term_taxonomy": "any_taxonomy"}
    )
    found = joins.find_term(found, terms, F.col("p_name"), "Brand#7")
    return found.select("p_partkey", "any_term", "any_taxonomy", F.col("term_id").alias("one_term"))


def photo_points(spark, sf):
    """customer as points with names, and image files in the new or the old layout for some of them."""
    points = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), "c_nationkey",
            F.col("n_name").alias("city_name"), F.col("r_name").alias("county_name"), "c_acctbal",
        )
    )
    numbers = F.explode(F.sequence(F.lit(1), F.col("c_nationkey") % 4 + 1)).alias("k")
    county, city, title = F.col("county_name"), F.col("city_name"), F.col("title")
    file = F.concat(F.lit("/"), F.col("k").cast("string"), F.lit(".jpg"))
    new = points.filter("c_nationkey < 10").select("*", numbers).select(
        F.concat(geo.place_path(county, city, title), file).alias("path"), F.lit(1000).alias("length"),
        (F.col("c_nationkey") * 60 + 300).alias("width"), (F.col("k") * 400).alias("height"),
    )
    old = points.filter("c_nationkey BETWEEN 5 AND 14").select("*", numbers).select(
        F.concat(geo.old_place_path(city, title), file).alias("path"), F.lit(1000).alias("length"),
        F.lit(900).alias("width"), (F.col("k") * 400).alias("height"),
    )
    return points, new, old


@query(
    "j11_join_photos",
    """SELECT c_custkey AS id, c_nationkey BETWEEN 10 AND 14 AS moved,
              CASE WHEN c_nationkey < 10 THEN replace(lower(r_name), ' ', '-') || '/' ||
                     replace(lower(n_name), '_', '-') || '/' || n_name || ' - ' || c_name
                   WHEN c_nationkey < 15 THEN replace(lower(n_name), '_', '-') || '/' ||
                     replace(replace(lower(n_name || '-' || c_name), '_', '-'), '#', '-') END AS photo_folder,
              (CASE WHEN c_nationkey < 15 THEN c_nationkey % 4 + 1 ELSE 0 END)::BIGINT AS file_count
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def j11(spark, sf):
    points, new, old = photo_points(spark, sf)
    return joins.join_photos(points, new, old).select("id", "moved", "photo_folder", "file_count")


@query(
    "j12_join_first_term",
    """SELECT o_orderkey, o_custkey AS first_term_id, c_name AS location
       FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey < 20""",
)
def j12(spark, sf):
    from ..functions.records import decode_id_list, encode_id_list

    packed = encode_id_list(F.array("o_custkey", "o_orderkey"))
    posts = table(spark, sf, "orders").select("o_orderkey", packed.alias("city"))
    terms = table(spark, sf, "customer").select(
        F.when(F.col("c_nationkey") < 20, "locations").otherwise("tags").alias("taxonomy"),
        F.col("c_custkey").alias("term_id"), F.col("c_name").alias("name"),
    )
    return joins.join_first_term(posts, terms, decode_id_list(F.col("city"))).select(
        "o_orderkey", "first_term_id", "location"
    )
