"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, records, text, web
from .registry import query, table


def _next_part(spark, sf):
    part = table(spark, sf, "part")
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    return part.select("p_partkey", "p_name").join(following, "p_partkey")


@query(
    "x1_edit_distance",
    """SELECT a.p_partkey, levenshtein(a.p_name, b.p_name)::INT AS distance
       FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""",
)
def x1(spark, sf):
    return _next_part(spark, sf).select(
        "p_partkey", text.edit_distance(F.col("p_name"), F.col("next_name")).alias("distance")
    )


@query("x2_similarity")
def x2(spark, sf):
    pairs = _next_part(spark, sf)
    bound = text.similarity_bound(F.col("p_name"), F.col("next_name"))
    return pairs.select(
        "p_partkey",
        F.round(bound, 6).alias("bound"),
        F.round(text.similarity(F.col("p_name"), F.col("next_name")), 6).alias("ratio"),
    )


@query(
    "x2_similarity_built",
    """WITH p AS (SELECT p_partkey, length(p_name) AS l, p_partkey % 17 AS k, 1 + p_partkey % 7 AS i, 1 + p_partkey % 11 AS j FROM part)
       SELECT p_partkey, round(2.0::DOUBLE * l / (2 * l + k), 6) AS padded,
              round(greatest(i, j)::DOUBLE / (i + j), 6) AS swapped, 0.0::DOUBLE AS apart FROM p""",
)
def x2_built(spark, sf):
    """Ratios that follow from how names are made: letters of neither added, halves swapped, no letter shared."""
    key = F.col("p_partkey")
    made = table(spark, sf, "part").select(
        "p_partkey",
        "p_name",
        F.concat("p_name", F.repeat(F.lit("Z"), (key % 17).cast("int"))).alias("longer"),
        F.repeat(F.lit("x"), (1 + key % 7).cast("int")).alias("x"),
        F.repeat(F.lit("y"), (1 + key % 11).cast("int")).alias("y"),
    )
    return made.select(
        "p_partkey",
        F.round(text.similarity(F.col("p_name"), F.col("longer")), 6).alias("padded"),
        F.round(text.similarity(F.concat("x", "y"), F.concat("y", "x")), 6).alias("swapped"),
        text.similarity(F.col("x"), F.col("y")).alias("apart"),
    )


@query(
    "x3_hash_key",
    """SELECT page_id, sha256('(' || page_id || ', ''' || url || ''', None)') AS key,
              sha256('(''' || url || ''',)') AS single FROM pages""",
)
def x3(spark, sf):
    missing = F.lit(None).cast("string")
    return table(spark, sf, "pages").select(
        "page_id",
        records.hash_key((F.col("page_id"), "number"), (F.col("url"), "text"), (missing, "text")).alias("key"),
        records.hash_key((F.col("url"), "text")).alias("single"),
    )


@query(
    "x4_remove_non_ascii",
    """SELECT doc_id, md5(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS plain_md5 FROM documents""",
)
def x4(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(text.remove_non_ascii(F.col("text"))).alias("plain_md5")
    )


@query(
    "x5_map_diff",
    """WITH e AS (SELECT event_id, event_type, user_id::VARCHAR AS u, value::VARCHAR AS v,
                         props->>'$.k' AS k FROM events),
            p AS (SELECT a.event_id, a.k AS k1, a.event_type AS t1, b.k AS k2, b.event_type AS t2, b.v AS v2,
                         2 + (a.event_type = 'click')::INT AS n1, 2 + (b.event_type = 'error')::INT AS n2
                  FROM e a JOIN e b ON b.event_id = a.event_id + 1)
       SELECT event_id, 'k' AS key, 'changed' AS kind,
              CASE WHEN n1 < n2 THEN k2 ELSE k1 END AS first,
              CASE WHEN n1 < n2 THEN k1 ELSE k2 END AS second FROM p WHERE k1 IS DISTINCT FROM k2
       UNION ALL
       SELECT event_id, 'type', 'changed', CASE WHEN n1 < n2 THEN t2 ELSE t1 END,
              CASE WHEN n1 < n2 THEN t1 ELSE t2 END FROM p WHERE t1 <> t2
       UNION ALL
       SELECT event_id, 'value', 'only', v2, NULL FROM p WHERE n1 = 3 AND n2 = 3""",
)
def x5(spark, sf):
    events = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))

    def as_map(extra_type, extra_key, extra):
        base = F.create_map(F.lit("k"), F.col("k"), F.lit("type"), F.col("event_type"))
        return F.when(
            F.col("event_type") == extra_type,
            F.map_concat(base, F.create_map(F.lit(extra_key), F.col(extra).cast("string"))),
        ).otherwise(base)

    ours = events.select("event_id", as_map("click", "user", "user_id").alias("a"))
    following = events.select(
        (F.col("event_id") - 1).alias("event_id"), as_map("error", "value", "value").alias("b")
    )
    diff = records.map_diff(F.col("a"), F.col("b"))
    return ours.join(following, "event_id").select("event_id", F.explode(diff)).select("event_id", "key", "value.*")


@query(
    "x6_dms_to_degrees",
    """SELECT c_custkey, round((CASE WHEN c_nationkey < 12 THEN 1 ELSE -1 END)
              * (c_custkey % 90 + c_nationkey / 60.0 + (c_custkey % 60) / 3600.0), 6)::DOUBLE AS degrees
       FROM customer""",
)
def x6(spark, sf):
    written = F.concat(
        (F.col("c_custkey") % 90).cast("string"), F.lit("°"),
        F.col("c_nationkey").cast("string"), F.lit("′"),
        (F.col("c_custkey") % 60).cast("string"), F.lit("″"),
        F.when(F.col("c_nationkey") < 12, "N").otherwise("S"),
    )
    return table(spark, sf, "customer").select(
        "c_custkey", F.round(geo.dms_to_degrees(written), 6).alias("degrees")
    )


_SLUG_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(
    lower(strip_accents(replace(replace({0}, 'ß', 'ss'), 'œ', 'oe'))),
    '([0-9]),([0-9])', '\1\2', 'g'), '([0-9]),([0-9])', '\1\2', 'g'), '[^a-z0-9]+', '-', 'g'), '-')"""


@query(
    "x7_slugify",
    f"""SELECT doc_id, md5({_SLUG_SQL.format('text')}) AS slug_md5 FROM documents
        UNION ALL SELECT -1 - p_partkey, md5({_SLUG_SQL.format("p_name || ' ' || p_brand")}) FROM part""",
)
def x7(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5(text.slugify(F.col("text"))).alias("slug_md5"))
    name = F.concat_ws(" ", "p_name", "p_brand")
    parts = table(spark, sf, "part").select(
        (F.lit(-1) - F.col("p_partkey")).alias("doc_id"), F.md5(text.slugify(name)).alias("slug_md5")
    )
    return docs.union(parts)


@query(
    "x8_unaccent",
    """SELECT doc_id, md5(strip_accents(replace(replace(text, 'ß', 'ss'), 'œ', 'oe'))) AS plain_md5
       FROM documents""",
)
def x8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.unaccent(F.col("text"))).alias("plain_md5"))


@query(
    "x9_title_from_slug",
    """SELECT p_partkey, array_to_string(list_transform(string_split(p_name || ' brand ' || p_size, ' '),
              lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part""",
)
def x9(spark, sf):
    slug = text.slugify(F.concat_ws(" ", F.col("p_name"), F.lit("Brand"), F.col("p_size").cast("string")))
    return table(spark, sf, "part").select("p_partkey", text.title_from_slug(slug).alias("title"))


_PLATFORM_SQL = r"regexp_extract(url, '^(?:https?://)?(?:www\.)?((?:[\w|-]+\.)*[\w|-]+)(?:\.[a-z]+)', 1)"


@query("x10_platform_of_url", f"SELECT page_id, {_PLATFORM_SQL} AS platform FROM pages")
def x10(spark, sf):
    return table(spark, sf, "pages").select("page_id", web.platform_of_url(F.col("url")).alias("platform"))


@query(
    "x11_first_number",
    """SELECT p_partkey, replace(p_retailprice::VARCHAR, '.', ',') AS written,
              p_retailprice::DECIMAL(12,2)::DOUBLE AS value FROM part""",
)
def x11(spark, sf):
    said = F.concat(
        F.lit("de la "), F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")),
        F.lit(" lei, "), F.col("p_size").cast("string"), F.lit(" camere"),
    )
    return table(spark, sf, "part").select(
        "p_partkey",
        text.first_number(said).alias("written"),
        text.number_value(said).cast("double").alias("value"),
    )


@query(
    "x12_price_mention",
    """SELECT p_partkey, CASE WHEN p_size >= 10 THEN p_size || ' Lei'
              WHEN p_brand = 'Brand#7' THEN '€ 75' END AS price FROM part""",
)
def x12(spark, sf):
    said = F.concat(
        F.col("p_name"), F.lit(" la "), F.col("p_size").cast("string"), F.lit(" Lei pe noapte"),
        F.when(F.col("p_brand") == "Brand#7", " sau € 75").otherwise(""),
    )
    return table(spark, sf, "part").select("p_partkey", text.price_mention(said).alias("price"))


@query("x13_pack_json", "SELECT event_id, replace(props, ' ', '') AS packed FROM events")
def x13(spark, sf):
    record = records.unpack_json(F.col("props"), "k BIGINT")
    return table(spark, sf, "events").select("event_id", records.pack_json(record).alias("packed"))


@query(
    "x14_query_param",
    """SELECT c_custkey, (c_custkey % 90) || '.5' AS latitude, c_nationkey || '.25' AS longitude,
              c_mktsegment || ' & co' AS label FROM customer""",
)
def x14(spark, sf):
    link = F.concat(
        F.lit("https://maps.example.com/maps?hl=ro&q="), (F.col("c_custkey") % 90).cast("string"), F.lit(".5,"),
        F.col("c_nationkey").cast("string"), F.lit(".25&label="), F.col("c_mktsegment"), F.lit("%20%26+co"),
    )
    point = web.point_from_map_link(link)
    return table(spark, sf, "customer").select(
        "c_custkey",
        point["latitude"].alias("latitude"),
        point["longitude"].alias("longitude"),
        web.query_param(link, "label").alias("label"),
    )


@query(
    "x15_decimals_in",
    """SELECT c_custkey, c_nationkey || '.5' AS latitude, (c_custkey % 90) || '.125' AS longitude,
              3::BIGINT AS found FROM customer""",
)
def x15(spark, sf):
    style = F.concat(
        F.lit("background:url(map?c="), F.col("c_nationkey").cast("string"), F.lit(".5,"),
        (F.col("c_custkey") % 90).cast("string"), F.lit(".125&z=15);opacity:0.9"),
    )
    found = text.decimals_in(style)
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.get(found, 0).alias("latitude"),
        F.get(found, 1).alias("longitude"),
        F.size(found).cast("bigint").alias("found"),
    )


@query(
    "x16_rewrite_url",
    """SELECT page_id,
              CASE WHEN contains(url, '.ro.') THEN url ELSE replace(url, '.html', '.ro.html') END AS listing,
              'http://h.ro/img/max1024x768/' || page_id || '.jpg' AS image FROM pages""",
)
def x16(spark, sf):
    image = F.concat(F.lit("../img/max300/zz_"), F.col("page_id").cast("string"), F.lit(".jpg"))
    rules = ["from_parent", "large_image", "no_thumb"]
    return table(spark, sf, "pages").select(
        "page_id",
        web.rewrite_url(F.col("url"), ["listing"]).alias("listing"),
        web.rewrite_url(image, rules, F.lit("http://h.ro/")).alias("image"),
    )


@query(
    "x17_squash_spaces",
    r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x0b\x{85}\p{Z}]+', ' ', 'g'))) AS squashed_md5 FROM documents",
)
def x17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.squash_spaces(F.col("text"))).alias("squashed_md5"))


@query(
    "x18_strip_punctuation",
    r"""SELECT doc_id, md5(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g')) AS plain_md5,
               length(text) - length(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g')) AS marks FROM documents""",
)
def x18(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        F.md5(text.strip_punctuation(F.col("text"))).alias("plain_md5"),
        text.punctuation_count(F.col("text")).cast("bigint").alias("marks"),
    )


@query("x19_content_key", "SELECT doc_id, md5(text) AS key FROM documents")
def x19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.content_key(F.col("text")).alias("key"))


@query("x20_load_stamp", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp FROM orders")
def x20(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.load_stamp(F.col("o_orderdate")).alias("stamp"))


def components(street, city, county, country):
    """Address components as a service returns them, with one that is not kept."""

    def part(kind, value, second="political"):
        return F.struct(
            F.array(F.lit(kind), F.lit(second)).alias("types"), value.cast("string").alias("short_name")
        )

    return F.array(
        part("street_number", F.lit("7")),
        part("route", street),
        part("locality", city),
        part("postal_code", F.lit("1"), "route"),
        part("administrative_area_level_1", county),
        part("country", country),
    )


@query(
    "x21_address_map",
    """SELECT c_custkey, unnest(['route', 'locality', 'administrative_area_level_1', 'country']) AS type,
              unnest([c_mktsegment, 'N' || c_nationkey, c_name, 'RO']) AS short_name FROM customer""",
)
def x21(spark, sf):
    built = components(
        F.col("c_mktsegment"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), F.col("c_name"), F.lit("RO")
    )
    return table(spark, sf, "customer").select(
        "c_custkey", F.explode(records.address_map(built)).alias("type", "short_name")
    )


_FIELD_SQL = """CASE WHEN o_orderpriority = '1-URGENT' THEN
       'a:2:{i:0;i:' || o_custkey || ';i:1;i:' || o_orderkey || ';}'
  WHEN o_orderpriority = '2-HIGH' THEN o_totalprice::DECIMAL(12,2)::VARCHAR
  WHEN o_orderpriority = '5-LOW' THEN 'a.' || o_orderstatus ELSE o_orderpriority END"""


@query(
    "x22_infer_value",
    f"""SELECT o_orderkey,
          CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey || ',' || o_orderkey END AS ids,
          CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice::DECIMAL(12,2)::DOUBLE END AS number,
          CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN {_FIELD_SQL} END AS text
        FROM orders""",
)
def x22(spark, sf):
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    field = (
        F.when(
            F.col("o_orderpriority") == "1-URGENT",
            F.concat(F.lit("a:2:{i:0;i:"), cust, F.lit(";i:1;i:"), key, F.lit(";}")),
        )
        .when(F.col("o_orderpriority") == "2-HIGH", F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
        .when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("a."), F.col("o_orderstatus")))
        .otherwise(F.col("o_orderpriority"))
    )
    value = records.infer_value(field)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.array_join(value["ids"].cast("array<string>"), ",").alias("ids"),
        value["number"].alias("number"),
        value["text"].alias("text"),
    )


@query(
    "x23_id_list",
    """SELECT l_orderkey, l_linenumber, l_partkey,
              'a:3:{i:0;i:' || l_partkey || ';i:1;i:' || l_suppkey || ';i:2;i:' || l_orderkey || ';}' AS packed,
              l_partkey AS id_0, l_suppkey AS id_1, l_orderkey AS id_2 FROM lineitem""",
)
def x23(spark, sf):
    packed = records.encode_id_list(F.array("l_partkey", "l_suppkey", "l_orderkey"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", packed.alias("packed"))
    ids = records.decode_id_list(F.col("packed"))
    return rows.select("*", *[F.get(ids, i).alias(f"id_{i}") for i in range(3)])


@query("x24_parse_grouped_int", "SELECT o_orderkey, 1000000 + o_orderkey AS value FROM orders")
def x24(spark, sf):
    grouped = F.replace(F.format_number(F.lit(1000000) + F.col("o_orderkey"), 0), F.lit(","), F.lit("."))
    return table(spark, sf, "orders").select("o_orderkey", text.parse_grouped_int(grouped).alias("value"))


@query(
    "x25_crop_plan",
    """WITH s AS (SELECT p_partkey, p_size * 40 AS w, 300 + p_partkey % 1300 AS h FROM part
                  UNION ALL SELECT -p_partkey, 600 + p_size * 20, 600 + p_size * 20 FROM part),
            r AS (SELECT *, w <= 500 OR h <= 500 AS rejected, w / h AS ratio FROM s),
            d AS (SELECT *, ceil(ratio * (w - 800)) AS dw, ceil(ratio * (h - 600)) AS dh FROM r),
            b AS (SELECT *, dw < 0 OR dh < 0 AS resize,
                    CASE WHEN ratio < 1 THEN w - 2 * dw WHEN ratio > 1 THEN ceil((h - 2 * dw) * ratio)
                         ELSE w + dw END AS bw,
                    CASE WHEN ratio < 1 THEN ceil((w - 2 * dw) / ratio) WHEN ratio > 1 THEN h - 2 * dh
                         ELSE h + dh END AS bh FROM d),
            o AS (SELECT p_partkey, rejected, NOT rejected AND resize AS resize,
                    CASE WHEN NOT rejected THEN (CASE WHEN resize THEN bw ELSE w END)::BIGINT END AS resize_w,
                    CASE WHEN NOT rejected THEN (CASE WHEN resize THEN bh ELSE h END)::BIGINT END AS resize_h
                  FROM b)
       SELECT *, (resize_w - 800) / 2.0::DOUBLE AS "left", (resize_h - 600) / 2.0::DOUBLE AS top,
              (resize_w + 800) / 2.0::DOUBLE AS "right", (resize_h + 600) / 2.0::DOUBLE AS bottom FROM o""",
)
def x25(spark, sf):
    part = table(spark, sf, "part")
    size = 600 + F.col("p_size") * 20
    sizes = part.select("p_partkey", (F.col("p_size") * 40).alias("w"), (300 + F.col("p_partkey") % 1300).alias("h"))
    squares = part.select((-F.col("p_partkey")).alias("p_partkey"), size.alias("w"), size.alias("h"))
    return sizes.unionByName(squares).select("p_partkey", geo.crop_plan(F.col("w"), F.col("h")).alias("plan")).select(
        "p_partkey", "plan.*"
    )


@query(
    "x26_image_name",
    r"""WITH b AS (SELECT page_id, string_split(url, '/')[-1] AS base FROM pages),
             e AS (SELECT page_id, lower(regexp_extract(base, '^\.*[^.].*(\.[^.]*)$', 1)) AS ext FROM b)
        SELECT page_id, page_id || CASE WHEN ext = '' THEN '.jpg' ELSE ext END AS name,
               CASE WHEN ext IN ('', '.jpg') THEN 'image/jpeg' ELSE 'image/png' END AS mime FROM e""",
)
def x26(spark, sf):
    name = web.image_name(F.col("url"), F.col("page_id"))
    return table(spark, sf, "pages").select("page_id", name.alias("name"), web.image_mime(name).alias("mime"))


@query(
    "x27_place_path",
    """SELECT c_custkey, replace(lower(r_name), ' ', '-') || '/' || replace(lower(n_name), '_', '-') || '/'
              || n_name || ' - ' || c_name AS path,
              replace(lower(n_name), '_', '-') || '/' ||
              replace(replace(lower(n_name || '-' || c_name), '_', '-'), '#', '-') AS old_path,
              CASE WHEN c_mktsegment = 'BUILDING' THEN 'Cazare 1.jpg'
                   ELSE 'Cazare_' || upper(n_name[1]) || lower(n_name[2:]) || '_' || c_custkey || '.jpg' END AS file
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def x27(spark, sf):
    file = F.when(F.col("c_mktsegment") == "BUILDING", "Cazare 1.jpg").otherwise(
        F.concat(F.col("c_custkey").cast("string"), F.lit(".jpg"))
    )
    rows = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return rows.select(
        "c_custkey",
        geo.place_path(F.col("r_name"), F.col("n_name"), F.col("c_name")).alias("path"),
        geo.old_place_path(F.col("n_name"), F.col("c_name")).alias("old_path"),
        geo.display_name(F.col("n_name"), file).alias("file"),
    )


@query(
    "x28_normalise_region",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'bucuresti'
              WHEN c_nationkey < 5 THEN 'ilfov' ELSE 'judet ' || c_nationkey END AS county FROM customer""",
)
def x28(spark, sf):
    county = F.when(F.col("c_nationkey") < 5, "Municipiul Bucureşti").otherwise(
        F.concat(F.lit("Județ "), F.col("c_nationkey").cast("string"))
    )
    city = F.when(F.col("c_mktsegment") == "BUILDING", "Bucureşti").otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", geo.normalise_region(county, city).alias("county"))


@query(
    "x29_labelled_pair",
    """SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN (c_custkey % 90) || '.5' END AS latitude,
              CASE WHEN c_nationkey < 20 THEN c_nationkey || '.75' END AS longitude FROM customer""",
)
def x29(spark, sf):
    cell = F.when(F.col("c_nationkey") < 20, "*Biserică").otherwise("Biserică")
    value = F.concat(
        F.lit("Coordonate: "), (F.col("c_custkey") % 90).cast("string"), F.lit(".5,"),
        F.col("c_nationkey").cast("string"), F.lit(".75"),
    )
    return table(spark, sf, "customer").select("c_custkey", geo.labelled_pair(cell, value).alias("p")).select(
        "c_custkey", "p.*"
    )


@query(
    "x30_quote_query",
    """SELECT p_partkey, 'https://www.google.com/search?q=' ||
              replace(url_encode(p_name || ' & ' || p_brand || '/é~*' || p_type), '%2F', '/') AS address FROM part""",
)
def x30(spark, sf):
    asked = F.concat(F.col("p_name"), F.lit(" & "), F.col("p_brand"), F.lit("/é~*"), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", web.quote_query(asked).alias("address"))
