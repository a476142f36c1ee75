"""Points of interest: contacts and addresses, transfer from the catalogue, comparison with posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import COMPONENTS, first_valid_address, map_diff, packed_address, place_key, unpack_json
from ..functions.web import platform_of_url
from ..operators.aggregates import POST_FIELDS, typed_fields, unpack_fields
from ..operators.changes import assign_ids, replace_children, update_by_id
from ..operators.joins import (
    first_platform,
    join_first_term,
    match_points,
    match_with_fallback,
    place_columns,
    with_dimensions,
)
from ..operators.windows import first_per_key
from ..schemas import CATALOGUE
from ..session import written
from ..sources.files import load_posts
from .outputs import Outputs

WORSHIP = "place_of_worship"
GEOCODES = f"array<struct<address_components:{COMPONENTS}>>"


def backfill_contacts(
    points: DataFrame,
    details: DataFrame,
    geocodes: DataFrame,
    city: DataFrame,
    county: DataFrame,
    stamp,
    platforms: DataFrame | None = None,
    facilities: DataFrame | None = None,
) -> Outputs:
    """Move legacy website/telephone columns to child rows and fill missing addresses.

    points may carry website, telephone, address; details(place_id, body) and geocodes(id, body) hold stored
    responses, one row per key. Only points without `address_coord` change. The address comes from the place
    details; for a point without the legacy address a reverse-geocoded one that names its city and
    county code is preferred. platforms and facilities: the stored child tables (default: empty), which come back in their
    new state: a point's contact row, and its rows of the platform its site is on, are replaced.
    """
    spark = points.sparkSession
    for column in ("website", "telephone", "address"):
        if column not in points.columns:
            points = points.withColumn(column, F.lit(None).cast("string"))
    open_point = F.col("address_coord").isNull()
    has_place = open_point & (F.coalesce("place_id", F.lit("")) != "")
    no_address = open_point & (F.coalesce("address", F.lit("")) == "")
    has_site = open_point & (F.coalesce("website", F.lit("")) != "")
    has_phone = open_point & (F.coalesce("telephone", F.lit("")) != "")

    child = points.select("*", has_site.alias("has_site"), has_phone.alias("has_phone")).filter("geo_hash_id IS NOT NULL")

    def new_platforms() -> DataFrame:
        stored = spark.createDataFrame([], CATALOGUE["interest_points_platform"]) if platforms is None else platforms
        rows = child.filter("has_site").select(
            "geo_hash_id",
            platform_of_url(F.col("website")).alias("platform"),
            F.col("website").alias("url"),
            F.lit(stamp).cast("timestamp").alias("last_modified"),
        )
        return replace_children(stored, rows, rows, ["geo_hash_id", "platform"], ("last_modified",))

    def new_facilities() -> DataFrame:
        stored = spark.createDataFrame([], CATALOGUE["interest_points_facility"]) if facilities is None else facilities
        contact = F.struct(
            F.when(F.col("has_site"), F.col("website")).alias("website"),
            F.when(F.col("has_phone"), F.col("telephone")).alias("telephone"),
        )
        rows = child.filter("has_site OR has_phone").select(
            "geo_hash_id", F.lit("contact").alias("type"), F.to_json(contact).alias("content")
        )
        return replace_children(stored, rows, rows, ["geo_hash_id", "type"])

    detail = details.select(
        "place_id",
        packed_address(unpack_json(F.col("body"), f"address_components {COMPONENTS}")["address_components"]).alias(
            "__from_place"
        ),
    )
    candidates = geocodes.select("id", unpack_json(F.col("body"), GEOCODES).alias("__candidates"))
    # Closed points look nothing up: their join keys are NULL.
    keyed = (
        points.withColumn("__place", F.when(has_place, F.col("place_id")))
        .join(detail.withColumnRenamed("place_id", "__place"), "__place", "left")
        .withColumn("__geo", F.when(no_address, F.col("id")))
        .join(candidates.withColumnRenamed("id", "__geo"), "__geo", "left")
    )
    named = with_dimensions(keyed, city, county)
    from_geocode = first_valid_address(F.col("__candidates"), F.col("city_name"), F.col("county_code"))
    address = F.coalesce(
        F.when(no_address, from_geocode), F.when(has_place, F.coalesce("__from_place", F.lit("{}"))), F.col("address_coord")
    )
    new_state = named.select(
        *[
            {
                "address_coord": address.alias("address_coord"),
                "website": F.when(~has_site, F.col("website")).alias("website"),
                "telephone": F.when(~has_phone, F.col("telephone")).alias("telephone"),
                "address": F.when(~has_place, F.col("address")).alias("address"),
            }.get(c, F.col(c))
            for c in points.columns
        ]
    )
    return Outputs(points=lambda: new_state, platforms=new_platforms, facilities=new_facilities)


def reconcile_points(
    rows: DataFrame, points: DataFrame, platforms: DataFrame, facilities: DataFrame, url_prefix: str, platform: str, stamp
) -> dict[str, DataFrame]:
    """Transfer catalogue rows in stage `fixed` to the points.

    Keys of rows are recomputed. A row at the place of known points passes its key to those whose first
    platform URL is prefix + url (and on to their child rows), and becomes `moved` when one of them had
    another key. A row at a new place becomes a point with a platform and an info row; of several such rows at
    one place the first does. `duplicates` lists keys that match more than one point.
    """
    fixed = rows.filter("stage = 'fixed' AND county_id IS NOT NULL").withColumn(
        "new_key", place_key(F.col("longitude"), F.col("latitude"), F.col("url"))
    )
    matched = written(match_points(fixed, points, platforms, url_prefix), "matched")
    # One row per place and URL: copies of a row are not paired with the points one by one.
    hits = (
        matched.filter("matches > 0")
        .groupBy(*place_columns(), F.concat(F.lit(url_prefix), "url").alias("platform_url"))
        .agg(F.min_by("new_key", "id").alias("new_key"), F.min("id").alias("row_id"))
    )
    at = points.join(first_platform(platforms), "geo_hash_id").select("id", "geo_hash_id", "platform_url", *place_columns())
    pairs = at.join(hits, ["__lat", "__lon", "__city", "platform_url"]).filter(
        ~F.col("geo_hash_id").eqNullSafe(F.col("new_key"))
    )
    # One new key per point and per old key: that of the first row.
    key_of_point = pairs.groupBy("id").agg(F.min_by("new_key", "row_id").alias("geo_hash_id"))
    key_of_old = pairs.groupBy(F.col("geo_hash_id").alias("old_key")).agg(F.min_by("new_key", "row_id").alias("new_key"))
    changed_rows = pairs.groupBy("row_id").agg(F.lit(True).alias("passed_on"))

    # A new place is one row by the coordinates as they are compared.
    place = ["__lat", "__lon", "__city"]
    inserted = first_per_key(matched.filter(~F.col("points_here")).select("*", *place_columns()), place, "id").drop(*place)
    new_points = inserted.select(
        F.col("new_key").alias("geo_hash_id"),
        "title",
        "city_id",
        "latitude",
        "longitude",
        F.lit(WORSHIP).alias("types"),
        F.col("address").alias("address_coord"),
        F.when(F.col("photo_cnt") < 2, "invalid").alias("status"),
        F.col("id").alias("__row"),
    )
    new_platforms = inserted.select(
        F.col("new_key").alias("geo_hash_id"),
        F.lit(platform).alias("platform"),
        F.concat(F.lit(url_prefix), "url").alias("url"),
        F.lit(stamp).cast("timestamp").alias("last_modified"),
        F.col("id").alias("__row"),
    )
    info = F.struct(
        "religion", F.nullif("cod_lmi", F.lit("")).alias("cod_lmi"), F.col("photo_cnt").alias("photo_count")
    )
    new_facilities = inserted.select(
        F.col("new_key").alias("geo_hash_id"),
        F.lit("info").alias("type"),
        F.to_json(info, {"ignoreNullFields": "false"}).alias("content"),
        F.col("id").alias("__row"),
    )

    def carried(children: DataFrame) -> DataFrame:
        return (
            children.join(key_of_old, F.col("geo_hash_id") == F.col("old_key"), "left")
            .withColumn("geo_hash_id", F.coalesce("new_key", "geo_hash_id"))
            .drop("old_key", "new_key")
        )

    def with_new(stored: DataFrame, added: DataFrame, like: DataFrame) -> DataFrame:
        return stored.unionByName(assign_ids(added, like, "__row").drop("__row"), allowMissingColumns=True)

    set_key = key_of_point.withColumn("set_columns", F.array(F.lit("geo_hash_id")))
    staged = (
        matched.select("id", F.col("new_key").alias("geo_hash_id"))
        .join(changed_rows.withColumnRenamed("row_id", "id"), "id", "left")
        .join(inserted.select("id", F.lit(True).alias("added")), "id", "left")
        .withColumn("stage", F.when(F.coalesce("passed_on", "added"), "moved").otherwise("fixed"))
        .withColumn("set_columns", F.array(F.lit("geo_hash_id"), F.lit("stage")))
        .drop("passed_on", "added")
    )
    return {
        "rows": update_by_id(rows, staged),
        "points": with_new(update_by_id(points, set_key), new_points, points),
        "platforms": with_new(carried(platforms), new_platforms, platforms),
        "facilities": with_new(carried(facilities), new_facilities, facilities),
        "duplicates": matched.filter("matches > 1").select(F.col("new_key").alias("geo_hash_id"), "matches"),
    }


# Fields of a point that a post carries as custom fields and that are compared.
COMPARED = ("latitude", "longitude", "geo_hash_id", "rate", "place_id", "address_coord")


def post_changes(
    posts: DataFrame,
    fields: DataFrame,
    points: DataFrame,
    terms: DataFrame,
    post_type: str | None = None,
    mode: str = "wp",
) -> dict[str, DataFrame]:
    """Differences between posts and the points they stand for.

    `changes`: one row per field to write: side (post or point), its id, the field's name on that side, the
    present and the new value. Mode `wp` writes to posts, `db` to points, `both` to both. `missing` lists posts
    without a point; `locations` the first location term of each post.
    """
    if mode not in ("wp", "db", "both"):
        raise ValueError(f"unknown mode {mode!r}")
    chosen = load_posts(posts, post_type)
    # A post without fields stays; fields of other posts are not looked at.
    own = fields.join(chosen.select("post_id"), "post_id", "left_semi")
    record = typed_fields(unpack_fields(own), ["city_id"]).withColumnRenamed("city_id", "city")
    wide = chosen.join(record, "post_id", "left").withColumns(
        {
            "latitude": F.col("latitude").try_cast("double"),
            "longitude": F.col("longitude").try_cast("double"),
        }
    )
    matched = written(match_with_fallback(wide, points), "matched-posts")

    def as_map(columns: dict):
        pairs = [x for name, c in columns.items() for x in (F.lit(name), c)]
        return F.create_map(*pairs)

    number = lambda c: F.round(F.col(c).try_cast("double"), 6).cast("string")
    text = lambda c: F.col(c).cast("string")
    kinds = {c: number if c in ("latitude", "longitude", "rate") else text for c in COMPARED}
    post_side = matched.filter("match_kind <> 'missing'").select(
        "post_id", "point_id", as_map({c: kinds[c](c) for c in COMPARED}).alias("post_map")
    )
    point_side = points.select(
        F.col("id").alias("point_id"), as_map({c: kinds[c](c) for c in COMPARED}).alias("point_map")
    )
    diff = (
        post_side.join(point_side, "point_id")
        .select("post_id", "point_id", F.explode(map_diff(F.col("post_map"), F.col("point_map"))).alias("field", "d"))
        .select("post_id", "point_id", "field", F.col("d.first").alias("post_value"), F.col("d.second").alias("point_value"))
    )
    field_name = F.create_map(*[F.lit(x) for k, c in POST_FIELDS.items() for x in (c, k)])
    sides = []
    if mode in ("wp", "both"):
        sides.append(
            diff.select(
                F.lit("post").alias("side"), F.col("post_id").alias("id"), field_name[F.col("field")].alias("field"),
                F.col("post_value").alias("present"), F.col("point_value").alias("new"),
            )
        )
    if mode in ("db", "both"):
        sides.append(
            diff.select(
                F.lit("point").alias("side"), F.col("point_id").alias("id"), "field",
                F.col("point_value").alias("present"), F.col("post_value").alias("new"),
            )
        )
    located = join_first_term(matched.select("post_id", "city"), terms, F.col("city.ids"))
    return {
        "changes": sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1]),
        "missing": matched.filter("match_kind = 'missing'").select("post_id", "title"),
        "matches": matched.select("post_id", "point_id", "match_kind"),
        "locations": located.select("post_id", "first_term_id", "location"),
    }
