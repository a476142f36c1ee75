"""Lodging lists: CSV rows -> pages -> nearby places -> catalogue rows."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import place_key
from ..functions.text import first_number, slugify, title_from_slug
from ..functions.web import listing_url, platform_of_url
from ..operators.changes import assign_ids, replace_children, upsert
from ..operators.html import html_trees
from ..operators.joins import match_nearby, resolve_city, skip_known, with_dimensions
from ..operators.pages import json_ld, listing_record, result_prices
from ..operators.sets import platform_rows
from ..operators.windows import first_per_key
from ..schemas import CATALOGUE
from ..session import written
from .outputs import Outputs

FACILITY_TYPES = {"facilities": "facilities", "capacity": "capacity", "vecinity": "surroundings"}
CONTENT_TYPES = ("short_description", "long_description")


def csv_rows(csv: DataFrame) -> DataFrame:
    """hotel_id, url, city text and title of the list; a repeated hotel counts once."""
    rows = csv.select(
        F.col("Hotel ID").try_cast("bigint").alias("hotel_id"),
        listing_url(F.col("URL")).alias("url"),
        slugify(F.col("City")).alias("city_text"),
        title_from_slug(slugify(F.col("Hotels"))).alias("title"),
    )
    return first_per_key(rows.filter("hotel_id IS NOT NULL"), ["hotel_id"], ["url", "title"])


CHILDREN = {
    "platforms": "booking_listings_platform",
    "facilities": "booking_listings_facility",
    "contents": "booking_listings_content",
}


def import_listings(
    csv: DataFrame,
    pages: DataFrame,
    places: DataFrame,
    details: DataFrame,
    results: DataFrame,
    city: DataFrame,
    county: DataFrame,
    existing: DataFrame,
    stamp,
    priority_counties: list[int] | None = None,
    children: dict[str, DataFrame] | None = None,
) -> Outputs:
    """New state of the listings and of their child tables `platforms`, `facilities` and `contents`.

    pages(url, html); places(id, name, latitude, longitude, place_id); details(place_id, url,
    formatted_phone_number), of which the first per place counts; results(hotel_id, html) search result pages; children: the
    stored child tables (default: empty). Only pages of listings that are not stored yet are parsed; with `priority_counties`
    only listings stored there are skipped, and the others are read again and replaced, their stored children (those
    of their old key too) with them. Children that come again as they were keep their ids. `failed` lists new
    rows without a usable page. Each output is planned when it is looked up; the pages are parsed once for all.
    """
    spark = csv.sparkSession
    known = existing.filter(F.col("county_id").isin(*priority_counties)) if priority_counties else existing
    fresh = skip_known(csv_rows(csv), known, "hotel_id")

    @functools.cache
    def listings() -> DataFrame:
        wanted = pages.join(fresh.select("url").distinct(), "url", "left_semi").select("url", "html")
        trees = html_trees(wanted).withColumn("ld", json_ld(F.col("nodes")))
        record = first_per_key(listing_record(trees), ["url"], ["latitude", "longitude"])
        usable = record.filter("status IS NULL").drop("status").withColumnRenamed("address", "page_address")
        placed = with_dimensions(resolve_city(fresh, city, F.col("city_text")), city, county)
        found = placed.join(usable, "url").select(
            "hotel_id",
            "title",
            "url",
            F.col("city_county_id").alias("county_id"),
            "city_id",
            F.col("latitude").cast("double").alias("latitude"),
            F.col("longitude").cast("double").alias("longitude"),
            place_key(F.col("longitude"), F.col("latitude"), F.col("hotel_id")).alias("geo_hash_id"),
            F.coalesce("ld.address.streetAddress", "page_address").alias("address"),
            first_number(F.col("ld.priceRange")).alias("avg_price"),
            F.concat(
                F.lit("/Booking/"), slugify(F.col("county_name")), F.lit("/"), "city_name", F.lit(" "), "title"
            ).alias("photos"),
            "surroundings",
            "facilities",
            "capacity",
            *CONTENT_TYPES,
        )
        # Every output is derived from this table; the pages are parsed once.
        return written(found, "listings")

    @functools.cache
    def near() -> DataFrame:
        named = listings().select(F.col("hotel_id").alias("id"), F.col("title").alias("name"), "latitude", "longitude")
        # One row per place: a repeated one must not multiply listings.
        of_place = details.groupBy("place_id").agg(F.min(F.struct("url", "formatted_phone_number")).alias("d"))
        of_place = of_place.select("place_id", F.col("d.url").alias("place_url"), "d.formatted_phone_number")
        found = match_nearby(named, places).select(F.col("left_id").alias("hotel_id"), "right_id", "place_id")
        return written(found.join(of_place, "place_id"), "near")

    def new_state() -> DataFrame:
        # Of several near places the last one gives the place id and the phone.
        last = near().groupBy("hotel_id").agg(
            F.max_by("place_id", "right_id").alias("place_id"),
            F.max_by("formatted_phone_number", "right_id").alias("telephone"),
        )
        stored = listings().drop("url", "avg_price", "surroundings", "facilities", "capacity", *CONTENT_TYPES)
        # A listing that is read again keeps its id.
        kept_ids = existing.groupBy("hotel_id").agg(F.min("id").alias("id"))
        again = stored.join(kept_ids, "hotel_id")
        brand_new = assign_ids(stored.join(kept_ids, "hotel_id", "left_anti"), existing, "hotel_id")
        return upsert(existing, again.unionByName(brand_new).join(last, "hotel_id", "left"), "hotel_id")

    def platforms() -> DataFrame:
        keys = listings().select("hotel_id", "geo_hash_id")
        own = listings().select("geo_hash_id", "url", "avg_price")
        maps = near().join(keys, "hotel_id").select("geo_hash_id", F.col("place_url").alias("url"))
        # Result pages are parsed for new listings only.
        found = result_prices(html_trees(results.join(keys, "hotel_id")))
        search = found.select("geo_hash_id", F.col("href").alias("url"), F.col("price").alias("avg_price"))
        rows = platform_rows(own, maps, search).select(
            "geo_hash_id", platform_of_url(F.col("url")).alias("platform"), "url", "avg_price",
            F.lit(stamp).cast("timestamp").alias("last_modified"),
        )
        return merged("platforms", rows.filter("platform <> ''"))

    def facilities() -> DataFrame:
        each = [F.struct(F.lit(t).alias("type"), F.col(c).alias("content")) for t, c in FACILITY_TYPES.items()]
        rows = listings().select("geo_hash_id", F.explode(F.array(*each)).alias("f"))
        return merged("facilities", rows.select("geo_hash_id", "f.*"))

    def contents() -> DataFrame:
        each = [F.struct(F.lit(t).alias("type"), F.col(t).alias("content")) for t in CONTENT_TYPES]
        rows = listings().select("geo_hash_id", F.col("url").alias("src_url"), F.explode(F.array(*each)).alias("c"))
        rows = rows.select("geo_hash_id", "c.type", "src_url", "c.content")
        return merged("contents", rows.filter("content IS NOT NULL"))

    def merged(name: str, rows: DataFrame) -> DataFrame:
        empty = spark.createDataFrame([], CATALOGUE[CHILDREN[name]])
        stored = (children or {}).get(name, empty)
        passing = ("last_modified",) if name == "platforms" else ()
        # What a listing had under its old key goes too.
        now = listings().select("geo_hash_id")
        if "geo_hash_id" in existing.columns:
            old = existing.join(listings().select("hotel_id").distinct(), "hotel_id", "left_semi").select("geo_hash_id")
            now = now.unionByName(old)
        return replace_children(stored, rows, now.filter("geo_hash_id IS NOT NULL"), ["geo_hash_id"], passing)

    def failed() -> DataFrame:
        return fresh.join(listings().select("url").distinct(), "url", "left_anti").select("hotel_id", "url")

    return Outputs(listings=new_state, platforms=platforms, facilities=facilities, contents=contents, failed=failed)
