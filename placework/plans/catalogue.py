"""List site -> catalogue rows, and detail pages -> enriched rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import labelled_pair, normalise_region
from ..functions.records import place_key
from ..functions.text import normal_name, parse_grouped_int, slugify
from ..functions.web import point_from_map_link
from ..operators.aggregates import incomplete_groups
from ..operators.changes import assign_ids_by_hash, fresh_rows, update_by_id
from ..operators.html import html_trees
from ..operators.joins import resolve_city, resolve_city_prefix, resolve_county
from ..operators.pages import attr, cell, detail_fields, find_all, first, has_class, page_table
from ..operators.paging import page_urls
from ..operators.select import needs_enrichment
from ..operators.windows import first_per_key
from ..session import written
from ..sources.files import load_pages

MAP_LINK_CLASS = "fancybox-google"


def list_rows(pages: DataFrame) -> DataFrame:
    """Rows of list pages with their position; pages keep their other columns."""
    rows = page_table(html_trees(pages), skip_cells=1)
    text = lambda key: cell(F.col("cells"), key)["text"]
    point = labelled_pair(text("localizare"), cell(F.col("cells"), "localizare")["value"])
    return rows.select(
        *[c for c in rows.columns if c != "cells"],
        text("denumire").alias("title"),
        cell(F.col("cells"), "denumire")["value"].alias("url"),
        text("religie").alias("religion"),
        text("fotografii").try_cast("int").alias("photo_cnt"),
        F.nullif(text("cod-lmi"), F.lit("")).alias("cod_lmi"),
        normal_name(text("localitate")).alias("city_text"),
        normalise_region(text("judet"), text("localitate")).alias("county_text"),
        point.alias("point"),
    )


def _add_rows(
    rows: DataFrame, city: DataFrame, county: DataFrame, existing: DataFrame, default_county: Column | None
) -> DataFrame:
    # The parsed rows are a table before anything is looked up: pages are parsed once.
    rows = written(rows.filter("url IS NOT NULL"), "listed")
    fresh = fresh_rows(existing, rows, "url", ["page_id", "row_no"])
    found = resolve_county(fresh, county, name=F.col("county_text")).withColumnRenamed("county_id", "said_county")
    found = resolve_city(found, city, F.col("city_text"), F.col("said_county"), default_county)
    of_city = city.select(F.col("id").alias("city_id"), "county_id")
    latitude, longitude = F.col("point.latitude"), F.col("point.longitude")
    added = found.join(of_city, "city_id", "left").select(
        F.when(latitude.isNotNull(), place_key(longitude, latitude, F.col("url"))).alias("geo_hash_id"),
        "title",
        "religion",
        "city_id",
        "county_id",
        latitude.try_cast("double").alias("latitude"),
        longitude.try_cast("double").alias("longitude"),
        "cod_lmi",
        "photo_cnt",
        "url",
        F.lit("new").alias("stage"),
    )
    return assign_ids_by_hash(added, existing, ["url"])


def ingest_catalogue(pages: DataFrame, city: DataFrame, county: DataFrame, existing: DataFrame) -> DataFrame:
    """New state of the catalogue after reading list pages(page_id, url, status, html).

    The county of a row is that of its city; a row whose url is stored is skipped.
    """
    usable, _ = load_pages(pages)
    rows = list_rows(usable.select("page_id", "html"))
    added = _add_rows(rows, city, county, existing, None)
    return existing.unionByName(added, allowMissingColumns=True)


def ingest_incomplete(
    plan: DataFrame, pages: DataFrame, city: DataFrame, county: DataFrame, existing: DataFrame
) -> DataFrame:
    """The same for counties whose declared count differs from the stored one.

    plan(code, url, declared_count): county code, first list page and count as written there. Only the list
    pages of incomplete counties are parsed; their county stands in for one that is not known.
    """
    expected = resolve_county(plan, county, code=F.col("code")).filter("county_found")
    expected = expected.select("county_id", "url", parse_grouped_int(F.col("declared_count")).alias("declared"))
    todo = incomplete_groups(expected, existing.select("county_id"), "county_id")
    wanted = page_urls(todo, count="declared").select(
        F.col("page_url").alias("url"), F.col("county_id").alias("default_county")
    )
    usable, _ = load_pages(pages)
    listed = usable.join(wanted, "url").select("page_id", "default_county", "html")
    added = _add_rows(list_rows(listed), city, county, existing, F.col("default_county"))
    return existing.unionByName(added, allowMissingColumns=True)


def enrich_details(rows: DataFrame, pages: DataFrame, city: DataFrame, county: DataFrame) -> dict[str, DataFrame]:
    """Rows in stage `new` without an address, completed from their detail pages(url, status, html).

    A row needs a usable page, and a key or a map link with coordinates; it becomes `fixed`. The others
    stay as they are; those without a usable page are listed in `failed`.
    """
    todo = needs_enrichment(rows)
    wanted = pages.join(todo.select("url").distinct(), "url", "left_semi")
    usable, _ = load_pages(wanted)
    link = first(find_all(F.col("nodes"), "a", where=lambda n: has_class(n, MAP_LINK_CLASS)))
    trees = html_trees(usable.select("url", "html")).withColumn("point", point_from_map_link(attr(link, "href")))
    fields = first_per_key(written(detail_fields(trees), "details"), ["url"], ["address", "contacts"]).select(
        "url",
        F.col("county").alias("page_county"),
        F.col("city").alias("page_city"),
        F.col("address").alias("page_address"),
        "contacts",
        "phone",
        "point",
    )
    joined = todo.join(fields, "url")
    located = resolve_county(
        joined.withColumnRenamed("county_id", "row_county"), county, name=slugify(F.col("page_county"))
    ).withColumnRenamed("county_id", "new_county")
    located = resolve_city_prefix(
        located.withColumnRenamed("city_id", "row_city"), city, F.col("page_city"), F.col("row_county")
    ).withColumnRenamed("city_id", "new_city")
    latitude, longitude = F.col("point.latitude"), F.col("point.longitude")
    can_key = latitude.isNotNull() & longitude.isNotNull()
    done = located.filter(~F.col("needs_key") | can_key)
    rekeyed = F.col("needs_key")
    changes = done.select(
        "id",
        F.col("page_address").alias("address"),
        F.col("new_county").alias("county_id"),
        F.col("new_city").alias("city_id"),
        F.col("phone").alias("telephone"),
        latitude.try_cast("double").alias("latitude"),
        longitude.try_cast("double").alias("longitude"),
        place_key(longitude, latitude, F.col("url")).alias("geo_hash_id"),
        F.lit("fixed").alias("stage"),
        F.array_compact(
            F.array(
                F.lit("address"),
                F.lit("stage"),
                F.when(F.col("new_county").isNotNull(), "county_id"),
                F.when(F.col("new_city").isNotNull(), "city_id"),
                F.when(F.col("phone").isNotNull(), "telephone"),
                F.when(rekeyed, "latitude"),
                F.when(rekeyed, "longitude"),
                F.when(rekeyed, "geo_hash_id"),
            )
        ).alias("set_columns"),
    )
    return {
        "rows": update_by_id(rows, changes),
        "contacts": done.select("id", "contacts").filter("contacts <> '{}'"),
        "failed": todo.join(usable.select("url"), "url", "left_anti").select("id", "url"),
    }
