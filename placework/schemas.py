"""Fixed schemas of the catalogue tables and of the inputs from outside (Spark DDL)."""

from __future__ import annotations

_CONTENT = "id BIGINT, geo_hash_id STRING, type STRING, src_url STRING, content STRING"
_FACILITY = "id BIGINT, geo_hash_id STRING, type STRING, content STRING"
_PLATFORM = (
    "id BIGINT, geo_hash_id STRING, platform STRING, url STRING, avg_price STRING, last_modified TIMESTAMP"
)

CATALOGUE = {
    "booking_listings": (
        "id BIGINT, geo_hash_id STRING, title STRING, county_id BIGINT, type STRING, latitude DOUBLE, "
        "longitude DOUBLE, city_id BIGINT, hotel_id BIGINT, telephone STRING, address STRING, "
        "place_id STRING, photos STRING, status STRING"
    ),
    "booking_listings_content": _CONTENT,
    "booking_listings_facility": _FACILITY,
    "booking_listings_platform": _PLATFORM,
    "account_city": (
        "id BIGINT, county_id BIGINT, siruta INT, longitude DOUBLE, latitude DOUBLE, name STRING, "
        "region STRING, `check` STRING"
    ),
    "account_county": "id BIGINT, code STRING, name STRING",
    "biserici_romania": (
        "id BIGINT, geo_hash_id STRING, title STRING, religion STRING, city_id BIGINT, county_id BIGINT, "
        "latitude DOUBLE, longitude DOUBLE, cod_lmi STRING, photo_cnt INT, url STRING, address STRING, "
        "telephone STRING, stage STRING"
    ),
    "interest_points": (
        "id BIGINT, geo_hash_id STRING, title STRING, city_id BIGINT, types STRING, wp_post_id STRING, "
        "latitude DOUBLE, longitude DOUBLE, address_coord STRING, rate DOUBLE, place_id STRING, "
        "photos STRING, status STRING, `check` STRING"
    ),
    "interest_points_platform": _PLATFORM,
    "interest_points_content": _CONTENT,
    "interest_points_facility": _FACILITY,
}

PRIMARY_KEY = "id"
_TOWN = [("county_id", "account_county", "id"), ("city_id", "account_city", "id")]
_OF_LISTING = [("geo_hash_id", "booking_listings", "geo_hash_id")]
_OF_POINT = [("geo_hash_id", "interest_points", "geo_hash_id")]

# Table -> (column, parent table, parent column).
FOREIGN_KEYS = {
    "booking_listings": _TOWN,
    "booking_listings_content": _OF_LISTING,
    "booking_listings_facility": _OF_LISTING,
    "booking_listings_platform": _OF_LISTING,
    "account_city": _TOWN[:1],
    "account_county": [],
    "biserici_romania": _TOWN,
    "interest_points": _TOWN[1:],
    "interest_points_platform": _OF_POINT,
    "interest_points_content": _OF_POINT,
    "interest_points_facility": _OF_POINT,
}

LISTING_CSV = "`Hotel ID` STRING, `URL` STRING, `City` STRING, `Hotels` STRING"
