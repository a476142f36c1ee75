"""Coordinates, region rules, folder paths and image geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normal_name, slugify

EARTH_RADIUS_M = 6371008.8
DMS_PATTERN = r"(\d+(?:\.\d+)?)°\s*(?:(\d+(?:\.\d+)?)′)?\s*(?:(\d+(?:\.\d+)?)″)?\s*(\w?)\s*$"


def dms_to_degrees(s: Column) -> Column:
    """`45°39′12″N` -> 45.653333...; every hemisphere but N and E is negative."""
    part = [F.coalesce(F.regexp_extract(s, DMS_PATTERN, i).try_cast("double"), F.lit(0.0)) for i in (1, 2, 3)]
    sign = F.when(F.regexp_extract(s, DMS_PATTERN, 4).isin("N", "E"), 1.0).otherwise(-1.0)
    return F.when(
        F.rlike(s, F.lit(DMS_PATTERN)), sign * (part[0] + part[1] / 60.0 + part[2] / 3600.0)
    )


def grid_point(x: Column) -> Column:
    """Coordinate as compared: six decimals, as a whole number of millionths."""
    return F.round(x * 1000000.0).cast("bigint")


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2.0 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def normalise_region(county: Column, city: Column) -> Column:
    """County text after the capital-city rules; both inputs may carry accents and capitals."""
    county, city = normal_name(county), normal_name(city)
    return (
        F.when(city == "bucuresti", "bucuresti")
        .when(F.contains(county, F.lit("ucuresti")), "ilfov")
        .otherwise(county)
    )


def labelled_pair(
    cell: Column, value: Column, marker: str = "*Biserică", label: str = "Coordonate: "
) -> Column:
    """struct(latitude, longitude) as text from `label lat,long` when the cell text is `marker`."""
    parts = F.split(F.replace(value, F.lit(label), F.lit("")), ",")
    marked = cell == marker
    return F.struct(
        F.when(marked, F.get(parts, 0)).alias("latitude"),
        F.when(marked, F.get(parts, 1)).alias("longitude"),
    )


def place_path(county: Column, city: Column, title: Column) -> Column:
    return F.concat_ws("/", slugify(county), slugify(city), F.concat(city, F.lit(" - "), title))


def old_place_path(city: Column, title: Column) -> Column:
    return F.concat_ws("/", slugify(city), slugify(F.concat(city, F.lit(" "), title)))


def display_name(city: Column, file: Column) -> Column:
    return F.when(F.contains(file, F.lit("Cazare")), file).otherwise(
        F.concat(F.lit("Cazare_"), F.initcap(city), F.lit("_"), file)
    )


def crop_plan(width: Column, height: Column, crop=(800, 600), limit=(500, 500)) -> Column:
    """struct(rejected, resize, resize_w, resize_h, left, top, right, bottom) of one image."""
    cw, ch = crop
    w, h = width.cast("double"), height.cast("double")
    rejected = (width <= limit[0]) | (height <= limit[1])
    ratio = w / h
    dw, dh = F.ceil(ratio * (w - cw)), F.ceil(ratio * (h - ch))
    resize = (dw < 0) | (dh < 0)
    box_w = (
        F.when(ratio < 1, w - 2 * dw).when(ratio > 1, F.ceil((h - 2 * dw) * ratio)).otherwise(w + dw)
    ).cast("bigint")
    box_h = (
        F.when(ratio < 1, F.ceil((w - 2 * dw) / ratio)).when(ratio > 1, h - 2 * dh).otherwise(h + dh)
    ).cast("bigint")
    out_w = F.when(resize, box_w).otherwise(width.cast("bigint"))
    out_h = F.when(resize, box_h).otherwise(height.cast("bigint"))
    kept = ~rejected
    return F.struct(
        rejected.alias("rejected"),
        (kept & resize).alias("resize"),
        F.when(kept, out_w).alias("resize_w"),
        F.when(kept, out_h).alias("resize_h"),
        F.when(kept, (out_w - cw) / 2.0).alias("left"),
        F.when(kept, (out_h - ch) / 2.0).alias("top"),
        F.when(kept, (out_w + cw) / 2.0).alias("right"),
        F.when(kept, (out_h + ch) / 2.0).alias("bottom"),
    )
