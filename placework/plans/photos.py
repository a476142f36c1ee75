"""Photo folders: which points have usable images, and which images to fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import crop_plan, display_name, place_path
from ..functions.web import image_name, without_thumb
from ..operators.html import html_trees
from ..operators.joins import join_photos, photo_folders, with_dimensions
from ..operators.pages import attr, find_all
from ..operators.select import select_rows
from ..session import written
from .points import WORSHIP


def photo_audit(
    points: DataFrame,
    facilities: DataFrame,
    files: DataFrame,
    old_files: DataFrame,
    city: DataFrame,
    county: DataFrame,
    new_root: str = "",
) -> dict[str, DataFrame]:
    """Status or photo path of each place of worship, and what to do with each image file.

    files and old_files(path, width, height) are the present and the old folder layout. A point with fewer
    than two declared photos is `invalid`, one without a folder `no_imgs`, one whose images are too small
    (all but one of the declared number) `invalid_imgs`; any other gets its photo path. The first
    facility row of a point holds the declared number.
    """
    info = facilities.groupBy("geo_hash_id").agg(F.min_by("content", "id").alias("info"))
    places = with_dimensions(select_rows(points, {"types": WORSHIP}), city, county).join(info, "geo_hash_id", "left")
    places = places.withColumn("declared", F.from_json("info", "photo_count BIGINT")["photo_count"])
    audited = join_photos(places, files, old_files)

    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    planned = (
        files.withColumn("old", F.lit(False))
        .unionByName(old_files.withColumn("old", F.lit(True)))
        .select("old", "path", folder.alias("photo_folder"), crop_plan(F.col("width"), F.col("height")).alias("plan"))
    )
    rejected = planned.groupBy("photo_folder", F.col("old").alias("moved")).agg(
        F.count_if("plan.rejected").alias("rejected")
    )
    audited = audited.join(rejected, ["photo_folder", "moved"], "left")
    status = (
        F.when(F.col("declared") < 2, "invalid")
        .when(F.col("photo_folder").isNull(), "no_imgs")
        .when(F.col("rejected") >= F.col("declared") - 1, "invalid_imgs")
    )
    target = place_path(F.col("county_name"), F.col("city_name"), F.col("title"))
    judged = audited.withColumn("verdict", status).withColumn(
        "new_photos", F.when(F.col("verdict").isNull(), target)
    )
    judged = written(judged, "judged")
    result = judged.select("id", "verdict", "new_photos", "photo_folder", "moved", "file_count", "rejected")
    changed = judged.select(
        "id",
        F.col("verdict").alias("status"),
        F.col("new_photos").alias("photos"),
        F.when(F.col("verdict").isNull(), F.array(F.lit("photos"))).otherwise(F.array(F.lit("status"))).alias(
            "set_columns"
        ),
    )
    # Each file of a place that is looked through: its display name, where it goes and how it is cropped.
    looked_at = judged.filter("declared >= 2 AND photo_folder IS NOT NULL").select(
        "id", "photo_folder", "moved", "city_name", target.alias("target_folder")
    )
    file = F.substring_index("path", "/", -1)
    manifest = looked_at.join(planned.withColumnRenamed("old", "moved"), ["photo_folder", "moved"]).select(
        "id",
        "path",
        display_name(F.col("city_name"), file).alias("file_name"),
        F.concat_ws("/", *([F.lit(new_root)] if new_root else []), "target_folder").alias("target_folder"),
        "moved",
        "plan",
    )
    return {"audit": result, "changes": changed, "manifest": manifest}


def image_manifest(
    pages: DataFrame,
    rows: DataFrame,
    files: DataFrame,
    city: DataFrame,
    county: DataFrame,
    images_per_place: int | None = None,
) -> DataFrame:
    """Images to fetch: source path, target folder and numbered file name.

    For rows with at least two photos and no files yet; the thumbnails of the page (names with `zz_`), as full images:
    all, or the first `images_per_place`.
    """
    named = with_dimensions(rows.filter("photo_cnt >= 2"), city, county)
    wanted = named.select(
        "id", "url", place_path(F.col("county_name"), F.col("city_name"), F.col("title")).alias("folder")
    ).filter("folder IS NOT NULL")
    wanted = wanted.join(photo_folders(files).select("folder"), "folder", "left_anti")
    todo = pages.filter("status = 200 AND html IS NOT NULL").join(wanted, "url").select("id", "url", "folder", "html")
    trees = html_trees(todo)
    full = F.transform(
        find_all(F.col("nodes"), "img", where=lambda n: F.contains(attr(n, "src"), F.lit("zz_"))),
        lambda n: F.concat(F.lit("/"), attr(n, "src")),
    )
    if images_per_place is not None:
        full = F.slice(full, 1, images_per_place)
    return trees.select("id", "folder", F.posexplode(full).alias("k", "thumb")).select(
        "id",
        "k",
        without_thumb(F.col("thumb")).alias("source"),
        "folder",
        image_name(F.col("thumb"), F.col("k")).alias("file_name"),
    )
