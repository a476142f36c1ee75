"""Lookups, matches and nested views.

The lookup side of each join is first reduced to one row per key by an aggregate with a map-side part.
The other side is then the only one that can be skewed; it is the streamed (left) side, which adaptive
execution splits when a key is hot. Nothing is hinted as broadcast: Spark broadcasts a lookup side when its
measured size is below the session threshold and sorts and merges beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import grid_point, old_place_path, place_path
from ..functions.text import normal_name
from .nearby import match_nearby, nearby_pairs  # noqa: F401
from .rarity import by_rarity, piece_levels
from .windows import collect_in_chunks

NO_VALUE = -(2**62)


def with_children(
    parent: DataFrame, child: DataFrame, key: str, chunk_rows: int, order: str = "id", name: str = "children"
) -> DataFrame:
    """Parents with ordered lists of their children.

    A parent with more than `chunk_rows` children comes once per chunk (column `chunk`), so that no list
    grows without bound; a parent without children comes once with an empty list.
    """
    fields = [c for c in child.columns if c != key]
    lists = collect_in_chunks(child.filter(F.col(key).isNotNull()), [key], order, F.struct(*fields), chunk_rows, name)
    # Inner join and rest instead of one left join: the lists of a hot parent are then a side that can be split.
    with_some = parent.join(lists, key)
    without = parent.join(lists.filter("chunk = 0").select(key), key, "left_anti")
    none = F.array().cast(lists.schema[name].dataType)
    return with_some.unionByName(without.select("*", F.lit(0).cast("bigint").alias("chunk"), none.alias(name)))


def with_dimensions(df: DataFrame, city: DataFrame, county: DataFrame) -> DataFrame:
    """City and county attributes by foreign key; rows without a match stay, and none is multiplied by a repeated id."""
    cities = city.groupBy(F.col("id").alias("city_id")).agg(F.min(F.struct("name", "county_id")).alias("c"))
    cities = cities.select("city_id", F.col("c.name").alias("city_name"), F.col("c.county_id").alias("__county"))
    counties = county.groupBy(F.col("id").alias("__county")).agg(F.min(F.struct("name", "code")).alias("c"))
    counties = counties.select("__county", F.col("c.name").alias("county_name"), F.col("c.code").alias("county_code"))
    return (
        df.join(cities, "city_id", "left")
        .join(counties, "__county", "left")
        .withColumnRenamed("__county", "city_county_id")
    )


def resolve_county(
    df: DataFrame, county: DataFrame, name: Column | None = None, code: Column | None = None
) -> DataFrame:
    """`county_id` by exact normalised name or by code, and a `county_found` flag.

    The name of a county is compared in its normalised form; the lowest id wins.
    """
    if (name is None) == (code is None):
        raise ValueError("give either name or code")
    wanted = normal_name(name) if name is not None else code
    stored = normal_name(F.col("name")) if name is not None else F.col("code")
    lookup = county.groupBy(stored.alias("__wanted")).agg(F.min("id").alias("county_id"))
    return (
        df.withColumn("__wanted", wanted)
        .join(lookup, "__wanted", "left")
        .drop("__wanted")
        .withColumn("county_found", F.col("county_id").isNotNull())
    )


GRAM = 3


def _runs(name: Column, size: int) -> Column:
    """All runs of `size` letters of a text that has at least as many."""
    starts = F.sequence(F.lit(1), F.length(name) - (size - 1))
    return F.when(F.length(name) >= size, F.transform(starts, lambda at: F.substring(name, at, F.lit(size))))


def _names_by_run(names: DataFrame) -> DataFrame:
    """(county, run) -> ids and names that contain it.

    A text of GRAM letters or more is looked up by a run of GRAM letters. Shorter texts are runs themselves, so for
    those the lowest id is the answer and the list has one entry.
    """
    every = F.concat(
        F.array(F.lit("")), *[F.coalesce(_runs(F.col("__name"), n), F.array().cast("array<string>")) for n in range(1, GRAM + 1)]
    )
    entry = F.struct(F.col("__id").alias("id"), F.col("__name").alias("name"))
    exploded = names.select("__in", entry.alias("__entry"), F.explode(F.array_distinct(every)).alias("__run"))
    short = F.length("__run") < GRAM
    first, longer = F.min(F.when(short, F.col("__entry"))), F.collect_list(F.when(~short, F.col("__entry")))
    return exploded.groupBy("__in", "__run").agg(F.when(first.isNotNull(), F.array(first)).otherwise(longer).alias("__names"))


def _lowest_holding(names: Column, text: Column) -> Column:
    return F.array_min(F.transform(F.filter(names, lambda n: F.contains(n["name"], text)), lambda n: n["id"]))


def find_contained(
    df: DataFrame, city: DataFrame, texts: list[Column], within: Column | None, out: str, name: str = "name"
) -> DataFrame:
    """The lowest id of a city whose name contains the first text, else of one that contains the next, ...; else NULL.

    Inside a county when `within` is given. Compared as names are: without case and accents. Rows are read once: each
    text of a row looks up the names that share its rarest run of GRAM letters, of which one list per county and
    run is kept, and the names of the list are compared in the row. The row side is the one that may be skewed. A list is as
    long as the names of one county with the same run; texts that are shorter than a run need one entry only.
    """
    names = city.select(
        (F.lit(0) if within is None else F.col("county_id")).alias("__in"),
        F.col("id").alias("__id"),
        normal_name(F.col(name)).alias("__name"),
    ).filter("__name IS NOT NULL AND __in IS NOT NULL")
    levels = piece_levels(names.select(F.explode(F.array_distinct(_runs(F.col("__name"), GRAM)))))
    index = _names_by_run(names)
    rows = df.withColumn("__in", F.lit(0) if within is None else within)
    rows = rows.withColumns({f"__text{k}": normal_name(text) for k, text in enumerate(texts)})
    found = []
    for k in range(len(texts)):
        text = F.col(f"__text{k}")
        if k:
            # A text that was tried already is not tried again.
            text = F.when(~F.coalesce(text.eqNullSafe(F.col(f"__text{k - 1}")), F.lit(False)), text)
        run = F.when(F.length(text) < GRAM, text).otherwise(F.get(by_rarity(_runs(text, GRAM), levels), 0)["piece"])
        list_k = index.select(F.col("__in"), F.col("__run").alias(f"__run{k}"), F.col("__names").alias(f"__names{k}"))
        rows = rows.withColumn(f"__run{k}", run).join(list_k, ["__in", f"__run{k}"], "left")
        found.append(_lowest_holding(F.col(f"__names{k}"), F.col(f"__text{k}")))
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    return rows.select(*kept, F.coalesce(*found).alias(out))


def resolve_city(
    df: DataFrame,
    city: DataFrame,
    text: Column,
    county_id: Column | None = None,
    default_county_id: Column | None = None,
    name: str = "name",
) -> DataFrame:
    """`city_id` of the first city whose name contains the text, inside the county when one is given.

    `default_county_id` stands in for an unknown county. When the text is not found, it is tried again
    with `-` replaced by a space. Case and accents do not count.
    """
    within = county_id
    if within is not None and default_county_id is not None:
        within = F.coalesce(county_id, default_county_id)
    spaced = F.replace(text, F.lit("-"), F.lit(" "))
    return find_contained(df, city, [text, spaced], within, "city_id", name)


def resolve_city_prefix(df: DataFrame, city: DataFrame, text: Column, county_id: Column, name: str = "name") -> DataFrame:
    """`city_id` by the text before the first `-`, plus `-`, inside the county. Case and accents do not count."""
    wanted = F.concat(F.substring_index(text, "-", 1), F.lit("-"))
    return find_contained(df, city, [wanted], county_id, "city_id", name)


def skip_known(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not stored yet."""
    return new.join(existing.select(key).distinct(), key, "left_anti")


def first_platform(platforms: DataFrame, key: str = "geo_hash_id") -> DataFrame:
    """key -> URL of its first platform row."""
    return platforms.groupBy(key).agg(F.min_by("url", "id").alias("platform_url"))


def place_columns() -> list[Column]:
    """Coordinates and city as compared.

    An unknown one equals an unknown one, so each has a value no known one can have.
    """
    return [
        F.coalesce(grid_point(F.col("latitude")), F.lit(NO_VALUE)).alias("__lat"),
        F.coalesce(grid_point(F.col("longitude")), F.lit(NO_VALUE)).alias("__lon"),
        F.coalesce("city_id", F.lit(NO_VALUE)).alias("__city"),
    ]


def match_points(rows: DataFrame, points: DataFrame, platforms: DataFrame, url_prefix: str) -> DataFrame:
    """Rows with the points at the same place.

    `points_here` says that any point has the row's coordinates and city. `matches` counts those
    whose first platform URL is prefix + url; `point_id` is the lowest of them and `point_key` its key.
    The URL is part of the join key, so rows and points at one hot coordinate are not paired with
    each other.
    """
    place = place_columns()
    known = points.join(first_platform(platforms), "geo_hash_id", "left").select(
        *place, "id", "geo_hash_id", F.col("platform_url").alias("__url")
    )
    on_place = ["__lat", "__lon", "__city"]
    here = known.select(*on_place).distinct().withColumn("__here", F.lit(True))
    same = known.filter("__url IS NOT NULL").groupBy(*on_place, "__url").agg(
        F.count("*").alias("matches"),
        F.min("id").alias("point_id"),
        F.min_by("geo_hash_id", "id").alias("point_key"),
    )
    return (
        rows.select("*", *place, F.concat(F.lit(url_prefix), F.col("url")).alias("__url"))
        .join(here, on_place, "left")
        .join(same, [*on_place, "__url"], "left")
        .withColumn("points_here", F.coalesce("__here", F.lit(False)))
        .withColumn("matches", F.coalesce("matches", F.lit(0).cast("bigint")))
        .drop(*on_place, "__url", "__here")
    )


def match_with_fallback(posts: DataFrame, points: DataFrame) -> DataFrame:
    """`point_id` by coordinates, else by title; `match_kind` is coordinates, title or missing."""
    by_place = points.groupBy(
        grid_point(F.col("latitude")).alias("__lat"), grid_point(F.col("longitude")).alias("__lon")
    ).agg(F.min("id").alias("__by_place"))
    by_title = points.groupBy(F.col("title").alias("__title")).agg(F.min("id").alias("__by_title"))
    matched = (
        posts.withColumn("__lat", grid_point(F.col("latitude")))
        .withColumn("__lon", grid_point(F.col("longitude")))
        .join(by_place, ["__lat", "__lon"], "left")
        # Only posts without a place match look for a title; the others join nothing.
        .withColumn("__title", F.when(F.col("__by_place").isNull(), F.col("title")))
        .join(by_title, "__title", "left")
    )
    return (
        matched.withColumn("point_id", F.coalesce("__by_place", "__by_title"))
        .withColumn(
            "match_kind",
            F.when(F.col("__by_place").isNotNull(), "coordinates")
            .when(F.col("__by_title").isNotNull(), "title")
            .otherwise("missing"),
        )
        .drop("__lat", "__lon", "__title", "__by_place", "__by_title")
    )


def find_term(df: DataFrame, terms: DataFrame, name: Column, taxonomy: str | None = None) -> DataFrame:
    """`term_id` and `term_taxonomy` of the first term with exactly this name."""
    if taxonomy is not None:
        terms = terms.filter(F.col("taxonomy") == taxonomy)
    lookup = terms.groupBy(F.col("name").alias("__name")).agg(
        F.min(F.struct("taxonomy", "term_id")).alias("__term")
    )
    return (
        df.withColumn("__name", name)
        .join(lookup, "__name", "left")
        .select(
            *df.columns,
            F.col("__term.term_id").alias("term_id"),
            F.col("__term.taxonomy").alias("term_taxonomy"),
        )
    )


def join_first_term(posts: DataFrame, terms: DataFrame, ids: Column, taxonomy: str = "locations") -> DataFrame:
    """The term of the first id in a list; later ids are not looked at."""
    lookup = (
        terms.filter(F.col("taxonomy") == taxonomy)
        .groupBy(F.col("term_id").alias("first_term_id"))
        .agg(F.min("name").alias("location"))
    )
    return posts.withColumn("first_term_id", F.get(ids, 0)).join(lookup, "first_term_id", "left")


def photo_folders(files: DataFrame) -> DataFrame:
    """folder -> number of files; `path` is relative to the image root."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("file_count"))


def join_photos(points: DataFrame, files: DataFrame, old_files: DataFrame) -> DataFrame:
    """The image folder of each point: the present layout, else the old one (`moved`), else none.

    Points need city_name, county_name and title.
    """
    city, county, title = F.col("city_name"), F.col("county_name"), F.col("title")
    now = photo_folders(files).select(F.col("folder").alias("__now"), F.col("file_count").alias("__n"))
    old = photo_folders(old_files).select(F.col("folder").alias("__old"), F.col("file_count").alias("__m"))
    joined = (
        points.withColumn("__now", place_path(county, city, title))
        .join(now, "__now", "left")
        .withColumn("__old", F.when(F.col("__n").isNull(), old_place_path(city, title)))
        .join(old, "__old", "left")
    )
    return (
        joined.withColumn("moved", F.col("__n").isNull() & F.col("__m").isNotNull())
        .withColumn("photo_folder", F.when(F.col("moved"), F.col("__old")).when(F.col("__n").isNotNull(), F.col("__now")))
        .withColumn("file_count", F.coalesce("__n", "__m", F.lit(0).cast("bigint")))
        .drop("__now", "__old", "__n", "__m")
    )
