"""Row selection: match, like and exclude filters, column lists, limits, line and link filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import filter_components
from ..functions.text import is_quality_line, squash_spaces
from ..functions.web import is_valid_link, without_fragment


def _condition(name: str, value, mode: str) -> Column:
    column = F.col(name)
    if mode == "match":
        return column.eqNullSafe(F.lit(value))
    if isinstance(value, str):
        found = F.contains(F.lower(column), F.lower(F.lit(value)))
        return found if mode == "like" else ~found
    same = column.eqNullSafe(F.lit(value))
    return same if mode == "like" else ~same


def select_rows(
    df: DataFrame,
    match: dict | None = None,
    mode: str = "match",
    columns: list[str] | None = None,
    limit: int | None = None,
    order: str = "id",
) -> DataFrame:
    """Rows that satisfy every entry of `match`.

    `match`: equal (None is IS NULL). `like`: text contains the value, in any case. `exclude`: text
    does not contain it (a NULL text is dropped), other values are different or NULL. With `limit`
    the lowest values of `order` are kept.
    """
    if mode not in ("match", "like", "exclude"):
        raise ValueError(f"unknown mode {mode!r}")
    for name, value in (match or {}).items():
        df = df.filter(_condition(name, value, mode))
    if limit is not None:
        df = df.orderBy(order).limit(int(limit))
    return df.select(*columns) if columns else df


def first_row(df: DataFrame, match: dict | None = None, mode: str = "match", order: str = "id") -> DataFrame:
    """The matching row with the lowest `order`, or no row."""
    return select_rows(df, match, mode, limit=1, order=order)


def valid_links(
    df: DataFrame,
    seed_url,
    url: str = "url",
    exts=("htm", "php"),
    strip_fragment: bool = False,
    pattern: str | None = None,
) -> DataFrame:
    """Links on the seed's host with an allowed extension; `pattern` refuses endings in place of `exts`."""
    seed = seed_url if isinstance(seed_url, Column) else F.lit(seed_url)
    out = df.filter(is_valid_link(F.col(url), seed, exts, pattern))
    return out.withColumn(url, without_fragment(F.col(url))) if strip_fragment else out


def quality_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line of `text` that reads like prose; `line` is the squashed line."""
    lines = df.withColumn("line", F.explode(F.split(F.col(text), "\n"))).drop(text)
    return lines.withColumn("line", squash_spaces("line")).filter(is_quality_line(F.col("line")))


def needs_enrichment(df: DataFrame, stage: str = "new") -> DataFrame:
    """Rows of a stage without an address; flags say what is missing."""
    return df.filter((F.col("stage") == stage) & F.col("address").isNull()).select(
        "*",
        (F.col("address").isNull() | F.col("city_id").isNull()).alias("needs_address"),
        F.col("geo_hash_id").isNull().alias("needs_key"),
    )


def keep_address_components(df: DataFrame, components: str = "address_components") -> DataFrame:
    return df.withColumn(components, filter_components(F.col(components)))

