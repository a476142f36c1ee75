"""Counts, reports, grouped lists, first values and key/value <-> wide conversion.

Every aggregate here has a map-side part, so a hot key reaches the shuffle as one row per task; lists
go through `collect_in_chunks`, which never holds more than a chunk of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import encode_id_list, infer_value
from .windows import collect_in_chunks

# Fixed value: custom field name of a post -> column name of a point.
POST_FIELDS = {
    "city": "city_id",
    "coordinates_lat": "latitude",
    "coordinates_long": "longitude",
    "geo_hash_id": "geo_hash_id",
    "rate": "rate",
    "place_id": "place_id",
    "address": "address_coord",
}


def incomplete_groups(expected: DataFrame, rows: DataFrame, key: str, declared: str = "declared") -> DataFrame:
    """Groups whose declared count differs from the stored count."""
    stored = rows.groupBy(key).agg(F.count("*").alias("stored"))
    return (
        expected.join(stored, key, "left")
        .withColumn("stored", F.coalesce("stored", F.lit(0).cast("bigint")))
        .filter(~F.col(declared).eqNullSafe(F.col("stored")))
    )


def duplicate_report(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1")


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, rows that repeat a key."""
    sizes = df.groupBy(key).agg(F.count("*").alias("__n"))
    return sizes.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"),
        F.count(key).alias("key_count"),
    ).withColumn("repeated", F.col("row_count") - F.col("key_count"))


def group_items(df: DataFrame, heading: list[str], item: str, order: str, chunk_rows: int) -> DataFrame:
    """Heading -> ordered items as JSON text, in chunks of at most `chunk_rows` items."""
    lists = collect_in_chunks(df, heading, order, F.col(item), chunk_rows)
    return lists.withColumn("items", F.to_json("items"))


def concat_text(df: DataFrame, key: list[str], order, text: str, chunk_rows: int) -> DataFrame:
    """Ordered texts joined without a separator, in chunks of at most `chunk_rows` pieces."""
    lists = collect_in_chunks(df, key, order, F.col(text), chunk_rows, "__texts")
    return lists.select(*key, "chunk", F.array_join("__texts", "").alias(text))


def first_value_by_label(df: DataFrame, key: list[str], label: str, value: str, order) -> DataFrame:
    """The value with the lowest `order` (a column or several) per key and label."""
    position = F.struct(*([order] if isinstance(order, str) else order))
    return df.groupBy(*key, label).agg(F.min_by(value, position).alias(value))


def unpack_fields(
    fields: DataFrame,
    mapping: dict[str, str] = POST_FIELDS,
    post_id: str = "post_id",
    order: str = "pos",
) -> DataFrame:
    """Key/value rows -> one wide text record per post; unknown keys are dropped, the last value wins."""
    known = fields.filter(F.col("key").isin(*mapping))
    return known.groupBy(post_id).agg(
        *[
            F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col(order))).alias(c)
            for k, c in mapping.items()
        ]
    )


def typed_fields(record: DataFrame, columns) -> DataFrame:
    """Replace text columns of an unpacked record by their inferred struct(ids, number, text)."""
    return record.withColumns({c: infer_value(F.col(c)) for c in columns})


def pack_fields(record: DataFrame, mapping: dict[str, str] = POST_FIELDS, post_id: str = "post_id") -> DataFrame:
    """Wide record -> key/value rows under the inverted mapping; NULLs give no row."""
    kinds = {f.name: f.dataType.typeName() for f in record.schema.fields}
    inverse = {c: k for k, c in mapping.items() if c in kinds}

    def as_text(c: str) -> Column:
        return encode_id_list(F.col(c)) if kinds[c] == "array" else F.col(c).cast("string")

    pairs = F.array(
        *[F.struct(F.lit(k).alias("key"), as_text(c).alias("value")) for c, k in inverse.items()]
    )
    return (
        record.select(post_id, F.explode(pairs).alias("f"))
        .select(post_id, "f.key", "f.value")
        .filter("value IS NOT NULL")
    )


def crawl_progress(visited: DataFrame) -> DataFrame:
    """Pages visited, failed and queued per round of a crawl."""
    return visited.groupBy("round").agg(
        F.count("*").alias("queued"),
        F.count_if(F.col("ok")).alias("visited"),
        F.count_if(~F.col("ok")).alias("failed"),
    )
