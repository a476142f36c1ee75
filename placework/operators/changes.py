"""Table changes: each function returns the new state of the target table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .windows import first_per_key, number_all, number_by_hash


def upsert(target: DataFrame, rows: DataFrame, key: str = "id", ordinal: str | None = None) -> DataFrame:
    """Merge by key; among rows with the same key the one with the highest ordinal counts.

    Without `ordinal` the rows must be unique by key already.
    """
    if ordinal:
        rows = first_per_key(rows, [key], F.col(ordinal).desc()).drop(ordinal)
    return target.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def insert_ignore(target: DataFrame, rows: DataFrame, key: str, ordinal) -> DataFrame:
    """Add rows whose key is new; among rows with the same key the first ordinal is written."""
    return target.unionByName(fresh_rows(target, rows, key, ordinal), allowMissingColumns=True)


def fresh_rows(target: DataFrame, rows: DataFrame, key: str, ordinal) -> DataFrame:
    """The rows `insert_ignore` adds; `ordinal` is one column name or several."""
    ordinals = [ordinal] if isinstance(ordinal, str) else list(ordinal)
    known = target.select(key).distinct()
    return first_per_key(rows.join(known, key, "left_anti"), [key], ordinals).drop(*ordinals)


def assign_ids(rows: DataFrame, stored: DataFrame, order, key: str = "id") -> DataFrame:
    """Ids that follow the highest stored one, in the order of the rows."""
    highest = stored.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).scalar()
    return number_all(rows.drop(key), order, name=key, start=1).withColumn(key, F.col(key) + highest)


def assign_ids_by_hash(rows: DataFrame, stored: DataFrame, unique: list[str], key: str = "id") -> DataFrame:
    """The same in the order of a hash of columns that are unique together; rows are computed once."""
    highest = stored.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).scalar()
    return number_by_hash(rows.drop(key), unique, name=key, start=1).withColumn(key, F.col(key) + highest)


def replace_children(
    stored: DataFrame, fresh: DataFrame, slots: DataFrame, on: list[str], passing: tuple[str, ...] = (), key: str = "id"
) -> DataFrame:
    """The child table after the rows of some slots were read again.

    A slot is what is replaced as a whole, named by the columns `on`: all children of a parent, or those of one type.
    Stored rows of the given slots go, fresh rows come; rows of other slots stay as they are. A fresh row equal to a
    stored one of its slot in all columns but the key and the `passing` ones (time stamps) keeps that row's key, others
    get keys that follow the highest stored one, in the order of the columns. So the same rows read twice change nothing.
    Equal fresh rows are one. Fresh rows of a slot that is not given are not written; a NULL in `on` is a value.
    """
    columns = [c for c in stored.columns if c != key]
    compared = [c for c in columns if c not in passing]
    missing = [F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in columns if c not in fresh.columns]
    present = [F.col(c).cast(stored.schema[c].dataType).alias(c) for c in columns if c in fresh.columns]
    changed = slots.select(*[F.col(c).alias(f"__{c}") for c in on]).distinct()

    def of_slot(rows: DataFrame) -> list:
        return [rows[c].eqNullSafe(changed[f"__{c}"]) for c in on]

    incoming = fresh.select(*present, *missing)
    incoming = incoming.join(changed, of_slot(incoming), "left_semi")
    latest = [F.max(c).alias(c) for c in columns if c in passing]
    incoming = incoming.groupBy(*compared).agg(*latest) if latest else incoming.distinct()
    out_of_place = stored.join(changed, of_slot(stored), "left_semi")
    known = out_of_place.groupBy(*[F.col(c).alias(f"__{c}") for c in compared]).agg(F.min(key).alias(key))
    same = [incoming[c].eqNullSafe(known[f"__{c}"]) for c in compared]
    matched = written(incoming.join(known, same, "left").select(key, *columns), "children")
    again = matched.filter(F.col(key).isNotNull())
    added = assign_ids(matched.filter(F.col(key).isNull()), stored, compared, key)
    kept = stored.join(changed, of_slot(stored), "left_anti")
    return kept.unionByName(again).unionByName(added)


def delete_by_id(target: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return target.join(ids.select(key).distinct(), key, "left_anti")


def update_by_id(
    target: DataFrame, changes: DataFrame, key: str = "id", ordinal: str | None = None
) -> DataFrame:
    """Set columns of given ids.

    `changes` has the key, the columns to set and `set_columns ARRAY<STRING>`, which names the
    columns that this row sets, so that NULL can be written. Of several rows for a key the one with the
    highest ordinal counts; without `ordinal` the changes must be unique by key already.
    """
    if ordinal:
        changes = first_per_key(changes, [key], F.col(ordinal).desc())
    settable = [c for c in changes.columns if c in target.columns and c != key]
    incoming = changes.select(
        key, F.col("set_columns").alias("__set"), *[F.col(c).alias(f"__new_{c}") for c in settable]
    )
    joined = target.join(incoming, key, "left")
    return joined.select(
        *[
            F.when(F.array_contains("__set", c), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)
            if c in settable
            else F.col(c)
            for c in target.columns
        ]
    )


def key_changes(parents: DataFrame, new_key, key: str = "geo_hash_id", order: str = "id") -> DataFrame:
    """old_key -> new_key for parents whose recomputed key differs; one row per old key."""
    moved = parents.withColumn("new_key", new_key).filter(~F.col(key).eqNullSafe(F.col("new_key")))
    return first_per_key(
        moved.select(F.col(key).alias("old_key"), "new_key", order).filter("old_key IS NOT NULL"),
        ["old_key"],
        order,
    ).drop(order)


def rekey(
    parents: DataFrame,
    children: DataFrame,
    new_key,
    key: str = "geo_hash_id",
    order: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """Parents with recomputed keys, and their children carried along.

    The parents need no join; the child side is the stream side of a join with one row per old key, so
    the children of a hot parent can be split over tasks.
    """
    changes = key_changes(parents, new_key, key, order)
    moved = (
        children.join(changes, F.col(key) == F.col("old_key"), "left")
        .withColumn(key, F.coalesce("new_key", key))
        .drop("old_key", "new_key")
    )
    return parents.withColumn(key, new_key), moved
