"""First, top-k and numbering per group, and lists collected in chunks of bounded size.

Group limits (`row_number() <= k`) are pushed below the shuffle by Spark, so a hot key sends at most
k rows per map task. Full numbering cannot be limited that way; there rows are dealt by ranges of key and order and sorted
once, and a row's number is its place in its range, shifted by the rows of the key in the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

# Spark pushes group limits down up to this number of rows (spark.sql.optimizer.windowGroupLimitThreshold).
PUSHED_LIMIT = 1000
# Parts of a key in the first step of a larger limit.
LIMIT_PARTS = 64


def _orders(order) -> list:
    return [order] if isinstance(order, (str, Column)) else list(order)


def first_per_key(df: DataFrame, key: list[str], order) -> DataFrame:
    return top_k_per_key(df, key, order, 1)


def top_k_per_key(df: DataFrame, key: list[str], order, k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key; `rank` names an optional 1-based number column.

    Limits that Spark does not push down are applied to parts of each key first, so a hot key is not sorted by one task.
    """
    name, orders = rank or "__rank", _orders(order)
    if k > PUSHED_LIMIT:
        parts = Window.partitionBy(*key, "__part").orderBy(*orders)
        df = df.withColumn("__part", F.floor(F.rand(1) * LIMIT_PARTS)).withColumn("__first", F.row_number().over(parts))
        df = df.filter(F.col("__first") <= k).drop("__part", "__first")
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*orders))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def _ranged(df: DataFrame, key: list[str], orders: list) -> DataFrame:
    """The rows as a written table with the number of their range of key and order, and their place in it (from 0).

    Rows are dealt by ranges and sorted there, so a row's place is that in its range's file. A digest of the row comes
    last in the order: rows that tie are not all of one range, and their numbers do not change from run to run.
    """
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    orders = [*key, *orders, F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c in plain])]
    dealt = df.repartitionByRange(*orders).sortWithinPartitions(*orders)
    # The low 33 bits of this id count the rows of a partition.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return written(dealt.select("*", F.spark_partition_id().alias("__part"), place.alias("__n")), "ranges")


def number_within(
    df: DataFrame, key: list[str], order, name: str = "n", start: int = 0, bounded: bool = False
) -> DataFrame:
    """Running number of each row in its group.

    `bounded=True` says that a group cannot grow with the data (cells of one table row, links of one page); then the
    numbering is one window. The order may be of any type, with columns or sort expressions; NULL keys are a group.
    """
    orders = _orders(order)
    if bounded:
        plain = F.row_number().over(Window.partitionBy(*key).orderBy(*orders))
        return df.withColumn(name, plain + F.lit(start - 1))
    ranged = _ranged(df, key, orders)
    earlier = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # Rows of a group in the ranges before, less the place where it begins in this one.
    shift = F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first")
    shifts = (
        ranged.groupBy(*key, "__part")
        .agg(F.count("*").alias("__rows"), F.min("__n").alias("__first"))
        .select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col("__part").alias("__p"), shift.alias("__shift"))
    )
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)]
    numbered = ranged.join(shifts, [*on, F.col("__part") == F.col("__p")])
    return numbered.select(*df.columns, (F.col("__n") + F.col("__shift") + F.lit(start)).alias(name))


def _numbered_parts(parts: DataFrame, name: str, start: int) -> DataFrame:
    """Rows with their place (from 0) in a numbered part, `__n` and `__part` -> running number over all parts."""
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        parts.groupBy("__part")
        .agg(F.count("*").alias("__rows"))
        .select(F.col("__part").alias("__p"), F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    )
    # One row per part; there are as many parts as shuffle partitions or slices.
    joined = parts.join(F.broadcast(before), F.col("__part") == F.col("__p"))
    kept = [c for c in parts.columns if c not in ("__part", "__n")]
    return joined.select(*kept, (F.col("__n") + F.col("__before") + F.lit(start)).alias(name))


def number_all(df: DataFrame, order, name: str = "n", start: int = 0) -> DataFrame:
    """Running number over the whole input without gathering it: ranges of the order, shifted by the rows before."""
    return _numbered_parts(_ranged(df, [], _orders(order)), name, start)


SLICES = 4096


def number_by_hash(df: DataFrame, key: list[str], name: str = "n", start: int = 0) -> DataFrame:
    """Running number in the order of a hash of the key, which should be unique: any fixed order will do.

    Hashes fill their range evenly, so equal slices of it need no sample of the input, which is computed once.
    """
    hash_ = F.xxhash64(*key)
    sliced = df.withColumn("__part", F.shiftright(hash_, 64 - (SLICES.bit_length() - 1)).cast("int"))
    ordered = Window.partitionBy("__part").orderBy(hash_, *key)
    return _numbered_parts(written(sliced.withColumn("__n", F.row_number().over(ordered) - 1), "slices"), name, start)


def collect_in_chunks(
    df: DataFrame, key: list[str], order, value: Column, chunk_rows: int, name: str = "items", bounded: bool = False
) -> DataFrame:
    """Ordered lists per key, at most `chunk_rows` long: key, chunk (0, 1, ...), list.

    Where one row per item will do, `number_within` is the form without a limit.
    """
    numbered = number_within(df.withColumn("__value", value), key, order, name="__pos", bounded=bounded)
    return (
        numbered.withColumn("chunk", F.floor(F.col("__pos") / chunk_rows))
        .groupBy(*key, "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("__pos", "__value"))).alias("__list"))
        .select(*key, "chunk", F.transform("__list", lambda x: x["__value"]).alias(name))
    )
