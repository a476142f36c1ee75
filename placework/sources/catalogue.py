"""The relational catalogue as typed tables: load, save, and the rules of its keys."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CATALOGUE, FOREIGN_KEYS, PRIMARY_KEY

# Rows of a table that one task reads from a database.
ROWS_PER_TASK = 1_000_000


class BrokenKeys(ValueError):
    """Rows that break a rule of the catalogue's keys."""


def _typed(df: DataFrame, name: str) -> DataFrame:
    have = set(df.columns)
    fields = T.StructType.fromDDL(CATALOGUE[name]).fields
    return df.select(
        *[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )


def key_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rule, column, value, rows: what breaks the keys of the given catalogue tables.

    Rules: `missing` (no primary key), `repeated` (a primary key of several rows), `unknown` (a reference to a row that
    its parent table does not have; NULL refers to nothing). References to tables that are not given are not
    looked at. Rows are counted per value before they meet the parent keys, so a value that many rows share is one.
    """
    found = []
    for name, df in tables.items():
        counted = df.groupBy(PRIMARY_KEY).agg(F.count("*").alias("rows"))
        rule = F.when(F.col(PRIMARY_KEY).isNull(), "missing").otherwise("repeated")
        found.append(
            counted.filter((F.col("rows") > 1) | F.col(PRIMARY_KEY).isNull()).select(
                F.lit(name).alias("table"), rule.alias("rule"), F.lit(PRIMARY_KEY).alias("column"),
                F.col(PRIMARY_KEY).cast("string").alias("value"), "rows",
            )
        )
        for column, parent, parent_column in FOREIGN_KEYS[name]:
            if parent not in tables:
                continue
            said = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
            keys = tables[parent].select(F.col(parent_column).alias("value")).distinct()
            found.append(
                said.join(keys, "value", "left_anti").select(
                    F.lit(name).alias("table"), F.lit("unknown").alias("rule"), F.lit(column).alias("column"),
                    F.col("value").cast("string").alias("value"), "rows",
                )
            )
    return functools.reduce(DataFrame.unionByName, found)


def check_keys(tables: dict[str, DataFrame]) -> None:
    """Raise BrokenKeys when a key rule is broken."""
    broken = key_violations(tables).orderBy("table", "rule", "column", "value").limit(10).collect()
    if broken:
        said = "; ".join(f"{r['table']}.{r['column']} = {r['value']}: {r['rule']} ({r['rows']} rows)" for r in broken)
        raise BrokenKeys(f"first broken keys: {said}")


def jdbc_ranges(low: int | None, high: int | None, rows: int, rows_per_task: int = ROWS_PER_TASK) -> dict[str, str]:
    """Reader options that split a table by its primary key, from the key's range and the number of rows."""
    parts = -(-rows // rows_per_task)
    if low is None or parts <= 1:
        return {}
    return {
        "partitionColumn": PRIMARY_KEY, "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(parts),
    }


def _from_database(spark: SparkSession, jdbc: dict, name: str, rows_per_task: int) -> DataFrame:
    reader = spark.read.format("jdbc").options(**jdbc)
    if "partitionColumn" not in jdbc:
        ends = f"SELECT MIN({PRIMARY_KEY}) AS low, MAX({PRIMARY_KEY}) AS high, COUNT(*) AS n FROM {name}"
        low, high, rows = reader.option("query", ends).load().first()
        reader = spark.read.format("jdbc").options(**jdbc, **jdbc_ranges(low, high, rows, rows_per_task))
    return _typed(reader.option("dbtable", name).load(), name)


def load_catalogue(
    spark: SparkSession,
    path: str | None = None,
    jdbc: dict | None = None,
    tables=None,
    check: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> dict[str, DataFrame]:
    """Typed catalogue tables from a folder of parquet tables, or from a database.

    `jdbc` holds reader options (url, driver, ...); a table is read in ranges of its primary key, of about `rows_per_task`
    rows when keys are dense. With `check` broken keys raise BrokenKeys.
    """
    names = list(tables or CATALOGUE)
    if jdbc is not None:
        out = {name: _from_database(spark, jdbc, name, rows_per_task) for name in names}
    else:
        out = {name: spark.read.schema(CATALOGUE[name]).parquet(f"{path.rstrip('/')}/{name}") for name in names}
    if check:
        check_keys(out)
    return out


def save_table(df: DataFrame, path: str, name: str, mode: str = "overwrite") -> None:
    """Write a catalogue table with its fixed columns and types."""
    _typed(df, name).write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")


def save_catalogue(tables: dict[str, DataFrame], path: str, check: bool = True) -> None:
    """Write catalogue tables; with `check` nothing is written when the keys are broken."""
    if check:
        check_keys({name: _typed(df, name) for name, df in tables.items()})
    for name, df in tables.items():
        save_table(df, path, name)
