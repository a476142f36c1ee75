"""Counts, reports, grouped lists and key/value conversion over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates
from .registry import query, table


@query(
    "a1_incomplete_groups",
    """WITH s AS (SELECT c_nationkey, count(*) AS stored FROM customer GROUP BY c_nationkey)
       SELECT n_nationkey, 50 + n_nationkey AS declared, coalesce(stored, 0) AS stored
       FROM nation LEFT JOIN s ON c_nationkey = n_nationkey WHERE 50 + n_nationkey <> coalesce(stored, 0)""",
)
def a1(spark, sf):
    expected = table(spark, sf, "nation").select("n_nationkey", (50 + F.col("n_nationkey")).alias("declared"))
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return aggregates.incomplete_groups(expected, rows, "n_nationkey")


@query(
    "a2_duplicate_report",
    "SELECT user_id, event_type, count(*) AS copies FROM events GROUP BY ALL HAVING count(*) > 1",
)
def a2(spark, sf):
    return aggregates.duplicate_report(table(spark, sf, "events"), ["user_id", "event_type"])


@query(
    "a3_key_uniqueness",
    """SELECT count(*) AS row_count, count(DISTINCT o_custkey) AS key_count,
              count(*) - count(DISTINCT o_custkey) AS repeated FROM orders""",
)
def a3(spark, sf):
    return aggregates.key_uniqueness(table(spark, sf, "orders"), "o_custkey")


@query(
    "a4_group_items",
    """WITH n AS (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 50 AS chunk FROM part)
       SELECT p_brand, chunk::BIGINT AS chunk, '["' || string_agg(p_name, '","' ORDER BY p_partkey) || '"]' AS items
       FROM n GROUP BY p_brand, chunk""",
)
def a4(spark, sf):
    return aggregates.group_items(table(spark, sf, "part"), ["p_brand"], "p_name", "p_partkey", chunk_rows=50)


@query(
    "a5_concat_text",
    """SELECT conv_id, 0::BIGINT AS chunk, string_agg(text, '' ORDER BY turn) AS text
       FROM conversations GROUP BY conv_id""",
)
def a5(spark, sf):
    return aggregates.concat_text(table(spark, sf, "conversations"), ["conv_id"], "turn", "text", chunk_rows=1000)


@query(
    "a7_first_value_by_label",
    """SELECT l_orderkey, l_returnflag, l_partkey FROM (SELECT *, row_number() OVER
         (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1""",
)
def a7(spark, sf):
    return aggregates.first_value_by_label(
        table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag", "l_partkey", ["l_linenumber", "l_partkey"]
    )


MAPPING = {"customer": "city_id", "status": "types", "priority": "rate", "total": "address_coord"}


def order_fields(spark, sf):
    """orders as key/value rows: known keys under their field names, one unknown key, one key twice."""
    orders = table(spark, sf, "orders")

    def field(pos, key, value):
        return F.struct(F.lit(pos).alias("pos"), F.lit(key).alias("key"), value.cast("string").alias("value"))

    fields = F.array(
        field(0, "status", F.lit("overwritten")),
        field(1, "customer", F.col("o_custkey")),
        field(2, "status", F.col("o_orderstatus")),
        field(3, "unknown", F.col("o_orderkey")),
        field(4, "priority", F.col("o_orderpriority")),
        field(5, "total", F.col("o_totalprice").cast("decimal(12,2)")),
    )
    return orders.select(F.col("o_orderkey").alias("post_id"), F.explode(fields).alias("f")).select("post_id", "f.*")


@query(
    "a8_unpack_fields",
    """SELECT o_orderkey AS post_id, o_custkey::VARCHAR AS city_id, o_orderstatus AS types, o_orderpriority AS rate,
              o_totalprice::DECIMAL(12,2)::DOUBLE AS address_coord FROM orders""",
)
def a8(spark, sf):
    wide = aggregates.unpack_fields(order_fields(spark, sf), MAPPING)
    typed = aggregates.typed_fields(wide, ["address_coord"])
    return typed.withColumn("address_coord", F.col("address_coord.number"))


@query(
    "a9_pack_fields",
    """SELECT o_orderkey AS post_id, unnest(['customer', 'status', 'priority', 'total']) AS key,
              unnest(['a:2:{i:0;i:' || o_custkey || ';i:1;i:' || o_orderkey || ';}', o_orderstatus, o_orderpriority,
                      o_totalprice::DECIMAL(12,2)::VARCHAR]) AS value FROM orders""",
)
def a9(spark, sf):
    wide = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("post_id"),
        F.array("o_custkey", "o_orderkey").alias("city_id"),
        F.col("o_orderstatus").alias("types"),
        F.col("o_orderpriority").alias("rate"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("address_coord"),
    )
    return aggregates.pack_fields(wide, MAPPING)
