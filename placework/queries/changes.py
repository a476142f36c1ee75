"""Table changes over whole tables; the full new state is compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.records import hash_key
from ..operators import changes
from .registry import query, table


def _customer_rows(spark, sf):
    """Incoming rows: changed customers and new ones, each key twice with ordinals."""
    customer = table(spark, sf, "customer").filter("c_nationkey < 8")
    changed = customer.withColumn("c_mktsegment", F.lit("CHANGED")).withColumn("ordinal", F.lit(1))
    again = customer.withColumn("c_mktsegment", F.lit("LATER")).withColumn("ordinal", F.lit(2))
    both = changed.unionByName(again)
    return both.unionByName(both.withColumn("c_custkey", F.col("c_custkey") + 100000000))


@query(
    "m1_upsert",
    """SELECT * FROM customer WHERE c_nationkey >= 8
       UNION ALL SELECT * REPLACE ('LATER' AS c_mktsegment) FROM customer WHERE c_nationkey < 8
       UNION ALL SELECT * REPLACE ('LATER' AS c_mktsegment, c_custkey + 100000000 AS c_custkey)
                 FROM customer WHERE c_nationkey < 8""",
)
def m1(spark, sf):
    return changes.upsert(table(spark, sf, "customer"), _customer_rows(spark, sf), "c_custkey", "ordinal")


@query(
    "m2_insert_ignore",
    """SELECT * FROM customer
       UNION ALL SELECT * REPLACE ('CHANGED' AS c_mktsegment, c_custkey + 100000000 AS c_custkey)
                 FROM customer WHERE c_nationkey < 8""",
)
def m2(spark, sf):
    return changes.insert_ignore(table(spark, sf, "customer"), _customer_rows(spark, sf), "c_custkey", "ordinal")


@query("m3_delete_by_id", "SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def m3(spark, sf):
    ids = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return changes.delete_by_id(table(spark, sf, "orders"), ids, "o_orderkey")


@query(
    "m4_update_by_id",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS c_name, c_nationkey,
              CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal > 5000 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
              c_mktsegment FROM customer""",
)
def m4(spark, sf):
    customer = table(spark, sf, "customer")
    cleared = customer.filter("c_acctbal < 0").select(
        "c_custkey", F.lit(None).cast("string").alias("c_name"), F.lit(0.0).alias("c_acctbal"),
        F.array(F.lit("c_name"), F.lit("c_acctbal")).alias("set_columns"), F.lit(1).alias("ordinal"),
    )
    raised = customer.filter("c_acctbal > 5000").select(
        "c_custkey", F.lit(None).cast("string").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"),
        F.array(F.lit("c_acctbal")).alias("set_columns"), F.lit(2).alias("ordinal"),
    )
    overruled = raised.withColumn("c_acctbal", F.lit(-1.0)).withColumn("ordinal", F.lit(1))
    return changes.update_by_id(customer, cleared.unionByName(raised).unionByName(overruled), "c_custkey", "ordinal")


_OLD, _NEW = "sha256('(' || {0} || ',)')", "sha256('(' || {0} || ', ' || {1} || ')')"


@query(
    "m5_rekey",
    f"""WITH o AS (SELECT o_orderkey, {_OLD.format('o_orderkey')} AS old_key,
                     CASE WHEN o_orderstatus = 'F' THEN {_NEW.format('o_custkey', 'o_orderkey')}
                          ELSE {_OLD.format('o_orderkey')} END AS new_key FROM orders)
        SELECT 'parent' AS side, o_orderkey AS key, NULL::BIGINT AS part, new_key AS geo_hash_id FROM o
        UNION ALL
        SELECT 'child', l_orderkey, l_partkey, coalesce(new_key, {_OLD.format('l_orderkey')})
        FROM lineitem LEFT JOIN o ON o_orderkey = l_orderkey""",
)
def m5(spark, sf):
    old = hash_key((F.col("o_orderkey"), "number"))
    new = F.when(
        F.col("o_orderstatus") == "F", hash_key((F.col("o_custkey"), "number"), (F.col("o_orderkey"), "number"))
    ).otherwise(old)
    parents = table(spark, sf, "orders").withColumn("geo_hash_id", old)
    children = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", hash_key((F.col("l_orderkey"), "number")).alias("geo_hash_id")
    )
    kept, moved = changes.rekey(parents, children, new, order="o_orderkey")
    return kept.select(
        F.lit("parent").alias("side"), F.col("o_orderkey").alias("key"), F.lit(None).cast("bigint").alias("part"),
        "geo_hash_id",
    ).unionByName(
        moved.select(F.lit("child").alias("side"), F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("part"), "geo_hash_id")
    )
