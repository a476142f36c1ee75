"""Link-graph crawl: everything reachable from the seeds over valid links.

The round of a page is its distance from the seeds. A page that only one usable page links to is one further than
that page, whatever else happens; so such pages hang in trees, and their root and level are found by pointer jumping, in
as many steps as the depth has binary digits. Rounds are then walked between roots only (pages with several links to
them, seeds), over the links into roots, each as long as the level of the page that has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.web import from_parent, is_valid_link
from ..session import work_folder

# Links between roots, and what is known of roots, are stored in so many parts by a hash of the address; a round reads the
# parts of its frontier.
BUCKETS = 32
LINKS = "bucket INT, src STRING, url STRING, steps INT"
REACHED = "bucket INT, url STRING, round INT"


def _bucket(url):
    return F.pmod(F.xxhash64(url), F.lit(BUCKETS)).cast("int")


def _touched(spark: SparkSession, folder: str) -> list[int]:
    """The buckets that a round wrote: at most BUCKETS numbers."""
    rows = spark.read.schema(REACHED).parquet(folder).select("bucket").distinct().collect()
    return sorted(r["bucket"] for r in rows)


def single_parents(links: DataFrame, seeds: DataFrame, store) -> DataFrame:
    """url, anc, dist of the pages with one link to them: the root of their tree and their level in it.

    links(src, url) are distinct and lead to other pages. `store(df, name)` writes a table and reads it again. Pages on a closed ring, and those that
    hang on it, have no root and are left out: nothing leads there.
    """
    own = links.groupBy("url").agg(F.count("*").alias("n"), F.min("src").alias("anc")).filter("n = 1")
    own = own.join(seeds, "url", "left_anti")
    tree = store(own.select("url", "anc", F.lit(1).alias("dist"), F.lit(False).alias("done")), "tree=0")
    step, settled, total = 0, -1, tree.count()
    while True:
        up = tree.select(F.col("url").alias("__url"), F.col("anc").alias("__anc"), F.col("dist").alias("__dist"))
        jumped = tree.join(up, F.col("anc") == F.col("__url"), "left").select(
            "url",
            F.coalesce("__anc", "anc").alias("anc"),
            (F.col("dist") + F.coalesce("__dist", F.lit(0))).alias("dist"),
            F.col("__url").isNull().alias("done"),
        )
        step += 1
        tree = store(jumped, f"tree={step}")
        before, settled = settled, tree.filter("done").count()
        if settled in (before, total):
            return tree.filter("done").drop("done")


def crawl_frontier(
    spark: SparkSession,
    edges: DataFrame,
    seeds: DataFrame,
    seed_url: str,
    failed: DataFrame | None = None,
    max_rounds: int | None = None,
    exts=("htm", "php"),
    pattern: str | None = None,
    root: str | None = None,
) -> DataFrame:
    """Visited URLs with the round that queued them and whether the page could be used.

    `edges(src, dst)` are the links of every page, `seeds(url)` the start, `failed(url)` the pages that
    are logged and not expanded. Each step is one written folder of the shared work folder (`root`, default a new one), so
    no lineage grows and a lost executor repeats one step. Only counts and bucket numbers come to the driver. With
    `max_rounds` a column `expanded` says whether the links of a page were followed: pages of the last round are queued only.
    The number of steps grows with the logarithm of the trees' depth and with the number of roots on a shortest way.
    """
    root = root or work_folder(spark, "crawl")

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    start = store(seeds.select("url").distinct(), "seeds")
    bad = None if failed is None else failed.select("url").distinct()
    links = edges.select("src", from_parent(F.col("dst"), F.lit(seed_url)).alias("url"))
    links = links.filter(is_valid_link(F.col("url"), F.lit(seed_url), exts, pattern) & (F.col("src") != F.col("url"))).distinct()
    if bad is not None:
        links = links.join(bad, links["src"] == bad["url"], "left_anti")
    links = store(links, "links")
    tree = single_parents(links, start, store)

    # Links into roots, from the root of their page.
    place = tree.select(F.col("url").alias("__page"), F.col("anc").alias("__root"), F.col("dist").alias("__level"))
    into = links.join(tree.select("url"), "url", "left_anti")
    into = into.join(place, into["src"] == F.col("__page"), "left").select(
        F.coalesce("__root", "src").alias("src"), "url", (F.coalesce("__level", F.lit(0)) + 1).cast("int").alias("steps")
    )
    into = into.filter("src <> url").groupBy("src", "url").agg(F.min("steps").alias("steps"))
    by_source = into.select(_bucket("src").alias("bucket"), "src", "url", "steps").repartition(BUCKETS, "bucket")
    by_source.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/between")
    between = spark.read.schema(LINKS).parquet(f"{root}/between")

    def write_round(found: DataFrame, number: int) -> list[int]:
        rows = found.select(_bucket("url").alias("bucket"), "url", "round").repartition(BUCKETS, "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/rounds/pass={number}")
        return _touched(spark, f"{root}/rounds/pass={number}")

    number, touched = 0, write_round(start.select("url", F.lit(0).alias("round")), 0)
    while touched:
        frontier = spark.read.schema(REACHED).parquet(f"{root}/rounds/pass={number}")
        near = between.filter(F.col("bucket").isin(touched)).join(
            frontier.select(F.col("url").alias("src"), "round"), "src"
        )
        found = near.select("url", (F.col("round") + F.col("steps")).alias("round"))
        if max_rounds is not None:
            found = found.filter(F.col("round") <= max_rounds)
        found = store(found.groupBy("url").agg(F.min("round").alias("round")), f"found={number + 1}")
        # Of what is known of roots only the parts of the pages found are read.
        parts = sorted(r["b"] for r in found.select(_bucket("url").alias("b")).distinct().collect())
        known = spark.read.schema(f"{REACHED}, pass INT").parquet(f"{root}/rounds").filter(F.col("bucket").isin(parts))
        known = known.groupBy("url").agg(F.min("round").alias("__known"))
        better = found.join(known, "url", "left").filter("__known IS NULL OR round < __known").select("url", "round")
        number += 1
        touched = write_round(better, number)

    reached = spark.read.schema(f"{REACHED}, pass INT").parquet(f"{root}/rounds")
    reached = reached.groupBy(F.col("url").alias("anc")).agg(F.min("round").alias("__at"))
    hanging = tree.join(reached, "anc").select("url", (F.col("__at") + F.col("dist")).cast("int").alias("round"))
    out = reached.select(F.col("anc").alias("url"), F.col("__at").alias("round")).unionByName(hanging)
    if bad is None:
        out = out.select("url", F.lit(True).alias("ok"), "round")
    else:
        out = out.join(bad.withColumn("__bad", F.lit(True)), "url", "left").select("url", F.col("__bad").isNull().alias("ok"), "round")
    if max_rounds is None:
        return out
    out = out.filter(F.col("round") <= max_rounds)
    return out.withColumn("expanded", F.col("ok") & (F.col("round") < max_rounds))
