"""Crawl of stored pages: links of the pages, rounds from the seeds, list of the pages found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import crawl_frontier
from ..operators.html import html_trees
from ..operators.pages import page_links
from ..session import written
from ..sources.files import write_lines, write_sitemap

# Fixed value: a page with a higher status is logged as failed.
LAST_GOOD_STATUS = 301


def crawl_pages(
    spark: SparkSession, pages: DataFrame, seeds: DataFrame, seed_url: str, max_rounds: int | None = None, **rules
) -> DataFrame:
    """Visited URLs of pages(url, status, html) from seeds(url): url, ok, round.

    A page is parsed once. Pages with a status above 301, without content, or not stored are visited, but not ok, and
    lead nowhere. `rules` are those of `crawl_frontier`.
    """
    good = F.coalesce(F.col("status") <= LAST_GOOD_STATUS, F.lit(False)) & F.col("html").isNotNull()
    usable = pages.filter(good).select("url", "html")
    links = page_links(html_trees(usable)).select(F.col("url").alias("src"), F.col("href").alias("dst")).distinct()
    links = written(links, "page-links")
    visited = crawl_frontier(spark, links, seeds, seed_url, None, max_rounds, **rules)
    stored = usable.select("url").distinct().withColumn("__stored", F.lit(True))
    return visited.join(stored, "url", "left").withColumn("ok", F.col("__stored").isNotNull()).drop("__stored")


def save_crawl(visited: DataFrame, folder: str) -> None:
    """The usable pages as a sitemap and as lines, and the failed ones as lines."""
    write_sitemap(visited.filter("ok"), f"{folder}/sitemap")
    write_lines(visited.filter("ok"), f"{folder}/visited", "url")
    write_lines(visited.filter("NOT ok"), f"{folder}/failed", "url")
