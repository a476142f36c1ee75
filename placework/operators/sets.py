"""URL sets, differences, and unions of differently shaped sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def distinct_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.select(url).distinct()


def union_urls(a: DataFrame, b: DataFrame, url: str = "url") -> DataFrame:
    return a.select(url).union(b.select(url)).distinct()


def unvisited(queue: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    """Rows of the queue whose URL was not visited; other columns ride along.

    The visited side is reduced to distinct keys first, so a hot key there is one row.
    """
    return queue.join(visited.select(url).distinct(), url, "left_anti")


def platform_rows(*sources: DataFrame) -> DataFrame:
    """One platform table from sources that lack different columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
