"""Pages: request addresses, offset windows, token-chained responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import number_all

PLACES_RESPONSE = (
    "status string, next_page_token string, "
    "results array<struct<name:string,place_id:string,latitude:double,longitude:double>>"
)


def page_urls(df: DataFrame, per_page: int = 20, url: str = "url", count: str = "count") -> DataFrame:
    """`floor(count / per_page) + 1` list-page addresses per row."""
    last = F.floor(F.col(count) / per_page)
    pages = df.withColumn("page_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return pages.withColumn("start", F.col("page_no") * per_page).withColumn(
        "page_url",
        F.concat(F.col(url), F.lit("&start="), F.col("start").cast("string"), F.lit("&order=")),
    )


# Windows that end within so many rows are the first rows of the order (one top-n).
SHALLOW = 10_000
# Ranges of a rank index, and rows of the sample for each of their bounds.
RANGES = 256
SAMPLED = 16


def _sorts(order: list[str]) -> list[Column]:
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def _not_before(values, order: list[str], types: list) -> Column:
    """Whether a row's order columns are equal to `values` or come after them; `values` gives a column per place."""
    said = F.lit(True)
    for k in reversed(range(len(order))):
        name, down = order[k].removeprefix("-"), order[k].startswith("-")
        mine, bound = F.col(name), values(k).cast(types[k])
        if down:  # greatest first, NULL last
            after = (mine < bound) | (mine.isNull() & bound.isNotNull())
        else:  # NULL first
            after = (mine > bound) | (mine.isNotNull() & bound.isNull())
        said = F.coalesce(after, F.lit(False)) | (mine.eqNullSafe(bound) & said)
    return said


class RankIndex:
    """Row counts per range of an order: where the window of a rank lies, without sorting the rows.

    Bounds come from a sample of the order columns (RANGES times SAMPLED rows); the counts cover all rows. Nothing is
    written, and only the order columns are read.
    """

    def __init__(self, df: DataFrame, order: list[str], rows: int):
        self.order = order
        names = [c.removeprefix("-") for c in order]
        self.types = [df.schema[c].dataType for c in names]
        wanted = min(1.0, 2.0 * RANGES * SAMPLED / max(rows, 1))
        sample = df.select(*names).sample(wanted, seed=7).orderBy(*_sorts(order)).limit(4 * RANGES * SAMPLED).collect()
        step = max(1, len(sample) // RANGES)
        self.bounds = list(dict.fromkeys(tuple(r) for r in sample[step::step]))
        # The range of a row is how many bounds are not after it: found by halving steps.
        steps = [1 << k for k in reversed(range(max(1, len(self.bounds).bit_length())))]
        fields = [f"c{k}" for k in range(len(names))]
        bounds = F.array(*[F.struct(*[F.lit(v).cast(t).alias(f) for v, t, f in zip(b, self.types, fields)]) for b in self.bounds])

        def further(at, size):
            bound = F.get(bounds, at + size - 1)
            passed = _not_before(lambda k: bound[fields[k]], order, self.types)
            return F.when((at + size <= len(self.bounds)) & passed, at + size).otherwise(at)

        number = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further) if self.bounds else F.lit(0)
        counted = {r["range"]: r["count"] for r in df.select(*names).groupBy(number.alias("range")).count().collect()}
        self.before = [0]
        for k in range(len(self.bounds) + 1):
            self.before.append(self.before[-1] + counted.get(k, 0))

    def window(self, first: int, end: int) -> tuple[Column, int, int]:
        """The condition that holds the rows of ranks first to end - 1, the rows before it, and the rows in it."""
        low = max(k for k in range(len(self.bounds) + 1) if self.before[k] <= first)
        high = min([k for k in range(1, len(self.bounds) + 2) if self.before[k] >= end] or [len(self.bounds) + 1])
        said = F.lit(True)
        if low:
            bound = self.bounds[low - 1]
            said = said & _not_before(lambda k: F.lit(bound[k]), self.order, self.types)
        if high <= len(self.bounds):
            above = self.bounds[high - 1]
            said = said & ~_not_before(lambda k: F.lit(above[k]), self.order, self.types)
        return said, self.before[low], self.before[high] - self.before[low]


def offset_page(df: DataFrame, order, offset: int, number: int = 20, shallow: int = SHALLOW) -> DataFrame:
    """One window of `number` rows in the order of columns (`-name`: greatest first); rows that tie go by a digest.

    A window that ends within `shallow` rows is a top-n. For a deeper one a rank index names the range of the order that
    holds it; a range that is still larger is indexed again, so at most `shallow` rows are sorted for the window.
    """
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in {o.removeprefix("-") for o in order}]
    plain = [F.col(f"`{c}`") for c in rest if isinstance(df.schema[c].dataType, T.AtomicType)]
    digest = F.xxhash64(F.lit(0), *plain)
    part, before = df.withColumn("__digest", digest), 0
    rows, full = (df.count(), [*order, "__digest"]) if offset + number > shallow else (0, order)
    by = order
    while rows > shallow and offset < before + rows:
        held, skipped, inside = RankIndex(part, by, rows).window(offset - before, offset - before + number)
        if inside == rows and by is full:
            break  # equal rows only: any of them will do
        if inside == rows:
            by = full
            continue
        part, before, rows = part.filter(held), before + skipped, inside
    ordered = part.orderBy(*_sorts([*order, "__digest"])).offset(offset - before).limit(number)
    return ordered.drop("__digest")


def paged(df: DataFrame, order, number: int = 20) -> DataFrame:
    """Every row with the number of the window it falls into."""
    return number_all(df, order, name="page_no").withColumn(
        "page_no", F.floor(F.col("page_no") / number)
    )


def collect_pages(responses: DataFrame, body: str = "body") -> DataFrame:
    """All results of all responses; the page order is kept in `page_no` and `pos`."""
    parsed = responses.withColumn("__r", F.from_json(F.col(body), PLACES_RESPONSE)).drop(body)
    kept = parsed.filter((F.col("__r.status") != "ZERO_RESULTS") | F.col("__r.status").isNull())
    return kept.select(
        *[c for c in responses.columns if c != body], F.posexplode("__r.results").alias("pos", "result")
    ).select("*", "result.*").drop("result")
