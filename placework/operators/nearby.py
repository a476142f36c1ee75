"""Match by distance and name similarity.

Points are joined on grid cells, so only neighbours meet. Copies (same name, same place) are reduced to one
value per side first. Sides meet on the cell, in crowded cells on cell and name piece: names with a ratio above the threshold
share enough letter pairs that they must agree on one of the rarest few of each, so the names of a hot cell are not all paired
with each other, and none that could match is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance_m
from ..functions.text import similarity, similarity_bound, similarity_bound_by_edits
from ..session import written
from .rarity import by_rarity, piece_levels

# A degree of latitude is longer than this everywhere on the sphere that `distance_m` measures.
METRES_PER_DEGREE = 111_000.0
# Below this ratio names need not share a letter pair or a one-letter deletion, so no index finds all pairs.
LEAST_RATIO = 0.8
VALUE = ["name", "latitude", "longitude"]
CELL = ["__band", "__col"]
# All sides here grow with the input. Their size is estimated from files before cells and keys are exploded, and adaptive
# execution does not take a broadcast back that needs fewer shuffles, so it would pass through the driver at any size.
MERGE = "merge"
# Cells with more pairs than this are crowds.
CROWD = 1024


def _with_cells(df: DataFrame, cell: float, reach: int) -> DataFrame:
    """Rows with their grid cell, or with all cells around it.

    A band is as high as the radius. The columns of a band are as wide as the radius needs at the edge of the
    next band towards the pole; they wrap at the date line, and the last one takes the remainder.
    """
    steps = F.sequence(F.lit(-reach), F.lit(reach)) if reach else F.array(F.lit(0))
    band = F.floor(F.col("latitude") / cell)
    banded = df.withColumn("__band", F.explode(F.transform(steps, lambda s: band + s)))
    edge = F.least(F.lit(90.0), (F.abs(F.col("__band")) + 2) * cell)
    wide = cell / F.greatest(F.cos(F.radians(edge)), F.lit(1e-6))
    columns = F.greatest(F.floor(360.0 / wide), F.lit(1))
    column = F.least(F.floor((F.col("longitude") + 180.0) / wide), columns - 1)
    around = F.array_distinct(F.transform(steps, lambda s: F.pmod(column + s, columns)))
    return banded.withColumn("__col", F.explode(around))


def _shared_pieces(length: Column, min_ratio: float) -> Column:
    """How many letter pairs a name shares at least with any name above the ratio.

    With M equal letters out of T in both names, the equal runs number at most T - 2M + 1, because a letter is
    left over between two runs; so at least 3M - T - 1 letter pairs are equal, and M > ratio * T / 2. The
    other name is longer than ratio / (2 - ratio) of this one.
    """
    share = (1.5 * min_ratio - 1) * 2 / (2 - min_ratio)
    return F.greatest(F.floor(length * share - 1 - 1e-9) + 1, F.lit(0)).cast("int")


def _with_pieces(df: DataFrame) -> DataFrame:
    """Letter pairs of the name in `__pieces`; a repeated pair counts as a new one each time.

    Arrays that a function of each element reads are columns of their own, or they are made anew for each element.
    """
    name = F.col("name")
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(2))
    )
    # In order equal pairs follow each other, so a pair's number is its distance from the first of them.
    number = lambda p, i: F.concat(p, (i + 2 - F.array_position("__pairs", p)).cast("string"))
    return df.withColumn("__pairs", F.array_sort(pairs)).withColumn("__pieces", F.transform("__pairs", number)).drop("__pairs")


def _met(left: DataFrame, right: DataFrame, cell: float, min_ratio: float) -> DataFrame:
    """Pairs of values of two sides in one cell; in crowds only those that agree on one of the rarest letter pairs of both."""
    named = [
        df.select(*CELL, *[F.col(c).alias(f"{side}_{c}") for c in VALUE])
        for df, side in ((_with_cells(_values(left), cell, 0), "left"), (_with_cells(_values(right), cell, 1), "right"))
    ]
    sizes = [df.groupBy(*CELL).agg(F.count("*").alias(f"__n{k}")) for k, df in enumerate(named)]
    crowds = sizes[0].join(sizes[1].hint(MERGE), CELL).filter(F.col("__n0").cast("double") * F.col("__n1") > CROWD)
    crowds = written(crowds.select(*CELL), "nearby-crowds")
    if crowds.isEmpty():
        return named[0].join(named[1].hint(MERGE), CELL)
    few = [df.join(crowds.hint(MERGE), CELL, "left_anti") for df in named]
    many = [written(df.join(crowds.hint(MERGE), CELL, "left_semi"), "nearby-crowd-rows") for df in named]
    return few[0].join(few[1].hint(MERGE), CELL).unionByName(_met_by_pieces(many[0], many[1], min_ratio))


def _met_by_pieces(left: DataFrame, right: DataFrame, min_ratio: float) -> DataFrame:
    """Pairs of placed values that agree on a cell and on one of the rarest letter pairs of both."""
    names = left.select(F.col("left_name").alias("name")).union(right.select(F.col("right_name").alias("name")))
    levels = piece_levels(_with_pieces(names).select(F.explode("__pieces")))
    needed = _shared_pieces(F.length("name"), min_ratio)
    rarest = F.slice("__ranked", F.lit(1), F.size("__ranked") - needed + 1)
    keys = F.transform(rarest, lambda r: r["piece"])
    # Names of up to three letters need not share a pair, but then they equal the other name or lack one letter of it
    # (more than 0.4 * (3 + 4) letters are equal), so both sides of up to four letters are known by their deletions.
    name = F.col("name")
    cuts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))),
        lambda i: F.concat(F.lit("="), F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))),
    )
    short = F.array_distinct(F.concat("__keys", F.array(F.concat(F.lit("="), name)), cuts))
    every = F.when(F.length(name) <= 4, short).otherwise(F.col("__keys"))

    def side(df: DataFrame, prefix: str) -> DataFrame:
        pieces = _with_pieces(df.withColumn("name", F.col(f"{prefix}_name")))
        ranked = pieces.withColumn("__ranked", by_rarity(F.col("__pieces"), levels)).withColumn("__keys", keys)
        keyed = ranked.select(*df.columns, every.alias(f"{prefix}_keys"))
        return keyed.select(*keyed.columns, F.explode(f"{prefix}_keys").alias("__key"))

    met = side(left, "left").join(side(right, "right").hint(MERGE), [*CELL, "__key"])
    # A pair that agrees on several keys is kept under the first of them.
    first_key = F.get(F.array_intersect("left_keys", "right_keys"), 0)
    return met.filter(F.col("__key") == first_key).drop("left_keys", "right_keys", "__key")


def _values(df: DataFrame) -> DataFrame:
    return df.select(*VALUE).filter("name IS NOT NULL").distinct()


def nearby_pairs(left: DataFrame, right: DataFrame, metres: float = 10.0, min_ratio: float = LEAST_RATIO) -> DataFrame:
    """Pairs of values within `metres` whose name lengths allow a ratio above `min_ratio`.

    Both sides need name, latitude, longitude. All names of neighbouring cells are paired, as the result asks for;
    `match_nearby` is the form for crowded places.
    """
    cell = metres / METRES_PER_DEGREE
    a, b = _with_cells(_values(left), cell, 0), _with_cells(_values(right), cell, 1)
    named = [df.select(*CELL, *[F.col(c).alias(f"{side}_{c}") for c in VALUE]) for df, side in ((a, "left"), (b, "right"))]
    return _within(named[0].join(named[1].hint(MERGE), CELL), metres, min_ratio)


def _within(met: DataFrame, metres: float, min_ratio: float) -> DataFrame:
    apart = distance_m(F.col("left_latitude"), F.col("left_longitude"), F.col("right_latitude"), F.col("right_longitude"))
    return (
        met.filter(similarity_bound(F.col("left_name"), F.col("right_name")) > min_ratio)
        .filter(apart <= metres)
        .select(*[f"left_{c}" for c in VALUE], *[f"right_{c}" for c in VALUE], apart.alias("metres"))
    )


def match_nearby(left: DataFrame, right: DataFrame, metres: float = 10.0, min_ratio: float = LEAST_RATIO) -> DataFrame:
    """Left rows with every near and similarly named right row: left_id, right_id, right columns, ratio.

    Both sides need id, name, latitude, longitude; min_ratio is 0.8 or more. Equal names need no ratio; of the others
    each pair of names reaches the Python kernel once, wherever and how often it occurs.
    """
    if min_ratio < LEAST_RATIO:
        raise ValueError(f"min_ratio must be at least {LEAST_RATIO}")
    near = _within(_met(left, right, metres / METRES_PER_DEGREE, min_ratio), metres, min_ratio)
    # Most pairs fall to the bound by edits, which needs no Python.
    can_match = similarity_bound_by_edits(F.col("left_name"), F.col("right_name")) > min_ratio - 1e-9
    pairs = written(near.filter((F.col("left_name") == F.col("right_name")) | can_match), "nearby-pairs")
    names = pairs.filter("left_name <> right_name").select("left_name", "right_name").distinct()
    ratios = names.withColumn("ratio", similarity(F.col("right_name"), F.col("left_name")))
    same = pairs.filter("left_name = right_name").withColumn("ratio", F.lit(1.0))
    other = pairs.join(ratios.filter(F.col("ratio") > min_ratio).hint(MERGE), ["left_name", "right_name"])
    good = same.unionByName(other)
    left_ids = left.select(F.col("id").alias("left_id"), *[F.col(c).alias(f"left_{c}") for c in VALUE])
    right_rows = right.select(
        F.col("id").alias("right_id"),
        *[F.col(c).alias(f"right_{c}") for c in VALUE],
        *[c for c in right.columns if c not in (*VALUE, "id")],
    )
    found = left_ids.join(good.hint(MERGE), [f"left_{c}" for c in VALUE])
    return found.join(right_rows.hint(MERGE), [f"right_{c}" for c in VALUE])
