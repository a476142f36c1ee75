"""How common short pieces of text are, counted in a fixed number of places.

Pieces that share a place count together, so the order by rarity is rough, but it is the same for all rows, which is what
a look-up by rarest pieces needs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 16_384


def _place(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(PLACES)).cast("int")


def piece_levels(pieces: DataFrame) -> Column:
    """The levels of the pieces in a table's only column as one value: PLACES bytes, six steps for each doubling."""
    piece = F.col(pieces.columns[0])
    counted = pieces.filter(piece.isNotNull()).groupBy(_place(piece).alias("at")).agg(F.count("*").alias("n")).collect()
    levels = bytearray(PLACES)
    for row in counted:  # at most PLACES rows
        levels[row["at"]] = min(255, int(6 * math.log2(row["n"] + 1)))
    return F.lit(bytes(levels))


def by_rarity(pieces: Column, levels: Column) -> Column:
    """An array of pieces as structs (level, piece), rarest first."""
    return F.array_sort(
        F.transform(pieces, lambda p: F.struct(F.substring(levels, _place(p) + 1, F.lit(1)).alias("level"), p.alias("piece")))
    )
