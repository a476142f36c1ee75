"""Packing of documents into sequences of one length: shortest pack first over the histogram of lengths.

Documents become token ids with an end id, and are cut into full sequences and a rest. Only the number of pieces of each
length (at most `size` numbers) comes to the driver. There lengths are placed from the longest to the shortest, always
into the emptiest packing pattern with room; a pattern stands for many sequences, so the plan has in the order of `size`
patterns however many documents there are. Pieces of a length are then numbered, and number ranges of a length are the
places of the patterns.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, release_words, text_of, token_ids, written

PIECE_SCHEMA = "uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
# Rows of a length that one task numbers; a more frequent length is cut by a hash.
NUMBERED_TOGETHER = 50_000


def _cutter(tokenizer: str, size: int, end_id: int, keep_ids: bool):
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "content"):
                rows = []
                for uid, doc_id, ids in zip(
                    part.column(part.schema.get_field_index("uid")).to_pylist(),
                    part.column(part.schema.get_field_index("doc_id")).to_pylist(),
                    token_ids(texts, tokenizer),
                ):
                    ids += end
                    for at in range(0, len(ids), 4 * size):
                        piece = ids[at : at + 4 * size]
                        rows.append((uid, doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece))
                names = ["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
                columns = [pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*rows))]
                used = 7 if keep_ids else 6
                yield pa.RecordBatch.from_arrays(columns[:used], names=names[:used])
        release_words(tokenizer)

    return cut


def packing_patterns(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(number of sequences, lengths in them) so that every counted piece has a place."""
    room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        # The emptiest patterns first: the most room.
        for free in range(size, length - 1, -1):
            while left and room.get(free):
                number, pattern = room[free].pop()
                used = min(number, left)
                if number > used:
                    room[free].append((number - used, pattern))
                room[free - length].append((used, [*pattern, length]))
                left -= used
        if left:
            room[size - length].append((left, [length]))
    return [entry for free in sorted(room) for entry in room[free]]


def pattern_places(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """length, low and high rank of the pieces of that length at this place, first sequence, offset."""
    places, placed, first = [], defaultdict(int), 0
    for number, pattern in patterns:
        offset = 0
        for length in pattern:
            low = placed[length]
            placed[length] = low + number
            places.append((length, low, low + number, first, offset))
            offset += length
        first += number
    return places


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if kept).

    A document is the ids of its text (null: empty) and end_id, so every row has at least one id. Repeated rows are
    packed each. An empty table gives an empty result. Other columns are ignored. tokenizer: path of a `tokenizers`
    file that every executor has.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", text_of().alias("content"))
    schema = PIECE_SCHEMA + (", ids binary" if keep_ids else "")
    cut = written(rows.mapInArrow(_cutter(tokenizer, size, end_id, keep_ids), schema), "packing-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = pattern_places(packing_patterns(counts, size))
    lengths = spark.createDataFrame(list(counts.items()), "length long, n long")
    places = spark.createDataFrame(places, "length long, low long, high long, first long, offset long")

    # Both tables are bounded by the patterns, whose number is bounded by `size`.
    cut = cut.join(F.broadcast(lengths), "length").withColumn(
        "part", F.pmod(F.xxhash64("uid", "start"), F.ceil(F.col("n") / NUMBERED_TOGETHER))
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy("length", "part").agg(F.count("*").alias("n")).select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    ranked = cut.withColumn("number", F.row_number().over(Window.partitionBy("length", "part").orderBy("uid", "start")))
    ranked = ranked.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("number") - 1)
    places = places.withColumnRenamed("length", "place_length")
    here = (F.col("length") == F.col("place_length")) & (F.col("low") <= F.col("rank")) & (F.col("rank") < F.col("high"))
    sequence = F.col("first") + F.col("rank") - F.col("low")
    return ranked.join(F.broadcast(places), here).select(
        *["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
        sequence.alias("sequence_id"),
        "offset",
        *(["ids"] if keep_ids else []),
    )
