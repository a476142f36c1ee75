"""Near-duplicate documents by weighted minwise hashing with darts (Christiani, 2020).

A document is a weighted set: its five-word shingles with the number of times each occurs. For each element the plane of
weight and rank is cut into regions whose sides double; a hash of element and region says how many darts fall into it
(a Poisson number of its area) and where. A document keeps the darts below its weights and below a rank that fills all
coordinates; each dart belongs to one coordinate, and the dart of least rank is the coordinate's value. Two documents
agree in a coordinate with the probability of their weighted Jaccard similarity, and the work for a document is one
hash per element and a number of darts that does not depend on its length.

Bands of coordinates are joined, pairs are verified on all shingles, and links become classes. Equal texts are one
text here, so a group of copies is never paired. In a bucket every text is compared with the bucket's first
text; then texts that are still of different classes are compared with the nearest, by one-bit marks, of those that are
next to them in a random order of each bucket, and that is repeated with new orders until a round finds no link. So a text
sends a bounded number of pairs, whatever the size of its buckets. Texts of larger buckets that are still of different classes then go through an exact
join on their rarest shingles (prefix filter): two texts at the similarity share one among the rarest of each, and
what a crowd has in common comes last in the order. Before two texts that share a rare shingle become a pair, bounds on
their lengths, places and parity bits are looked at inside the task; none of them rules out a similar pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    SMALL_PIECE, U64, counted_shingles, digest_of, keep_rows, link_classes, mix, pieces, seeded, stored_part, stored_parts,
    text_of, work_folder, written,
)

SIMILARITY = 0.8
SHINGLE_WORDS = 5
# A pair at the similarity misses all bands with probability (1 - 0.8^4)^25 = 2e-6.
BANDS, BAND_ROWS = 25, 4
COORDINATES = BANDS * BAND_ROWS
# In a round a text is compared with so many of the texts that its buckets name, those nearest by marks.
NEAREST = 8
# Marks are one bit of each coordinate, and those of two texts differ in (1 - J) / 2 of them: at the similarity in more than
# this number of 100 with probability 4e-6, at a similarity of 0.3 in fewer with probability 0.02.
MARKS_APART = 25
# Rows of a bucket that one task orders; a larger bucket is cut by a hash.
ORDERED_TOGETHER = 5000
# Counters of shingles; shingles that share one are taken as equally frequent, which changes the order but no result.
COUNTERS = 1 << 20
# Candidates of the exact join that are looked at together, and in how many of them a group of rows is taken apart by class.
LOOKED_AT, TAKEN_APART = 1 << 18, 1 << 16
# Words of 64 bits of a text's parity bits in the exact join.
PARITY_WORDS = 8
# Rows of a shingle that are paired in one task; the rows of a more frequent one are cut into blocks, and each two blocks meet.
PAIRED_TOGETHER = 8192

_FIRST_RANK = 0.25
_WAY = seeded(11, 2)
_BAND = seeded(12, COORDINATES) | U64(1)


def _poisson(area: float) -> np.ndarray:
    """Probability of up to 0, 1, 2, ... darts in a region of this area."""
    n = np.arange(int(area + 12 * math.sqrt(area) + 24))
    logs = np.concatenate([[0.0], np.cumsum(np.log(n[1:]))])
    return np.cumsum(np.exp(n * math.log(area) - area - logs))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U64(11)) * 2.0**-53


def _sides(first: float, most: float) -> Iterator[tuple[int, float, float]]:
    """Number, start and end of the doubling intervals from 0 that begin below `most`."""
    number, low, high = 0, 0.0, first
    while low < most:
        yield number, low, high
        number, low, high = number + 1, high, 2 * high


def _darts(elements, weights, owner, ranks, coordinates):
    """Kept darts: slot (document and coordinate), rank, dart."""
    found = []
    for v, weight_low, weight_high in _sides(1.0, weights.max()):
        heavy = weights > weight_low
        for r, rank_low, rank_high in _sides(_FIRST_RANK, ranks.max()):
            at = np.flatnonzero(heavy & (ranks[owner] > rank_low))
            region = mix(elements[at] ^ mix(np.array([(v << 32) + r + 1], U64)))
            cells = _poisson((weight_high - weight_low) * (rank_high - rank_low))
            counts = np.searchsorted(cells, _unit(region), side="right")
            source = np.repeat(np.arange(len(at)), counts)
            number = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts)
            dart = mix(region[source] + (number + 1).astype(U64) * U64(0x9E3779B97F4A7C15))
            rank = rank_low + (rank_high - rank_low) * _unit(mix(dart ^ _WAY[0]))
            of = at[source]
            kept = (weight_low + (weight_high - weight_low) * _unit(dart) < weights[of]) & (rank < ranks[owner[of]])
            dart, rank, of = dart[kept], rank[kept], of[kept]
            slot = owner[of] * coordinates + (mix(dart ^ _WAY[1]) % U64(coordinates)).astype(np.int64)
            found.append((slot, rank, dart))
    return tuple(np.concatenate(c) for c in zip(*found))


def dart_sketches(elements, weights, owner, documents: int, coordinates: int = COORDINATES):
    """Sketches (documents x coordinates) and whether each document has any element."""
    sketch = np.zeros(documents * coordinates, U64)
    total = np.bincount(owner, weights, documents)
    some = total > 0
    ranks = np.where(some, coordinates * (math.log(coordinates) + 3) / np.maximum(total, 1e-300), 0)
    open_ = some.copy()
    while open_.any():
        mine = open_[owner]
        slot, rank, dart = _darts(elements[mine], weights[mine], owner[mine], ranks, coordinates)
        filled = np.zeros(documents * coordinates, bool)
        filled[slot] = True
        order = np.argsort(-rank, kind="stable")
        sketch[slot[order]] = dart[order]
        # Some coordinates got no dart: throw up to twice the rank.
        open_ &= ~filled.reshape(documents, coordinates).all(axis=1)
        ranks = np.where(open_, 2 * ranks, ranks)
    return sketch.reshape(documents, coordinates), some


def band_hashes(sketch: np.ndarray) -> np.ndarray:
    """One whole number per band; different bands never share one but by chance."""
    parts = (sketch * _BAND).reshape(len(sketch), BANDS, BAND_ROWS)
    return mix(parts.sum(axis=2, dtype=U64) + seeded(13, BANDS)).view(np.int64)


def sketch_marks(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One bit of each coordinate, in two whole numbers."""
    bits = (mix(sketch) >> U64(40)) & U64(1)
    half = COORDINATES // 2
    place = np.arange(half, dtype=U64)
    return tuple((part << place).sum(axis=1, dtype=U64).view(np.int64) for part in (bits[:, :half], bits[:, half:]))


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in pieces(batch, "content", SMALL_PIECE):
            elements, weights, owner = counted_shingles([t.encode() for t in texts], SHINGLE_WORDS)
            sketch, some = dart_sketches(elements, weights.astype(float), owner, len(texts)) if len(elements) else (None, np.zeros(len(texts), bool))
            values = band_hashes(sketch[some]).ravel() if some.any() else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
            kept = [part.column(i) for i in range(part.num_columns) if part.schema.names[i] != "content"]
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            marks = sketch_marks(sketch) if some.any() else [np.zeros(len(texts), np.int64)] * 2
            yield pa.RecordBatch.from_arrays(
                [*kept, bands, *map(pa.array, marks)], names=["uid", "doc_id", "digest", "bands", "mark1", "mark2"]
            )


def similarities(left: list[bytes], right: list[bytes], size: int = SHINGLE_WORDS) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of each pair; 0 for texts without words."""
    keys, counts, owners = [], [], []
    for texts in (left, right):
        shingles, weights, owner = counted_shingles(texts, size)
        keys.append(mix(shingles + mix(owner)) if len(owner) else shingles)
        counts.append(weights)
        owners.append(owner)
    _, a, b = np.intersect1d(keys[0], keys[1], return_indices=True)
    shared = np.bincount(owners[0][a], np.minimum(counts[0][a], counts[1][b]), len(left))
    total = sum(np.bincount(o, c, len(left)) for o, c in zip(owners, counts))
    return shared / np.maximum(total - shared, 1)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, left in pieces(batch, "text_a", SMALL_PIECE):
            right = part.column(part.schema.get_field_index("text_b")).to_pylist()
            found = similarities([t.encode() for t in left], [t.encode() for t in right])
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index(c)) for c in "ab"] + [pa.array(found)], names=["a", "b", "similarity"]
            )


def _verified(pairs: DataFrame, texts: DataFrame, least: float, folder: str, turn: int) -> DataFrame:
    # The crowded side (b) is joined while rows are small; the second join moves texts by the other text.
    right = texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return stored_part(both.mapInArrow(_compare, "a long, b long, similarity double").where(F.col("similarity") >= least), folder, turn)


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for _, texts in pieces(batch, "text", SMALL_PIECE):
            shingles, _, _ = counted_shingles([t.encode() for t in texts], SHINGLE_WORDS)
            counts += np.bincount((shingles % U64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    some = np.flatnonzero(counts)
    for k in range(0, len(some), 1 << 16):
        slots = some[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], names=["slot", "n"])


def parity_bits(shingles: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """PARITY_WORDS words of each text: each occurrence of a shingle turns the bit it is hashed to.

    Two texts whose shingles differ by n occurrences differ in at most n bits, whatever collides, so these never rule out a
    pair that is similar.
    """
    number = np.arange(int(weights.sum())) - np.repeat(np.cumsum(weights) - weights, weights)
    token = mix(np.repeat(shingles, weights) + number.astype(U64) * U64(0x9E3779B97F4A7C15))
    size = 64 * PARITY_WORDS
    at = np.repeat(owner, weights) * size + (token % U64(size)).astype(np.int64)
    odd = (np.bincount(at, minlength=texts * size) & 1).astype(bool)
    return np.packbits(odd.reshape(texts, size), axis=1, bitorder="little").view(np.int64)


def _prefixes(counts: np.ndarray, least: float):
    """Rarest shingles of each text up to a share of 1 - least of its weight, with the weight before each, and parity bits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text", SMALL_PIECE):
                shingles, weights, owner = counted_shingles([t.encode() for t in texts], SHINGLE_WORDS)
                parity = parity_bits(shingles, weights, owner, len(texts))
                times = counts[(shingles % U64(COUNTERS)).astype(np.int64)]
                order = np.lexsort((shingles, times, owner))
                shingles, weights, times = shingles[order], weights[order], times[order]
                length = np.bincount(owner, weights, len(texts)).astype(np.int64)
                before = np.cumsum(weights) - weights
                starts = np.searchsorted(owner, np.arange(len(texts)))
                before -= before[starts[owner]] if len(owner) else 0
                # A shingle that no other text has is only weight.
                at = np.flatnonzero((before <= (1 - least) * length[owner] + 1e-6) & (times > 1))
                of = owner[at]
                uid, root = (np.asarray(part.column(part.schema.get_field_index(c)))[of] for c in ("uid", "root"))
                columns = (shingles[at].view(np.int64), uid, root, length[of], before[at], *parity[of].T)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_PREFIX)

    return rows


_PREFIX = ["shingle", "uid", "root", "length", "before", *(f"bits{k}" for k in range(PARITY_WORDS))]
# Which half of a pair of blocks a row is in; WHOLE: it meets every row of its group.
WHOLE = 2


def _ranged(short, long, columns, least):
    """Pairs (rows of columns) of a shorter and a longer text of one group and different classes that may be similar.

    Texts of the lengths L and M at the similarity share least / (1 + least) * (L + M) of weight, and from their first
    common shingle on each has at least that. They differ in at most (1 - least) / (1 + least) * (L + M) occurrences, and
    so in at most as many parity bits. `short` and `long` are rows in the order of group and length.
    """
    group, root, length, before, side, *bits = columns
    share = least / (1 + least)
    key = (group << 36) + length
    most = np.floor(np.minimum((length[short] - before[short]) / share - length[short], length[short] / least) + 1e-6)
    low = np.searchsorted(key[long], key[short], "left")
    high = np.searchsorted(key[long], (group[short] << 36) + np.maximum(most, 0).astype(np.int64), "right")
    counts = np.maximum(high - low, 0)
    ends = np.cumsum(counts)
    for k in range(0, int(ends[-1]) if len(ends) else 0, LOOKED_AT):
        number = np.arange(k, min(k + LOOKED_AT, int(ends[-1])))
        source = np.searchsorted(ends, number, "right")
        a, b = short[source], long[low[source] + number - (ends - counts)[source]]
        both = share * (length[a] + length[b]) - 1e-6
        kept = (root[a] != root[b]) & (length[b] - before[b] >= both) & ((side[a] != side[b]) | (side[a] == WHOLE))
        a, b = a[kept], b[kept]
        apart = sum(np.bitwise_count((word[a] ^ word[b]).view(U64)).astype(np.int32) for word in bits)
        kept = apart <= (1 - least) / (1 + least) * (length[a] + length[b]) + 1e-6
        yield a[kept], b[kept]


def _group_pairs(rows, columns, least):
    """Pairs of one group: a class that has much of it is paired with the rest and leaves, so that few pairs are of one class."""
    root = columns[1]
    while len(rows):
        roots, sizes = np.unique(root[rows], return_counts=True)
        if sizes.max() * 8 <= len(rows):
            break
        of = root[rows] == roots[sizes.argmax()]
        one, rest = rows[of], rows[~of]
        yield from _ranged(one, rest, columns, least)
        yield from _ranged(rest, one, columns, least)
        rows = rest
    yield from _ranged(rows, rows, columns, least)


def _prefix_pairs(least: float):
    def found(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = table[:, np.lexsort((table[3], table[0]))]
        shingle, uid, root, length, before, *bits, side = table
        new = np.concatenate([[True], shingle[1:] != shingle[:-1]])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(shingle)))
        columns = (np.cumsum(new) - 1, root, length, before, side, *bits)
        large = sizes.astype(np.int64) ** 2 > TAKEN_APART
        small = np.flatnonzero(np.repeat(~large, sizes))
        parts = [_ranged(small, small, columns, least)]
        parts += [_group_pairs(np.arange(s, s + n), columns, least) for s, n in zip(starts[large], sizes[large])]
        for part in parts:
            for a, b in part:
                pairs = np.unique(np.stack([np.maximum(uid[a], uid[b]), np.minimum(uid[a], uid[b])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(p) for p in pairs], names=["a", "b"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows, enough = [], 0, LOOKED_AT
        for batch in batches:
            table = np.stack([np.asarray(c) for c in batch.columns]) if batch.num_rows else np.zeros((batch.num_columns, 0), np.int64)
            waiting.append(table)
            rows += table.shape[1]
            if rows >= enough:
                table = np.concatenate(waiting, axis=1)
                # The last group may go on in the next batch.
                last = int(np.searchsorted(table[0], table[0, -1], "left"))
                if last:
                    yield from found(table[:, :last])
                waiting, rows = [table[:, last:]], table.shape[1] - last
                # A group larger than that is put together few times.
                enough = max(LOOKED_AT, 2 * rows)
        if rows:
            yield from found(np.concatenate(waiting, axis=1))

    return pairs


def _rare_pairs(crowded: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """All pairs (a > b) of the texts in crowded (uid, root) that may be similar and have different roots, none missing."""
    bags = written(texts.join(crowded, "uid").select("uid", "root", "text"), "near-crowded")
    counted = bags.select("text").mapInArrow(_shingle_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    # One number per counter reaches the driver, whatever the size of the table.
    seen = counted.where("n > 1").toArrow()
    counts = np.ones(COUNTERS, np.int64)
    counts[seen["slot"].to_numpy()] = seen["n"].to_numpy()
    rare = written(bags.mapInArrow(_prefixes(counts, least), ", ".join(f"{c} long" for c in _PREFIX)), "near-rare")
    # A frequent shingle's rows go to each pair of blocks that their own block is in, half against half.
    groups = rare.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    groups = groups.select("shingle", F.ceil(F.col("n") / PAIRED_TOGETHER).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
    dealt = rare.join(groups, "shingle").withColumn("own", own)
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pair = F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), WHOLE).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("long")
    # Rows of a block meet each other once, where the block is paired with itself.
    group = F.when(F.col("blocks") == 1, F.col("shingle")).otherwise(pair)
    dealt = dealt.select(group.alias("shingle"), *_PREFIX[1:], side.alias("side"))
    dealt = dealt.repartition("shingle").sortWithinPartitions("shingle")
    return dealt.mapInArrow(_prefix_pairs(least), "a long, b long").distinct()


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size, n_links, kept, text_sha256.

    Texts are linked from `similarity` (weighted Jaccard of five-word shingles); a class is what links and equal texts
    connect. class_id is its least doc_id, and that row is kept (of equal rows one; a null doc_id comes last).
    n_links counts the verified links of a text with other texts; links inside a class that are not needed to connect
    it are not sought. Words are what ASCII white space separates. A text of fewer than five words is one shingle; texts
    without words (null, empty, white space) are only equal to equal ones. An empty table gives an empty result. Other
    columns are ignored.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", digest_of().alias("digest"), text_of().alias("content")
    )
    bands = "uid long, doc_id long, digest string, bands array<long>, mark1 long, mark2 long"
    sketched = written(rows.mapInArrow(_band_rows, bands), "near-bands")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    groups = sketched.groupBy("digest").agg(first.alias("first")).select("digest", F.col("first.uid").alias("text_uid"))
    of_text = written(sketched.join(groups, "digest").select("uid", "doc_id", "digest", "text_uid"), "near-texts")
    single = of_text.where("uid = text_uid").select("uid", "doc_id", "digest")
    entries = sketched.join(single.select("uid"), "uid").select("uid", "mark1", "mark2", F.explode("bands").alias("bucket"))
    leaders = entries.groupBy("bucket").agg(F.min("uid").alias("leader"), F.count("*").alias("n")).where("n > 1")
    shared = written(entries.join(leaders, "bucket"), "near-buckets")

    wanted = shared.select("uid").distinct().join(single, "uid").select("uid", F.col("doc_id").alias("id"), "digest")
    contents = docs.select("doc_id", digest_of().alias("digest"), text_of().alias("text"))
    same = contents["doc_id"].eqNullSafe(wanted["id"]) & (contents["digest"] == wanted["digest"])
    texts = written(contents.join(wanted, same).select("uid", "text").dropDuplicates(["uid"]), "near-contents")

    # First each text with the least leader of its buckets: that joins most of a crowded group.
    # Pairs and links of all rounds are two tables with a part for each round, so that plans do not grow with the rounds.
    spark, tried, links, turn = docs.sparkSession, work_folder(docs.sparkSession, "near-pairs"), work_folder(docs.sparkSession, "near-links"), 0
    pairs = shared.where("uid <> leader").groupBy(F.col("uid").alias("a")).agg(F.min("leader").alias("b"))
    found = _verified(stored_part(pairs, tried, turn), texts, similarity, links, turn)
    classes = link_classes(found, "near-classes").withColumnRenamed("id", "uid")
    while True:
        turn += 1
        now = shared.join(classes, "uid", "left").withColumn("root", F.coalesce("root", "uid")).drop("leader")
        text = F.struct("uid", "root", "mark1", "mark2")
        mixed = now.groupBy("bucket").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.min(text).alias("n0")
        )
        near = now.join(mixed.where("low < high").select("bucket", "n0"), "bucket")
        if turn == 1:
            near = near.withColumnRenamed("n0", "other")
        else:
            cut = F.pmod(F.xxhash64("uid", F.lit(turn)), F.ceil(F.col("n") / ORDERED_TOGETHER))
            order = Window.partitionBy("bucket", "cut").orderBy(F.xxhash64("uid", "bucket", F.lit(turn)), "uid")
            near = near.withColumn("cut", cut).withColumn("other", F.lead(text, 1).over(order))
        apart = F.expr("bit_count(mark1 ^ other.mark1) + bit_count(mark2 ^ other.mark2)")
        near = near.where("other is not null and other.root <> root").select("uid", "n", F.col("other.uid").alias("other"), apart.alias("apart"))
        near = near.where(F.col("apart") <= MARKS_APART).groupBy("uid", "other", "apart").agg(F.min("n").alias("n"))
        # A bucket names one text. The only pair of a bucket of two is always compared.
        nearest = F.row_number().over(Window.partitionBy("uid").orderBy("apart", "other"))
        new = near.withColumn("rank", nearest).where((F.col("rank") <= NEAREST) | (F.col("n") == 2))
        new = new.select(F.greatest("uid", "other").alias("a"), F.least("uid", "other").alias("b")).distinct()
        new = stored_part(new.join(stored_parts(spark, tried, "a long, b long"), ["a", "b"], "left_anti"), tried, turn)
        if new.isEmpty():
            break
        found = _verified(new, texts, similarity, links, turn)
        if found.isEmpty():
            break
        # Classes are stars, so only the new links take rounds.
        stars = classes.select(F.col("uid").alias("a"), F.col("root").alias("b")).union(found.select("a", "b"))
        classes = link_classes(stars, "near-classes").withColumnRenamed("id", "uid")

    # Buckets of two were compared; of the larger ones texts of different classes are left.
    crowded = now.where("n > 2").join(mixed.where("low < high").select("bucket"), "bucket")
    crowded = written(crowded.select("uid", "root").distinct(), "near-crowded")
    if not crowded.isEmpty():
        new = _rare_pairs(crowded, texts, similarity).join(stored_parts(spark, tried, "a long, b long"), ["a", "b"], "left_anti")
        found = _verified(stored_part(new, tried, turn + 1), texts, similarity, links, turn + 1)
        if not found.isEmpty():
            stars = classes.select(F.col("uid").alias("a"), F.col("root").alias("b")).union(found.select("a", "b"))
            classes = link_classes(stars, "near-classes").withColumnRenamed("id", "uid")

    ends = stored_parts(spark, links, "a long, b long").select(F.explode(F.array("a", "b")).alias("text_uid")).groupBy("text_uid").agg(F.count("*").alias("n_links"))
    of_class = classes.withColumnRenamed("uid", "text_uid")
    placed = of_text.join(of_class, "text_uid", "left").join(ends, "text_uid", "left")
    placed = written(placed.withColumn("root", F.coalesce("root", "text_uid")), "near-placed")
    class_rows = placed.groupBy("root").agg(first.alias("first"), F.count("*").alias("class_size"))
    return placed.join(class_rows, "root").select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        "class_size",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (F.col("uid") == F.col("first.uid")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, all columns as they are."""
    classes = near_classes(docs)
    return keep_rows(docs, classes.where("kept").select("doc_id", F.col("text_sha256").alias("digest")))
