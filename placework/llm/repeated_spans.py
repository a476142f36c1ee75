"""Repeated byte strings: every byte inside a string of `size` bytes that starts at another place too.

1. Sampling. Each window of `size` bytes has a least hashed gram (its minimizer), the same in equal windows and at the
   same place in them. Consecutive windows with one minimizer are a run; a run is known by its gram and the digest of
   its bytes. Two places of equal runs are repeated whole. A gram that only one run has repeats nowhere.
2. Suffix arrays. What is left are different runs with one gram: one copy of each meets in a shard by its gram. The
   shard's suffix array is made by induced sorting; permuted common prefixes of at least `size` bytes name
   the repeated windows. Grams of very many different runs (a common passage in ever other surroundings) would make a shard of
   any size; their windows are counted by digest instead, in as many tasks as there are.
3. Windows become byte ranges of their documents, ranges are joined, and the rest of each text is digested.

Texts are kept compressed in a table of the shared folder, so that each later step moves only what it needs.
Digests have 128 bits and are cryptographic (BLAKE2b); equal digests count as equal bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, pieces, seeded, text_of, written
from .suffix_array import common_prefixes, suffix_array

SIZE = 400
GRAM = 64
# Bytes of runs in one suffix array, and different runs of a gram from which windows are counted by digest.
SHARD_BYTES = 1 << 20
MANY_RUNS = 1500

_BYTE = seeded(31, 256)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes from each place on, by doubling."""
    total, have, factor = _BYTE[data], 1, np.array([0x9E3779B97F4A7C15], U64)
    out, out_have = None, 0
    while True:
        if gram & have:
            if out is None:
                out, out_have = total, have
            else:
                k = len(total) - out_have
                out, out_have = out[:k] * factor + total[out_have : out_have + k], out_have + have
        if 2 * have > gram:
            break
        total, factor = total[:-have] * factor + total[have:], factor * factor
        have *= 2
    return out


def window_runs(data: bytes, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and gram hash of each run of windows with one minimizer (the leftmost)."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    hashes = mix(_gram_hashes(np.frombuffer(data, np.uint8), gram))
    width = size - gram + 1
    windows = n - size + 1
    # Least value over `width` grams by doubling; ties go to the left.
    low, have = hashes, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    low = np.minimum(low[:windows], low[width - have : width - have + windows])
    # A run ends where the least value changes, and where its leftmost place leaves the window.
    change = np.flatnonzero(low[1:] != low[:-1]) + 1
    begins = np.concatenate([[0], change])
    ends = np.append(change, windows)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    out = []
    # The leftmost place at or after each start of a stretch: places of a value are in order in `order`.
    left = np.searchsorted(ranked, low[begins], "left")
    right = np.searchsorted(ranked, low[begins], "right")
    for begin, end, a, b, value in zip(begins.tolist(), ends.tolist(), left.tolist(), right.tolist(), low[begins].tolist()):
        if b - a == 1:
            out.append((begin, end - begin, value))
            continue
        places = order[a:b]
        k = int(np.searchsorted(places, begin))
        while begin < end:
            stop = min(end, int(places[k]) + 1)
            out.append((begin, stop - begin, value))
            begin, k = stop, k + 1
    starts, counts, values = zip(*out)
    return np.array(starts), np.array(counts), np.array(values, U64)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


_RUN = pa.struct([("start", pa.int64()), ("windows", pa.int32()), ("gram", pa.int64()), ("digest", pa.binary())])


def _sampler(size: int, gram: int):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "content", 1 << 20):
                offsets, starts, counts, grams, digests, packed, sizes = [0], [], [], [], [], [], []
                for text in texts:
                    data = text.encode()
                    s, c, g = window_runs(data, size, gram)
                    digests += [_digest(data[a : a + k + size - 1]) for a, k in zip(s.tolist(), c.tolist())]
                    starts.append(s)
                    counts.append(c)
                    grams.append(g)
                    offsets.append(offsets[-1] + len(s))
                    packed.append(zlib.compress(data, 1))
                    sizes.append(len(data))
                columns = [
                    pa.array(np.concatenate(starts), pa.int64()),
                    pa.array(np.concatenate(counts).astype(np.int32), pa.int32()),
                    pa.array(np.concatenate(grams).view(np.int64), pa.int64()),
                    pa.array(digests, pa.binary()),
                ]
                runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_RUN)))
                kept = [part.column(part.schema.get_field_index(c)) for c in ("uid", "doc_id")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(packed, pa.binary()), runs], names=["uid", "doc_id", "n_bytes", "packed", "runs"])

    return sample


def _cut_runs(size: int):
    """The bytes of the wanted runs of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, packed in pieces(batch, "packed", 1 << 20):
                data = [zlib.decompress(p) for p in packed]
                wanted = part.column(part.schema.get_field_index("wanted")).to_pylist()
                rows = [(w["gram"], w["digest"], d[w["start"] : w["start"] + w["windows"] + size - 1]) for d, own in zip(data, wanted) for w in own]
                for at in range(0, len(rows), 2000):
                    grams, digests, strings = zip(*rows[at : at + 2000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grams, pa.int64()), pa.array(digests, pa.binary()), pa.array(strings, pa.binary())],
                        names=["gram", "digest", "bytes"],
                    )

    return cut


def repeated_windows(strings: list[bytes], size: int) -> list[np.ndarray]:
    """For each string the places of its windows that start anywhere else in the strings too."""
    lengths = np.array([len(s) for s in strings])
    begins = np.cumsum(lengths + 1) - lengths - 1
    # Bytes are 2 and up, 1 parts strings, 0 ends the text; a window with a border in it equals no window without.
    text = np.ones(int((lengths + 1).sum()) + 1, np.uint16)
    for begin, string in zip(begins.tolist(), strings):
        text[begin : begin + len(string)] = np.frombuffer(string, np.uint8).astype(np.uint16) + 2
    text[-1] = 0
    prefix, before = common_prefixes(text, suffix_array(text))
    owner = np.repeat(np.arange(len(strings)), lengths + 1)
    inside = np.append(np.arange(len(text) - 1) - begins[owner] <= lengths[owner] - size, False)
    found = np.zeros(len(text), bool)
    hit = np.flatnonzero((prefix >= size) & inside)
    found[hit] = True
    found[before[hit]] = True
    found &= inside
    return [np.flatnonzero(found[b : b + n]) for b, n in zip(begins.tolist(), lengths.tolist())]


def _ranges(places: np.ndarray) -> list[dict]:
    """Whole numbers in order as ranges [low, high)."""
    if not len(places):
        return []
    new = np.flatnonzero(np.diff(places) != 1) + 1
    return [{"low": int(p[0]), "high": int(p[-1]) + 1} for p in np.split(places, new)]


_FOUND = "digest binary, ranges array<struct<low:int,high:int>>"
_FOUND_TYPE = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))


def _sorter(size: int):
    def shard(rows) -> pa.RecordBatch:
        found = [_ranges(p) for p in repeated_windows([r[1] for r in rows], size)]
        kept = [(r[0], f) for r, f in zip(rows, found) if f]
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in kept], pa.binary()), pa.array([k[1] for k in kept], _FOUND_TYPE)], names=["digest", "ranges"]
        )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by gram; a shard ends between two grams."""
        rows, total, last = [], 0, None
        for batch in batches:
            for gram, digest, string in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("gram", "digest", "bytes")]):
                if gram != last and total >= SHARD_BYTES:
                    yield shard(rows)
                    rows, total = [], 0
                rows.append((digest, string))
                total += len(string)
                last = gram
        if rows:
            yield shard(rows)

    return sort


def _counter(size: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, strings in pieces(batch, "bytes", 1 << 18):
                digests = part.column(part.schema.get_field_index("digest")).to_pylist()
                rows = [(d, k, _digest(s[k : k + size])) for d, s in zip(digests, strings) for k in range(len(s) - size + 1)]
                columns = list(zip(*rows))
                kinds = [pa.binary(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["digest", "place", "window"])

    return windows


def _remover(size: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, packed in pieces(batch, "packed", 1 << 20):
                spans = part.column(part.schema.get_field_index("spans")).to_pylist()
                removed, counts, digests = [], [], []
                for data, own in zip(map(zlib.decompress, packed), spans):
                    kept, end, gone, number = hashlib.sha256(), 0, 0, 0
                    # Ranges of window starts; the removed bytes reach to the end of the last window.
                    for low, high in sorted((s["low"], s["high"]) for s in own or ()):
                        high += size - 1
                        if low > end or not number:
                            kept.update(data[end:low])
                            number += 1
                            gone += high - low
                        else:
                            gone += max(high - end, 0)
                        end = max(end, high)
                    kept.update(data[end:])
                    removed.append(gone)
                    counts.append(number)
                    digests.append(kept.hexdigest())
                columns = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "n_bytes")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return remove


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, many_runs: int = MANY_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs.

    Texts are UTF-8 bytes (null: empty); every byte that a string of `size` bytes covers which also starts at another place,
    in the same or another row, is removed. Matches do not cross rows and are judged on the texts as they are. Texts
    shorter than `size` lose nothing. Repeated rows are copies of each other and get a row each. An empty table gives an
    empty result. Other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", text_of().alias("content"))
    run = "struct<start:bigint,windows:int,gram:bigint,digest:binary>"
    stored = written(
        rows.mapInArrow(_sampler(size, gram), f"uid long, doc_id long, n_bytes long, packed binary, runs array<{run}>"), "repeat-runs"
    )
    runs = stored.select("uid", F.explode("runs").alias("run")).select("uid", "run.*")
    # Different runs: how often each occurs, and one place of it.
    place = F.min(F.struct("uid", "start", "windows")).alias("place")
    different = runs.groupBy("gram", "digest").agg(F.count("*").alias("times"), place)
    grams = different.groupBy("gram").agg(F.count("*").alias("kinds"), F.max("times").alias("times"))
    grams = grams.where("kinds > 1 OR times > 1").select("gram", "kinds")
    different = written(different.join(grams, "gram"), "repeat-kinds")

    # One copy of each run of a gram that has several, as bytes.
    wanted = different.where("kinds > 1").groupBy("place.uid").agg(
        F.collect_list(F.struct("gram", "digest", F.col("place.start").alias("start"), F.col("place.windows").alias("windows"))).alias("wanted")
    )
    strings = stored.select("uid", "packed").join(wanted, "uid").select("packed", "wanted")
    strings = strings.mapInArrow(_cut_runs(size), "gram long, digest binary, bytes binary")
    many = different.where(F.col("kinds") > many_runs).select("gram").distinct()
    strings = written(strings, "repeat-strings")
    few = strings.join(many, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram", "digest")
    found = few.mapInArrow(_sorter(size), _FOUND)
    windows = strings.join(many, "gram", "left_semi").select("digest", "bytes").mapInArrow(_counter(size), "digest binary, place int, window binary")
    windows = written(windows, "repeat-windows")
    again = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    counted = windows.join(again, "window").groupBy("digest").agg(F.collect_list(F.struct(F.col("place").alias("low"), (F.col("place") + 1).alias("high"))).alias("ranges"))
    # Runs that occur again are repeated whole.
    whole = different.where("times > 1").select("digest", F.array(F.struct(F.lit(0).alias("low"), F.col("place.windows").alias("high"))).alias("ranges"))
    found = written(found.union(counted).union(whole), "repeat-found")

    spans = runs.select("uid", "start", "digest").join(found, "digest").select("uid", "start", F.explode("ranges").alias("range"))
    low, high = (F.col("start") + F.col(f"range.{c}") for c in ("low", "high"))
    spans = spans.groupBy("uid").agg(F.collect_list(F.struct(low.alias("low"), high.alias("high"))).alias("spans"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return stored.select("uid", "doc_id", "n_bytes", "packed").join(spans, "uid", "left").select("doc_id", "n_bytes", "packed", "spans").mapInArrow(_remover(size), out)
