"""Stretches of a text that repeat with a period: tiles per octave of periods, stitched by document and period.

A position i matches for a period q when words i and i + q are the same. A stretch with period q is a maximal interval
of matching positions, [start, stop) of words start to stop + q - 1. For periods of an octave [P, 2P) a document is cut
into tiles, a fixed number of octave lengths long, that overlap by what a period reaches. Inside a tile boundaries lie
w words apart. An interval long enough to count is at least 2w - 1 long, so it covers all words from some boundary to the
next. Where the w words behind a boundary equal those a period later, the Z-values of the boundary, forward and
backward, give the interval around it up to the next boundaries; what overlaps is one interval. Intervals that reach a
tile's border are put together with their neighbours' by document and period. Words are numbers (equal exactly for equal
words), and Z-values come from 64-bit hashes of 2, 4, 8, ... words, by halving steps for all boundaries of a batch at once.

A stretch of period q also has the periods 2q, 3q, ...: of periods with the same first and last word the least counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, pieces, text_of

U64 = np.uint64
LEAST = 12  # words of the shortest stretch
BASE_OCTAVES = 8  # periods 1 to 255 share their tiles
BASE_CORE = 8192  # words of such a tile without its overlap
CORE_PERIODS = 16  # the same for each greater octave, in least periods of the octave
CELLS = 1 << 21  # comparisons at a time
BATCH_WORDS = 1 << 20


def _step(octave: int) -> int:
    """Distance of boundaries for periods from P = 2 ** octave: 2 * step - 1 <= max(P, 12 - (2P - 1))."""
    return (4, 4, 2)[octave] if octave < 3 else 1 << (octave - 1)


def tiles_of(n: int, base: int = BASE_OCTAVES, core: int = BASE_CORE, factor: int = CORE_PERIODS) -> list[tuple]:
    """(first octave, last octave, start of the core, its end, first word, end of the words) of each tile of n words.

    Consecutive octaves for which the document is one tile share it.
    """
    if n < LEAST:
        return []
    top = max(0, (n // 2).bit_length() - 1)  # the octave of the greatest period, n // 2
    whole_to, out = -1, []
    for low in [0, *range(base, top + 1)]:
        high = min(top, base - 1) if low == 0 else low
        size = core if low == 0 else factor << low
        if n <= size and whole_to == low - 1:
            whole_to = high
            continue
        if n <= size:
            out.append((low, high, 0, n, 0, n))
            continue
        reach = 1 << (base - 1 if low == 0 else low)
        for at in range(0, n, size):
            end = min(n, at + size)
            out.append((low, high, at, end, max(0, at - reach), min(n, end + 3 * reach)))
    return [(0, whole_to, 0, n, 0, n), *out] if whole_to >= 0 else out


TILE_FIELDS = "n long, low int, high int, core long, core_end long, first long, words array<int>"


def _cut(options: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                split = [t.split() for t in texts]  # bytes: the six white space characters of ASCII
                ends = np.cumsum([0, *map(len, split)])
                flat = pa.array([w for words in split for w in words], pa.binary())
                numbers = flat.dictionary_encode().indices.to_numpy()
                rows = [(r, len(words), tile) for r, words in enumerate(split) for tile in tiles_of(len(words), *options)]
                at = 0
                while at < len(rows):
                    taken, size = [], 0
                    while at < len(rows) and (not taken or size < BATCH_WORDS):
                        taken.append(rows[at])
                        size += rows[at][2][5] - rows[at][2][4]
                        at += 1
                    r = pa.array([t[0] for t in taken])
                    fields = np.array([t[2] for t in taken], np.int64)
                    lists = [numbers[ends[t[0]] + t[2][4] : ends[t[0]] + t[2][5]] for t in taken]
                    offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(r),
                            part.column(1).take(r),
                            pa.array([t[1] for t in taken], pa.int64()),
                            pa.array(fields[:, 0].astype(np.int32)),
                            pa.array(fields[:, 1].astype(np.int32)),
                            pa.array(fields[:, 2]),
                            pa.array(fields[:, 3]),
                            pa.array(fields[:, 4]),
                            pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists).astype(np.int32))),
                        ],
                        names=["doc_id", "content", "n", "low", "high", "core", "core_end", "first", "words"],
                    )

    return run


def _merged(period: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the intervals of each period that overlap or touch."""
    if not len(period):
        return period, start, stop
    order = np.lexsort((start, period))
    period, start, stop = period[order], start[order], stop[order]
    # One axis: the intervals of a greater period lie behind all of a smaller one.
    lift = period * (int(stop.max()) + 2)
    reach = np.maximum.accumulate(lift + stop)
    new = np.concatenate([[True], (lift + start)[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(period) - 1)
    return period[new], start[new], (reach - lift)[last]


def octave_intervals(hashes: dict[int, np.ndarray], owner: np.ndarray, octave: int) -> tuple[np.ndarray, ...]:
    """(period, start, stop) of matching intervals around all boundaries, in places of the batch.

    `hashes[s]` are those of the s words from each place on; `owner` is the tile of a place. Places between tiles hold
    words that are equal to no other, so no interval leaves its tile.
    """
    least, step = 1 << octave, _step(octave)
    window = hashes[step]
    rows = max(0, len(window) - 2 * least) // step
    per_block = max(1, CELLS // least)
    found = []
    for block in range(0, rows, per_block):
        count = min(per_block, rows - block)
        base = window[block * step :]
        later = np.lib.stride_tricks.as_strided(base[least:], (count, least), (8 * step, 8), writeable=False)
        row, column = np.nonzero(later == base[: count * step : step, None])
        if not len(row):
            continue
        place, period = (block + row) * step, column + least
        same = owner[place] == owner[place + period]
        place, period = place[same], period[same]
        start, stop, size = place.copy(), place + step, step // 2
        # The Z-values of the boundary, less than a step each: what is longer has the next boundary inside.
        while size:
            z = hashes[size]
            stop += np.where(z[stop] == z[stop + period], size, 0)
            back = start - size
            start = np.where((back >= 0) & (z[back] == z[back + period]), back, start)
            size //= 2
        found.append(_merged(period, start, stop))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return _merged(*(np.concatenate(x) for x in zip(*found)))


def _solve_together(words: list[np.ndarray], low: int, high: int):
    """All intervals of some tiles with the same octaves: (tile, period, start, stop), in words of the tile."""
    align = max(_step(o) for o in range(low, high + 1))
    sizes = [-(-(len(w) + align) // align) * align for w in words]  # at least a step apart
    begins = align + np.cumsum([0, *sizes])
    total = int(begins[-1]) + (5 << high)
    ids = -1 - np.arange(total, dtype=np.int64)
    owner = np.full(total, -1, np.int32)
    for k, w in enumerate(words):
        ids[begins[k] : begins[k] + len(w)] = w
        owner[begins[k] : begins[k] + len(w)] = k
    hashes, size = {1: mix(ids)}, 1
    while size < align:
        one = hashes[size]
        hashes[2 * size] = mix(one[:-size] * U64(0x9E3779B97F4A7C15) + one[size:])
        size *= 2
    for octave in range(low, high + 1):
        period, start, stop = octave_intervals(hashes, owner, octave)
        tile = owner[start]
        yield tile, period, start - begins[tile], stop - begins[tile], _step(octave)


FOUND_FIELDS = "period long, start long, stop long"
RUNS = "array<struct<start:long,length:long,period:long>>"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        n, low, high, core, core_end, first = (
            columns[c].to_numpy() for c in ("n", "low", "high", "core", "core_end", "first")
        )
        lists, offsets = columns["words"].flatten().to_numpy(), columns["words"].offsets.to_numpy()
        offsets = offsets - offsets[0]
        for a, b in sorted(set(zip(low.tolist(), high.tolist()))):
            rows = np.flatnonzero((low == a) & (high == b))
            ends = np.cumsum(np.diff(offsets)[rows])
            for part in np.split(rows, np.searchsorted(ends, np.arange(BATCH_WORDS, ends[-1], BATCH_WORDS))):
                if not len(part):
                    continue
                tiles = [lists[offsets[r] : offsets[r + 1]] for r in part]
                out = []
                for tile, period, start, stop, step in _solve_together(tiles, a, b):
                    r = part[tile]
                    start, stop = start + first[r], stop + first[r]
                    # What lies further from the core is the next tile's, whose words here may end before the interval.
                    from_, to = np.maximum(core[r] - step, 0), core_end[r] + step
                    start, stop = np.maximum(start, from_), np.minimum(stop, to)
                    open_ = ((start == from_) & (from_ > 0)) | ((stop == to) & (core_end[r] < n[r]))
                    keep = (stop > start) & (open_ | (stop - start >= np.maximum(period, LEAST - period)))
                    out.append(tuple(x[keep] for x in (r, period, start, stop, open_)))
                r, period, start, stop, open_ = (np.concatenate(x) for x in zip(*out))
                # Of whole stretches with the same ends the least period counts; multiples go here, not in the shuffle.
                order = np.lexsort((period, stop + period, start, r, open_))
                key = np.stack([r, start, stop + period])[:, order]
                first_of = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])[: len(order)] | open_[order]
                chosen = order[first_of]
                at = pa.array(r[chosen])
                yield pa.RecordBatch.from_arrays(
                    [columns["doc_id"].take(at), columns["content"].take(at), *(pa.array(x[chosen]) for x in (period, start, stop))],
                    names=["doc_id", "content", "period", "start", "stop"],
                )


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs_at = batch.schema.get_field_index("runs")
        for part, texts in pieces(batch, "text"):
            runs = part.column(runs_at)
            spans, offsets = runs.flatten(), np.cumsum([0, *runs.value_lengths().to_pylist()])
            start, length, period = (spans.field(k).to_numpy() for k in range(3))
            out = []
            for k, text in enumerate(texts):
                words = text.split()
                a, b = offsets[k : k + 2]
                if b > a:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, start[a:b] + period[a:b], 1)
                    np.add.at(change, start[a:b] + length[a:b], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                out.append(b" ".join(words))
            collapsed = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), runs, collapsed], names=["doc_id", "runs", "collapsed"])


def periodic_runs(
    docs: DataFrame, base: int = BASE_OCTAVES, core: int = BASE_CORE, factor: int = CORE_PERIODS
) -> DataFrame:
    """doc_id, runs (array of start, length, period by start, then period), collapsed text of every row of docs.

    Words are runs of characters other than ASCII white space, numbered from 0. A run is a stretch with least period q,
    at least max(12, 2q) words long, that no neighbouring word extends. The collapsed text has the words, one space
    apart, without those that any run contains after its first q words. base, core and factor set the size of tiles and
    change no result (base at least 3, core a multiple of 2 ** base). Null and empty texts have no runs and an empty text; fewer than 12 words no runs. Rows are
    independent: repeated rows and null ids each get their row. An empty table gives an empty result; other columns
    are ignored. A text's words and runs are held by one task at a time, like the row itself.
    """
    if base < 3 or core % (1 << base) or factor < 1:
        raise ValueError("base must be 3 or more, core a multiple of 2 ** base, factor 1 or more")
    id_field = docs.schema["doc_id"]
    key = [T.StructField("doc_id", id_field.dataType), T.StructField("content", T.LongType())]
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("content"), text_of().alias("text"))
    as_bytes = rows.select("doc_id", "content", F.col("text").cast("binary").alias("text"))
    tiles = as_bytes.mapInArrow(_cut((base, core, factor)), T.StructType([*key, *T._parse_datatype_string(TILE_FIELDS)]))
    found = tiles.mapInArrow(_solve, T.StructType([*key, *T._parse_datatype_string(FOUND_FIELDS)]))
    runs = stitched(found, ["doc_id", "content"])
    runs = runs.select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"), "runs")
    joined = as_bytes.join(runs, as_bytes["doc_id"].eqNullSafe(runs["_id"]) & (as_bytes["content"] == runs["_content"]), "left")
    schema = T.StructType([key[0], *T._parse_datatype_string(f"runs {RUNS}, collapsed string")])
    every = F.coalesce("runs", F.array().cast(RUNS)).alias("runs")
    return joined.select("doc_id", "text", every).mapInArrow(_collapse, schema)


def stitched(found: DataFrame, key: list[str]) -> DataFrame:
    """Intervals (key, period, start, stop) -> key, runs: overlapping ones put together, least period of each stretch."""
    before = Window.partitionBy(*key, "period").orderBy("start", "stop")
    reach = F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach >= F.col("start"), 0).otherwise(1)
    islands = found.withColumn("_new", new).withColumn("_island", F.sum("_new").over(before))
    whole = islands.groupBy(*key, "period", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    long_enough = F.col("stop") - F.col("start") >= F.greatest(F.col("period"), LEAST - F.col("period"))
    ends = whole.where(long_enough).withColumn("_end", F.col("stop") + F.col("period"))
    # A stretch with a smaller period has the same ends, so the same group.
    least = ends.groupBy(*key, "start", "_end").agg(F.min("period").alias("period"))
    run = F.struct("start", (F.col("_end") - F.col("start")).alias("length"), "period")
    runs = least.groupBy(*key).agg(F.collect_list(run).alias("runs"))
    by_place = F.transform("runs", lambda r: F.struct(r["start"], r["period"], r["length"]))
    back = F.transform(F.array_sort(by_place), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    return runs.select(*key, back.alias("runs"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which a tenth of the documents repeats from some word on.

    With h = crc32(decimal doc_id) and g = floor(h / 10): if h % 10 = 0 and there are n > 0 words, word i >= a becomes word
    a + (i - a) % p, a = g % n, p = 1 + floor((n - a) / (3 + g % 8)). A null id changes nothing.
    """
    text = text_of()
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    hash_ = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", text.alias("text"), hash_.alias("_h"))
    chosen = rows.withColumn("_words", F.when(F.col("_h") % 10 == 0, words).otherwise(F.array().cast("array<string>")))
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    unit = F.slice("_words", a + 1, p)
    times = F.ceil((n - a) / p).cast("int")
    changed = F.slice(F.concat(F.slice("_words", F.lit(1), a), F.flatten(F.array_repeat(unit, times))), F.lit(1), n)
    return chosen.select("doc_id", F.when(n > 0, F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(runs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: least start, then period), digests of all runs and of the collapsed text."""
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"], r["period"], r["length"]))
    best = F.get(F.array_sort(order), 0)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text: Column = F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n"))))
    return runs.select("*", best.alias("_best"), text.alias("_lines")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2("_lines", 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
