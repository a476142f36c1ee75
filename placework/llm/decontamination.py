"""Benchmark passages in documents, with edits: random walks, sampled coordinates, exact edit distance.

Texts are sequences of words (lower case, without ASCII punctuation). The random walk of Chakraborty, Goldenberg and
Koucky (2016) reads a sequence, writes the word it stands on at each step and goes on to the next word when a random
bit of step and word says so. Two sequences with few edits fall back into step, so edit distance becomes Hamming
distance, and equal samples of coordinates are a locality-sensitive hash.

An item-sized window is embedded by walks that start anew at each of its words, in WALKS repetitions with other
bits and samples. A walk of WALK_STEPS steps reads about half as many words, so any clean stretch of that length shows the
window, wherever its edits lie, and the walks of a document are the same for all windows that contain their start:
they are made once per word. An equal sample at word p of a document and word o of an item names the window at p - o.
`expected_recall` gives the share found at an edit rate. Named windows are verified by edit distance over words.

Short items, for which walks leave the item, are cut by the pigeonhole rule instead: of d + 1 parts one has no edit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SMALL_PIECE, U64, mix, pieces, seeded, text_of, word_hashes, written

# An item of n words is matched by a run of words at an edit distance of at most this share of n.
DISTANCE_SHARE = 0.2
WALKS, WALK_STEPS, SAMPLED = 5, 12, 5
# Walks that read fewer words name no window.
WALK_READS = 4
SHORT_ITEM = 16
# Items that one pass over the documents looks for; more items take more passes.
BLOCK_BYTES = 8 << 20

_FILTER_BITS = 20
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_BITS = seeded(21, WALKS * WALK_STEPS).reshape(WALKS, WALK_STEPS) | U64(1)
_COORDINATE = seeded(22, WALKS * WALK_STEPS).reshape(WALKS, WALK_STEPS) | U64(1)
_GRAM = seeded(23, SHORT_ITEM) | U64(1)


def _samples() -> list[list[int]]:
    """Sampled steps of each walk: the first and others at random."""
    order = np.argsort(seeded(24, WALKS * WALK_STEPS).reshape(WALKS, WALK_STEPS)[:, 1:], axis=1)[:, : SAMPLED - 1] + 1
    return [[0, *sorted(row.tolist())] for row in order]


_SAMPLES = _samples()


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([(t or "").lower().encode() for t in texts], _PUNCTUATION)


def _walk(words: np.ndarray, walk: int, filters: list[np.ndarray] | None = None):
    """Sampled key of the walk from each word, the word it starts at and the last word it reads.

    filters: for each sampled step, which low bits of keys can still match; other walks end there.
    """
    padded = np.concatenate([words, np.zeros(WALK_STEPS, U64)])
    start = now = np.arange(len(words))
    key, reached = np.zeros(len(words), U64), []
    for step in range(_SAMPLES[walk][-1] + 1):
        here = padded[now]
        if step in _SAMPLES[walk]:
            key = mix(key + here * _COORDINATE[walk, step])
            if filters is None:
                reached.append(key)
            else:
                open_ = filters[len(reached)][key & U64((1 << _FILTER_BITS) - 1)]
                start, now, key, here = start[open_], now[open_], key[open_], here[open_]
                reached.append(None)
        last = now
        now = now + ((here * _BITS[walk, step]) >> U64(63)).astype(np.int64)
    return key, start, last, reached


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each word on; the last ones have too few and give no value."""
    count = max(len(words) - size + 1, 0)
    total = np.full(count, size, U64)
    for k in range(size):
        total = total + words[k : k + count] * _GRAM[k]
    return mix(total)


class Items:
    """Search structure of a block of items; its size is bounded by BLOCK_BYTES of item text."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        words, offsets = words_of(texts)
        self.ids = ids
        self.words = [words[a:b] for a, b in zip(offsets, offsets[1:])]
        self.most = [int(DISTANCE_SHARE * len(w)) for w in self.words]
        self.tables, self.filters, self.grams = [], [], {}
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        place = np.arange(len(words)) - offsets[:-1][owner]
        long_ = np.diff(offsets)[owner] >= SHORT_ITEM
        for walk in range(WALKS):
            _, _, last, reached = _walk(words, walk)
            # A walk that stood still for long has read too little to name a window.
            inside = long_ & (last < offsets[1:][owner]) & (last >= np.arange(len(words)) + WALK_READS - 1)
            self.tables.append(self._table(reached[-1][inside], owner[inside], place[inside]))
            masks = []
            for keys in reached:
                masks.append(np.zeros(1 << _FILTER_BITS, bool))
                masks[-1][keys[inside] & U64((1 << _FILTER_BITS) - 1)] = True
            self.filters.append(np.packbits(masks, axis=1))
        short: dict[int, list] = {}
        for item, own in enumerate(self.words):
            if 0 < len(own) < SHORT_ITEM:
                parts = np.array_split(np.arange(len(own)), self.most[item] + 1)
                for part in parts:
                    key = _grams(own[part], len(part))[0]
                    short.setdefault(len(part), []).append((key, item, int(part[0])))
        for size, rows in short.items():
            keys, items, places = zip(*rows)
            self.grams[size] = self._table(np.array(keys, U64), np.array(items), np.array(places))

    @staticmethod
    def _table(keys, owner, place):
        order = np.argsort(keys, kind="stable")
        return keys[order], owner[order], place[order]

    def unpacked(self) -> list[list[np.ndarray]]:
        return [[np.unpackbits(m).view(bool) for m in masks] for masks in self.filters]

    def candidates(self, words: np.ndarray, filters) -> np.ndarray:
        """Rows (item, first word of the window) of one run of words; a window may begin before it or end after it."""
        found = []

        def look(table, keys, start):
            low, high = np.searchsorted(table[0], keys, "left"), np.searchsorted(table[0], keys, "right")
            source = np.repeat(np.arange(len(keys)), high - low)
            entry = low[source] + np.arange(len(source)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            found.append(np.stack([table[1][entry], start[source] - table[2][entry]], axis=1))

        for walk, table in enumerate(self.tables):
            if len(table[0]):
                key, start, _, _ = _walk(words, walk, filters[walk])
                look(table, key, start)
        for size, table in self.grams.items():
            keys = _grams(words, size)
            look(table, keys, np.arange(len(keys)))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def least_distance(item: list[int], words: list[int]) -> tuple[int, int]:
    """Least number of inserted, removed and replaced words between an item and any run of the words, and where the
    first best run ends (Myers' bit vectors over words)."""
    size = len(item)
    masks: dict[int, int] = {}
    for k, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << k
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = size, 0
    for at, word in enumerate(words, 1):
        equal = masks.get(word, 0)
        vertical = equal | minus
        cross = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(cross | plus) & full, plus & cross
        score += 1 if up & top else -1 if down & top else 0
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
        if score < best:
            best, end = score, at
    return best, end


def _matches(items: Items, filters, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """Index of the text, index of the item, distance, first and last word of the looked-at run up to the best end."""
    words, offsets = words_of(texts)
    found = items.candidates(words, filters)
    if not len(found):
        return []
    # A key is read inside one text or across a border; the window is looked at inside the text of its start word.
    sizes = np.array([len(w) for w in items.words])
    rows = []
    for shift in (0, sizes[found[:, 0]] // 2, sizes[found[:, 0]] - 1):
        owner = np.searchsorted(offsets, np.clip(found[:, 1] + shift, 0, len(words) - 1), "right") - 1
        rows.append(np.stack([owner, found[:, 0], found[:, 1]], axis=1))
    rows = np.unique(np.concatenate(rows), axis=0)
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    k = 0
    while k < len(rows):
        text, item, start = rows[k].tolist()
        most, size = items.most[item], sizes[item]
        low, high = start - most, start + size + most
        k += 1
        while k < len(rows) and rows[k, 0] == text and rows[k, 1] == item and rows[k, 2] - most <= high:
            high = int(rows[k, 2]) + size + most
            k += 1
        low, high = max(low, offsets[text]), min(high, offsets[text + 1])
        run = words[low:high]
        # Words of the item that are nowhere in the run need an edit each.
        if np.isin(items.words[item], run).sum() < size - most:
            continue
        distance, end = least_distance(items.words[item].tolist(), run.tolist())
        if distance <= most and distance < out.get((text, item), (most + 1,))[0]:
            out[text, item] = (distance, int(low - offsets[text]), int(low - offsets[text] + end))
    return [(text, item, *best) for (text, item), best in sorted(out.items())]


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items that have words, in blocks of bounded size."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", text_of().alias("text")).toLocalIterator():
        if ids and size + len(row["text"]) > BLOCK_BYTES:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
    if ids:
        yield Items(ids, texts)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, item_words, first_word, end_word: items that occur in a document of docs.

    One row per row of docs and item: the best place, with a distance of at most a fifth of the item's words. The
    found run lies in the words first_word to end_word of the document. Items without words are in no
    document; null and empty texts contain none; repeated rows and items give a row each. Empty tables give an empty
    result. Other columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, item_words int, first_word int, end_word int"
    found = [spark.createDataFrame([], schema)]
    for items in _blocks(benchmark):

        def search(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            filters = None
            for batch in batches:
                filters = filters or items.unpacked()
                for part, texts in pieces(batch, "text", SMALL_PIECE):
                    rows = _matches(items, filters, texts)
                    ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
                    data = [(ids[t], items.ids[i], d, len(items.words[i]), a, b) for t, i, d, a, b in rows]
                    columns = list(zip(*data)) or [()] * 6
                    kinds = [pa.int64()] * 2 + [pa.int32()] * 4
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in schema.split(", ")]
                    )

        found.append(written(docs.select("doc_id", "text").mapInArrow(search, schema), "benchmark-matches"))
    out = found[-1] if len(found) == 2 else found[0]
    for more in found[1:] if len(found) != 2 else []:
        out = out.union(more)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no item of the benchmark, all columns as they are."""
    for items in _blocks(benchmark):

        def clean(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            filters = None
            for batch in batches:
                filters = filters or items.unpacked()
                for part, texts in pieces(batch, "text", SMALL_PIECE):
                    hit = {row[0] for row in _matches(items, filters, texts)}
                    yield part.filter(pa.array([k not in hit for k in range(part.num_rows)]))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def expected_recall(item_words: int, edit_rate: float, trials: int = 2000, seed: int = 0) -> float:
    """Share of items found when each word is replaced with probability edit_rate (simulated on random words)."""
    rng = np.random.default_rng(seed)
    found = 0
    for _ in range(trials):
        item = mix(rng.integers(1, 1 << 62, item_words).astype(U64))
        edited = np.where(rng.random(item_words) < edit_rate, mix(rng.integers(1, 1 << 62, item_words).astype(U64)), item)
        for walk in range(WALKS):
            a, _, last, _ = _walk(item, walk, [np.ones(1 << _FILTER_BITS, bool)] * SAMPLED)
            b, _, _, _ = _walk(edited, walk, [np.ones(1 << _FILTER_BITS, bool)] * SAMPLED)
            read = last - np.arange(item_words) + 1
            if ((a == b) & (last < item_words) & (read >= WALK_READS)).any():
                found += 1
                break
    return found / trials
