"""Licence texts in documents: winnowed fingerprints, an inverted index, banded alignment.

Texts are sequences of words (lower case, without ASCII punctuation). Runs of GRAM words are hashed; of each WINDOW
neighbouring hashes the least is a fingerprint (Schleimer, Wilkerson and Aiken, 2003), so any GRAM + WINDOW - 1 words
that two texts share give a common one. For templates of fewer than SHORT words all runs of a document are taken. The
inverted index leads from a fingerprint to templates and places. Hits of a template on neighbouring diagonals of a
document name a candidate, which is aligned in a band around them: matches count 2, replaced, added and missing words -1.
All matches of a candidate that do not overlap and cover enough of the template are reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, pieces
from .decontamination import _grams, words_of
from .license_texts import TEMPLATES

GRAM, WINDOW = 2, 2
COVERAGE = 0.8
# Words by which a match may shift: at least, and as a share of the template.
BAND_WORDS, BAND_SHARE = 3, 0.1
# Share of a template's fingerprints that a candidate has. A match of the coverage above whose other words are replaced has
# more: with fewer than SHORT words it may consist of runs of GRAM words, of which winnowing can drop each.
HITS, SHORT = 0.15, 10

_FILTER_BITS = 20
_MASK = U64((1 << _FILTER_BITS) - 1)
_RUN = re.compile(r"[^\t\n\v\f\r ]+")
_WORD = re.compile(r"[^!-/:-@\[-`{-~]")
SCHEMA = "doc_id long, template string, coverage double, matched_words int, template_words int, start long, end long"


def fingerprints(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed hashes of runs of words and their places; of equal hashes in a window the last is taken."""
    grams = _grams(words, min(GRAM, max(len(words), 1)))
    if len(grams) <= WINDOW:
        return grams, np.arange(len(grams))
    windows = np.lib.stride_tricks.sliding_window_view(grams[::-1], WINDOW)
    places = len(grams) - 1 - np.unique(np.arange(len(windows)) + windows.argmin(axis=1))
    places = places[::-1]
    return grams[places], places


class Index:
    """Inverted index of the templates' fingerprints. The templates are a parameter of bounded size."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = list(templates)
        words, offsets = words_of(list(templates.values()))
        self.words = [words[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
        keys, owner, place, self.prints = [], [], [], []
        for number, own in enumerate(self.words):
            # All runs of a template are indexed: a document's choice then meets one of them wherever it falls.
            grams = _grams(np.array(own, U64), min(GRAM, max(len(own), 1)))
            keys.append(grams)
            owner.append(np.full(len(grams), number))
            place.append(np.arange(len(grams)))
            self.prints.append(len(grams))
        keys = np.concatenate([*keys, np.zeros(0, U64)])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.owner = np.concatenate([*owner, np.zeros(0, np.int64)])[order].astype(np.int64)
        self.place = np.concatenate([*place, np.zeros(0, np.int64)])[order].astype(np.int64)
        self.short = np.array([len(own) < SHORT for own in self.words], bool)[self.owner]
        # Filters of the longer and of the short templates' runs.
        self.filters = np.zeros((2, 1 << _FILTER_BITS), bool)
        self.filters[self.short.astype(int), (self.keys & _MASK).astype(np.int64)] = True

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of runs of words that may be a template's, their places, and whether winnowing keeps them."""
        grams = _grams(words, min(GRAM, max(len(words), 1)))
        winnowed = np.zeros(len(grams), bool)
        winnowed[fingerprints(words)[1]] = True
        slots = (grams & _MASK).astype(np.int64)
        places = np.flatnonzero((winnowed & self.filters[0][slots]) | self.filters[1][slots])
        return grams[places], places, winnowed[places]

    def hits(self, words: np.ndarray) -> np.ndarray:
        """Rows (template, diagonal, place in the document) by template and diagonal."""
        prints, places, winnowed = self.near(words)
        low, high = np.searchsorted(self.keys, prints, "left"), np.searchsorted(self.keys, prints, "right")
        source = np.repeat(np.arange(len(prints)), high - low)
        entry = low[source] + np.arange(len(source)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        taken = winnowed[source] | self.short[entry]
        source, entry = source[taken], entry[taken]
        rows = np.stack([self.owner[entry], places[source] - self.place[entry], places[source]], axis=1)
        return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]


def align(template: list[int], words: list[int], band: int) -> tuple[int, int, int]:
    """Best local alignment of a template with words, at most `band` off the diagonal on either side.

    The words begin `band` places before the template's expected first word. Returns the number of matched words, and
    the first and the last matched place (end exclusive).
    """
    width = 2 * band + 1
    none = (0, 0, -1, -1)  # score, matched, first, end
    above, best = [none] * (width + 1), none
    for i, word in enumerate(template):
        row: list[tuple[int, int, int, int]] = []
        left = none
        for d in range(width):
            j = i + d
            cell = none
            if j < len(words):
                score, matched, first, end = above[d]
                if words[j] == word:
                    cell = (score + 2, matched + 1, j if first < 0 else first, j + 1)
                elif score > 1:
                    cell = (score - 1, matched, first, end)
            # A word of the template that is missing, or one of the document that is added.
            for other in (above[d + 1], left):
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, *other[1:])
            row.append(cell)
            left = cell
            if cell > best:
                best = cell
        above = [*row, none]
    return best[1], best[2], best[3]


def scan(index: Index, text: str | None, coverage: float = COVERAGE) -> list[tuple[int, int, int, int]]:
    """Template, matched words, first and end word of each match in a text; a match inside a larger one is left out."""
    words, _ = words_of([text])
    hits = index.hits(words)
    found, k = [], 0
    while k < len(hits):
        template, low = int(hits[k, 0]), int(hits[k, 1])
        size = len(index.words[template])
        # Copies that touch are as many diagonals apart as the template has words.
        band = min(max(BAND_WORDS, int(BAND_SHARE * size)), size - 1)
        stop = k + 1
        while stop < len(hits) and hits[stop, 0] == template and hits[stop, 1] <= low + band:
            stop += 1
        high, seen = int(hits[stop - 1, 1]), stop - k
        k = stop
        if seen < HITS * index.prints[template]:
            continue
        wide = band + high - low
        begin = low - wide
        run = words[max(begin, 0) : high + size + wide].tolist()
        # Places before the text are words that equal none.
        run = [-1] * max(-begin, 0) + run
        while True:
            matched, first, end = align(index.words[template], run, wide)
            if not matched or matched < coverage * size:
                break
            found.append((template, matched, first + begin, end + begin))
            # What was found equals no word any more.
            run[first:end] = [-1] * (end - first)
    found.sort(key=lambda m: (-m[1], m[2], m[0]))
    kept: list[tuple[int, int, int, int]] = []
    for match in found:
        if not any(other[2] <= match[2] and match[3] <= other[3] for other in kept):
            kept.append(match)
    return sorted(kept, key=lambda m: (m[2], m[0]))


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each word in code points."""
    return [m.span() for m in _RUN.finditer(text) if _WORD.search(m.group())]


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, template, coverage, matched_words, template_words, start, end of each match in every row of docs.

    start and end are code points of the text (end exclusive). Null and empty texts have no match; repeated rows get
    theirs each; of templates that match the same words the one with more matched words is reported (then the one that
    begins earlier, then the one listed first). An empty table gives an empty result. Other columns are ignored. Templates without words match nothing.
    """
    index = Index(templates or TEMPLATES)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                ids, rows = part.column(part.schema.get_field_index("doc_id")).to_pylist(), []
                words, offsets = words_of(texts)
                # Only texts that share a fingerprint with a template are looked at one by one.
                near = index.near(words)[1]
                named = np.searchsorted(offsets, near, "right") - 1
                # A text as short as a window has no window of its own among the others' words.
                short = np.flatnonzero(np.diff(offsets) < GRAM + WINDOW)
                for number in np.union1d(named, short).astype(int).tolist():
                    matches = scan(index, texts[number], coverage)
                    spans = word_spans(texts[number]) if matches else []
                    for template, matched, first, end in matches:
                        size = len(index.words[template])
                        rows.append((ids[number], index.names[template], matched / size, matched, size, spans[first][0], spans[end - 1][1]))
                columns = list(zip(*rows)) or [()] * 7
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(search, SCHEMA)

