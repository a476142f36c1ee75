"""SentencePiece encoding and decoding by a table of last pieces.

The model merges, again and again, the two neighbouring pieces whose union has the best score (of equal ones the
leftmost), until no union is in the vocabulary. For such a rule a sequence of pieces is the encoding of its text exactly
if each two neighbours are the encoding of theirs: inside a pair the merges happen in the same order as in the whole
text, so the first merge that would cross a border crosses it in the pair alone as well. Therefore each prefix of a
text has one last piece: the piece that ends there and is compatible with the last piece of the prefix before it. An
automaton over the vocabulary gives the pieces that end at each character, a pair test (kept per pair) selects one, and
the ids are read from the end of the table backwards. Time is linear in the text.

No piece crosses a character that is in no longer piece, nor, where no piece of the vocabulary has a space after another
character, into the next word; the words of a text are then tables of their own, and each process keeps the ids of
short words it has seen.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, text_of

SPACE = "▁"
# Words of up to this many characters are kept, up to this many of them; others are encoded each time.
KEPT_LENGTH = 48
KEPT_WORDS = 400_000
KEPT_PAIRS = 1_000_000
# In the table a character that is no piece of its own has its code point from here on; START stands before a text.
UNKNOWN = 1 << 21
START = 1 << 22


class PieceTable:
    """The pieces of a byte-fallback merge model that only writes spaces as `▁` and puts one in front of a text."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        # NFKC forms, trimmed or doubled spaces would show here.
        if model.normalize(" ﬁ½  a ") != "▁▁ﬁ½▁▁a▁":
            raise ValueError("the model changes texts before it encodes them; only spaces may be rewritten")
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        if any(model.is_unused(i) for i in range(size)) or sum(model.is_byte(i) for i in range(size)) != 256:
            raise ValueError("the model has unused pieces or no byte pieces")
        self.end = model.eos_id()
        self.ids = {name: i for i, name in enumerate(names) if not special[i]}
        self.score = {name: model.get_score(i) for name, i in self.ids.items()}
        self.names = names
        self.bytes_of = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.ends = ahocorasick.Automaton()
        for name, i in self.ids.items():
            self.ends.add_word(name, (i, len(name)))
        self.ends.make_automaton()
        apart = not any(a != SPACE and b == SPACE for name in self.ids for a, b in zip(name, name[1:]))
        # A character that is in no longer piece never merges, so it is a part of its own (line ends, digits, ...).
        inside = {c for name in self.ids if len(name) > 1 for c in name} - {SPACE}
        merging = "".join(map(re.escape, sorted(inside)))
        self.words = re.compile(f"{SPACE}*[{merging}]+|{SPACE}+|(?s:.)" if apart else f"[{SPACE}{merging}]+|(?s:.)")
        self.pairs: dict[int, bool] = {}
        self.memo = _Words(self)
        # For decoding: the bytes of each piece, in one buffer.
        own = [b"" if model.is_control(i) else names[i].replace(SPACE, " ").encode() for i in range(size)]
        for b, i in enumerate(self.bytes_of):
            own[i] = bytes([b])
        own[model.unk_id()] = " ⁇ ".encode()
        self.length = np.array([len(b) for b in own], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.buffer = np.frombuffer(b"".join(own), np.uint8)
        self.is_byte = np.isin(np.arange(size), self.bytes_of)
        self.is_control = np.array([model.is_control(i) for i in range(size)])
        self.opens = np.array([not s and n.startswith(SPACE) for s, n in zip(special, names)])

    # -------------------------------------------------------------------------------------------- encoding

    def _name(self, piece: int) -> str:
        return self.names[piece] if piece < UNKNOWN else chr(piece - UNKNOWN)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the characters of two pieces anew makes these two; for START, whether it makes the right one."""
        head, tail = "" if left == START else self._name(left), self._name(right)
        known = self._merged(head + tail, len(head))
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[left << 24 | right] = known
        return known

    def encode_word(self, word: str) -> bytes:
        """The ids of a part of a text that no piece crosses, as 32-bit little-endian numbers."""
        # Of each prefix: its last piece, and where that piece starts.
        last, before, pairs = [START], [0], self.pairs.get
        have = 1
        for end, (piece, length) in self.ends.iter(word):
            if end + 1 < have:
                continue
            while have <= end:  # characters at which no piece ends
                last.append(UNKNOWN + ord(word[have - 1]))
                before.append(have - 1)
                have += 1
            at = have - length
            left = last[at]
            fits = pairs(left << 24 | piece)
            if fits is None:
                fits = self.compatible(left, piece)
            if fits:
                last.append(piece)
                before.append(at)
                have += 1
        for k in range(have, len(word) + 1):
            last.append(UNKNOWN + ord(word[k - 1]))
            before.append(k - 1)
        found, at = [], len(word)
        while at:
            piece = last[at]
            if piece < UNKNOWN:
                found.append(piece)
            else:
                found.extend(self.bytes_of[b] for b in reversed(word[at - 1].encode()))
            at = before[at]
        found.reverse()
        return array("i", found).tobytes()

    def _merged(self, text: str, border: int) -> bool:
        """Whether the merges of a text end in the parts before and after the border (0: in one part)."""
        cuts = list(range(len(text) + 1))
        while True:
            best, at = None, 0
            for k in range(len(cuts) - 2):
                score = self.score.get(text[cuts[k] : cuts[k + 2]])
                if score is not None and (best is None or score > best):
                    best, at = score, k + 1
            if best is None:
                return cuts[1:] == ([border, len(text)] if border else [len(text)])
            if cuts[at] == border:
                return False
            del cuts[at]

    def encode(self, text: str, end: bool = True) -> bytes:
        memo = self.memo
        body = [memo[w] for w in self.words.findall(SPACE + text.replace(" ", SPACE))] if text else []
        if end:
            body.append(np.int32(self.end).tobytes())
        return b"".join(body)

    # -------------------------------------------------------------------------------------------- decoding

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts of rows of ids, and the offset of each row in them.

        The space in front of a text goes; bytes that are no character become the replacement character.
        """
        start, length = self.start[ids], self.length[ids]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        seen = np.flatnonzero(~self.is_control[ids])
        first = seen[np.concatenate([[True], row[seen][1:] != row[seen][:-1]])] if len(seen) else seen
        first = first[self.opens[ids[first]]]
        start[first] += 1
        length[first] -= 1
        ends = np.concatenate([[0], np.cumsum(length)])
        data = self.buffer[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])]
        text_offsets = ends[offsets]
        # A control piece between two byte pieces parts their characters too; one at the end of a row is harmless.
        inner = self.is_control[ids] & (np.arange(len(ids)) + 1 < offsets[1:][row])
        parted = set(row[inner].tolist())
        doubtful = np.unique(row[self.is_byte[ids]]).tolist()
        broken = [r for r in doubtful if r in parted or not _is_text(data[text_offsets[r] : text_offsets[r + 1]].tobytes())]
        if broken:
            parts = [data[a:b].tobytes() for a, b in zip(text_offsets[:-1], text_offsets[1:])]
            for r in broken:
                mine = slice(offsets[r], offsets[r + 1])
                runs = zip(ids[mine], start[mine], length[mine])
                parts[r] = _repaired([(self.is_byte[i], self.buffer[s : s + n].tobytes()) for i, s, n in runs])
            data = np.frombuffer(b"".join(parts), np.uint8)
            text_offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return data, text_offsets


class _Words(dict):
    """The ids of short words; when there are too many, those not seen since the last time go."""

    def __init__(self, table: PieceTable):
        self.table, self.old = table, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.table.encode_word(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


def _is_text(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def _repaired(parts: list[tuple[bool, bytes]]) -> bytes:
    """Pieces put together; in each run of byte pieces a byte that starts no whole character is replaced by itself."""
    out, run = [], b""
    for is_byte, data in [*parts, (False, b"")]:
        if is_byte:
            run += data
            continue
        while run:
            size = next((n for n in (1, 2, 3, 4) if n <= len(run) and _is_text(run[:n])), 0)
            out.append(run[:size] if size else "�".encode())
            run = run[size or 1 :]
        out.append(data)
    return b"".join(out)


def _table(path: str) -> PieceTable:
    """Kept in the process: tasks that come with a copy of this module share it."""
    kept = sys.__dict__.setdefault("_placework_pieces", {})
    if path not in kept:
        kept[path] = PieceTable(path)
    return kept[path]


def encode_pieces(docs: DataFrame, model: str, end: bool = True) -> DataFrame:
    """doc_id and the ids of the whole text of every row of docs, with the end id when `end` is set.

    model: path of a sentencepiece file that every executor has (merges with byte fallback, no change of the text but
    spaces; others raise ValueError). Null and empty texts have the end id only. Rows are independent: repeated rows
    and null ids each get their row, an empty table gives an empty result, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                rows = [table.encode(t, end) for t in texts]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(rows), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])
        # The worker process goes on with other work, so half of what it remembers goes.
        table.memo.old = {}

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """The rows of encoded (doc_id, ids) with their text; no ids and null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        for batch in batches:
            ids = batch.column(1)
            # Rows in parts of a bounded number of ids.
            ends = np.cumsum([0, *ids.value_lengths().fill_null(0).to_pylist()])
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 20), "right")) - 1)
                part = batch.slice(at, to - at)
                data, offsets = table.decode(part.column(1).flatten().to_numpy(zero_copy_only=False), ends[at : to + 1] - ends[at])
                text = pa.StringArray.from_buffers(to - at, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text], names=["doc_id", "ids", "text"])
                at = to

    schema = T.StructType([*encoded.select("doc_id", "ids").schema, T.StructField("text", T.StringType())])
    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def code_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: its ids with the end id, and their text."""
    rows = decode_pieces(encode_pieces(docs, model), model)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
