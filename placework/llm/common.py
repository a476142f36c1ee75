"""What several operators of this folder share: word hashes, links to classes, kept rows, token ids.

Words are runs of characters other than ASCII white space. All hashes are 64 bits wide and the same in every
task, session and machine.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placework.session import work_folder, written

U64 = np.uint64
# Bytes of text that are worked on at once where the arrays made of them are many times larger.
SMALL_PIECE = 1 << 20


def stored_part(df: DataFrame, folder: str, part: int) -> DataFrame:
    """The same rows, stored as a part of the table in folder."""
    df.write.parquet(f"{folder}/part={part}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/part={part}")


def stored_parts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The columns of the schema of all parts that the table in folder has by now, as one scan."""
    return spark.read.schema(schema).parquet(folder).drop("part")


def text_of(column: str = "text"):
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def digest_of(column: str = "text"):
    return F.sha2(text_of(column), 256)


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


# ------------------------------------------------------------------------------------------------ hashes


def mix(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value of each value (the finaliser of splitmix64)."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed random 64-bit values of a seed."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15))


_BYTE = seeded(1, 256)
_STEP = seeded(2, 1 << 12) | U64(1)
_SHINGLE = seeded(3, 64) | U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[bytes], dropped: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of UTF-8 texts in order, and the offset of each text in them (one more than texts).

    `dropped` marks bytes that count as absent; a word that has only such bytes is none.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    text_starts = np.concatenate([[0], ends]).astype(np.int64)
    if dropped is not None:
        keep = ~dropped[data]
        moved = np.concatenate([[0], np.cumsum(keep)])
        data, text_starts = data[keep], moved[text_starts]
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(data) else np.zeros(0, np.int64)
    offsets = np.searchsorted(starts, text_starts)
    if not len(starts):
        return np.zeros(0, U64), offsets
    letters = np.flatnonzero(~space)
    lengths = np.diff(np.searchsorted(letters, np.append(starts, len(data))))
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    # Beyond 4,096 bytes a word's steps repeat with another factor, so that order still counts.
    factor = _STEP[place & 0xFFF]
    far = np.flatnonzero(place > 0xFFF)
    factor[far] = (factor[far] * mix(place[far] >> 12)) | U64(1)
    return mix(np.add.reduceat(_BYTE[data[letters]] * factor, first) + lengths.astype(U64)), offsets


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside each text, and the text of each; a shorter text is one run."""
    counts = np.diff(offsets)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), runs)
    start = offsets[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    length = np.minimum(counts, size)[owner]
    total = np.zeros(len(owner), U64)
    padded = np.concatenate([words, np.zeros(size, U64)])
    for k in range(size):
        total += np.where(k < length, padded[start + k] * _SHINGLE[k], U64(0))
    return mix(total), owner


def counted_shingles(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hash, number of times, index of the text. Sorted by text, then hash."""
    shingles, owner = shingle_hashes(*word_hashes(texts), size)
    if not len(shingles):
        return shingles, np.zeros(0, np.int64), owner
    order = np.lexsort((shingles, owner)) if len(texts) > 1 else np.argsort(shingles)
    shingles, owner = shingles[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])]))
    return shingles[new], np.diff(np.append(new, len(shingles))), owner[new]


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch with up to `most` bytes in a column (a longer value is a part of its own), and its values."""
    column_at = batch.schema.get_field_index(column)
    start, size, values = 0, 0, []
    for row in range(batch.num_rows):
        value = batch.column(column_at)[row].as_py()
        length = len(value) if value is not None else 0
        if values and size + length > most:
            yield batch.slice(start, row - start), values
            start, size, values = row, 0, []
        values.append(value)
        size += length
    if values:
        yield batch.slice(start), values


# ------------------------------------------------------------------------------------------------ classes


# Links that one task handles in a round.
LINKS_PER_TASK = 500_000


def link_classes(links: DataFrame, purpose: str) -> DataFrame:
    """Links (a, b) between whole numbers -> (id, root): the smallest id that is reached from each linked id.

    Large-star and small-star rounds (Kiveris et al., 2014) until nothing changes. Each round is a written table;
    only a count and a checksum of it reach the driver, and the count sets the number of tasks.
    """

    def stored(df, rows):
        return written(df.coalesce(max(1, -(-2 * rows // LINKS_PER_TASK))), purpose)

    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(links, links.count())
    now = state(edges)
    while now[0]:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), now[0])
        # Now a > b in every row: small-star moves the lesser neighbours and the node itself to their least one.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).where("a <> b")
        edges = stored(small.distinct(), now[0])
        before, now = now, state(edges)
        if before == now:
            break
    roots = edges.select(F.col("b").alias("id")).distinct()
    out = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return out.union(roots.select("id", F.col("id").alias("root")))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs named by kept (doc_id, digest of the text), one row for each, with the columns of docs.

    Of rows that are equal in both, one stays.
    """
    kept = kept.select(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_kept_digest"))
    rows = docs.withColumn("_digest", digest_of())
    same = rows["doc_id"].eqNullSafe(kept["_kept_id"]) & (rows["_digest"] == kept["_kept_digest"])
    rank = F.row_number().over(Window.partitionBy("_kept_digest", "_kept_id").orderBy("_kept_digest"))
    return rows.join(kept, same).withColumn("_rank", rank).where("_rank = 1").select(*[docs[c] for c in docs.columns])


# ------------------------------------------------------------------------------------------------ tokens

# The word split of the byte-level vocabularies (fixed value), in the form of the standard library: the same on texts
# of the characters below, which are the only ones it is used for.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ſ]*")
# Words kept since the last time that there were so many, and those kept then; longer words are encoded each time.
_MEMO_WORDS, _MEMO_LENGTH = 400_000, 48


def _tokenizer(path: str):
    """The tokenizer and the ids of words seen, kept in the process: tasks that come with a copy of this module share it."""
    kept = sys.__dict__.setdefault("_placework_tokenizers", {})
    if path not in kept:
        # Tasks are the parallel units; threads of the library would only wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        kept[path] = (Tokenizer.from_file(path), {}, {})
    return kept[path]


def release_words(path: str) -> None:
    """At the end of a task: the worker process goes on with other work, and words take much of its memory."""
    for kept in _tokenizer(path)[1:]:
        kept.clear()


def token_ids(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as unsigned 32-bit little-endian numbers, as `tokenizers` gives them without added tokens.

    A byte-level vocabulary encodes the words of its split one by one, so each process keeps the ids of words it has
    seen and encodes only new ones, those of all texts together. Texts with characters for which the split was not
    checked, and those that may hold a special string, are encoded whole.
    """
    tokenizer, memo, old = _tokenizer(path)
    words, out, missing = [], [], set()
    for text in texts:
        plain = "<|" not in text and _PLAIN.fullmatch(text) is not None
        mine = _SPLIT.findall(text) if plain else None
        words.append(mine)
        if mine is None:
            out.append(array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
            continue
        ids = list(map(memo.get, mine))
        if None in ids:
            missing.update([word for word, own in zip(mine, ids) if own is None])
            out.append(None)
        else:
            out.append(b"".join(ids))
    new, long_ones = [], {}
    for word in missing:
        ids = old.get(word)
        if ids is None:
            new.append(word)
        else:
            memo[word] = ids
    for word, encoded in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False)):
        (memo if len(word) <= _MEMO_LENGTH else long_ones)[word] = array("I", encoded.ids).tobytes()
    have = memo.__getitem__ if not long_ones else lambda w: memo[w] if w in memo else long_ones[w]
    for k, ids in enumerate(out):
        if ids is None:
            out[k] = b"".join(map(have, words[k]))
    if len(memo) > _MEMO_WORDS:
        old.clear()
        old.update(memo)
        memo.clear()
    return out


__all__ = ["work_folder", "written"]
