"""Piece ids and decoded texts against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from placework.llm.piece_codes import PieceTable, code_digests, decode_pieces, encode_pieces
from placework.llm.queries import vocabulary

PARTS = [
    "a", "b", " ", "  ", "▁", "▁▁", "é", "é", "€", "🙂", "中", "文", "ß", " the", "ing", "\t", "\n", "0", "17",
    "\0", "        ", "</s>", "<0x0A>", "‍", " ", "ſ", "ா", "=-", "https://",
]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def table():
    return PieceTable(vocabulary("piece_bpe_32k.model"))


def hostile_texts():
    r = random.Random(1)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(0, 60))) for _ in range(3000)]
    texts += ["".join(r.choice("etaoinhrs") for _ in range(r.randrange(0, 200))) for _ in range(500)]
    ranges = [(1, 0x300), (1, 0xD7FF), (0xE000, 0x10FFFF)]
    texts += ["".join(chr(r.randrange(*r.choice(ranges))) for _ in range(30)) for _ in range(500)]
    return [*texts, "a" * 5000, " " * 5000, "ab" * 3000, "-" * 777, "▁" * 50]


def test_ids_are_those_of_the_library(model, table):
    texts = hostile_texts()
    got = [np.frombuffer(table.encode(t), "<i4").tolist() for t in texts]
    assert got == model.encode(texts, add_eos=True, num_threads=1)


def test_any_ids_decode_as_in_the_library(model, table):
    r = random.Random(2)
    pool = [28705, 259, 0, 1, 2]
    rows = [[r.choice([r.randrange(0, 259), r.randrange(0, 32000), r.choice(pool)]) for _ in range(r.randrange(0, 12))] for _ in range(5000)]
    data, offsets = table.decode(np.array([i for row in rows for i in row]), np.cumsum([0, *map(len, rows)]))
    got = [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
    assert got == [model.decode(row) for row in rows]


def test_every_row_of_a_table(spark, model):
    rows = [(1, "Some text. "), (1, "Some text. "), (2, None), (3, ""), (None, " x\ny"), (5, "long " * 50_000), (6, "▁a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(0)).withColumn("n_tokens", F.lit("x"))

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    expected = []
    for doc_id, text in rows:
        ids = model.encode(text or "", add_eos=True)
        expected.append((doc_id, len(ids), digest(" ".join(map(str, ids))), digest(model.decode(ids))))
    got = code_digests(docs, vocabulary("piece_bpe_32k.model")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert code_digests(docs.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


def test_round_trip_without_end_and_null_ids(spark):
    path = vocabulary("piece_bpe_32k.model")
    docs = spark.createDataFrame([("k", "two words"), ("n", "")], "doc_id string, text string")
    encoded = encode_pieces(docs, path, end=False)
    assert {r.doc_id: len(r.ids) for r in encoded.collect()}["n"] == 0
    missing = spark.createDataFrame([("z", None)], encoded.schema)
    assert {r.doc_id: r.text for r in decode_pieces(encoded.union(missing), path).collect()} == {"k": "two words", "n": "", "z": ""}


def test_other_kinds_of_model_are_refused(tmp_path):
    with pytest.raises(Exception):
        PieceTable(str(tmp_path / "none.model"))
