import zlib

import numpy as np
import pytest

from placework.llm import packing as P
from placework.llm.common import token_ids
from placework.llm.token_counts import count_tokens, tokenizer_version

TEXTS = [
    "The quick  brown\n\nfox's 42nd jump, don't they'll!!  ",
    "élan Über señor x   y　z",
    "<|endoftext|>a<|endoftext|>",
    "a <| b |> c",
    "😀 mixed ½ ² ٣ \x1c\x1d text\r\n\ttab",
    " lead", "trail ", "", "   ", "_under_score 'S 'll", "x" * 3000, "日本語テキスト", "1,000.50 A1B2 c3",
]


def library_ids(text, path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_library(vocabulary):
    got = [np.frombuffer(ids, "<u4").tolist() for ids in token_ids(TEXTS * 2, vocabulary)]
    assert got == [library_ids(t, vocabulary) for t in TEXTS] * 2


def test_counts_and_cache(spark, hard, empty, vocabulary, folder, monkeypatch):
    cache = folder("cache")
    rows = count_tokens(hard, cache, vocabulary).collect()
    texts = {r.doc_id: r.text or "" for r in hard.collect()}
    assert len(rows) == hard.count()
    for r in rows:
        n = len(library_ids(texts[r.doc_id], vocabulary))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
    stored = spark.read.parquet(cache)
    assert stored.count() == len(set(texts.values()))
    # Known contents are not encoded again: false counts under their digests are believed.
    version = tokenizer_version(vocabulary)
    other = folder("other")
    stored.withColumn("n_tokens", stored["n_tokens"] + 1_000_000).where("n_tokens > 0").write.parquet(other)
    more = hard.select("doc_id", "text").union(spark.createDataFrame([(77, "new text here")], "doc_id long, text string"))
    got = {r.doc_id: r.n_tokens for r in count_tokens(more, other, vocabulary).collect()}
    assert got[1] > 1_000_000 and got[77] == len(library_ids("new text here", vocabulary))
    assert spark.read.parquet(other).where("n_tokens < 1000000").count() >= 1
    # Another tokenizer's counts are not used.
    foreign = folder("foreign")
    stored.withColumn("tokenizer", stored["tokenizer"].substr(2, 9)).write.parquet(foreign)
    assert sorted(count_tokens(hard, foreign, vocabulary).collect(), key=str) == sorted(rows, key=str)
    assert version == stored.first()["tokenizer"]
    assert count_tokens(empty, folder("none"), vocabulary).collect() == []


def check_packing(rows, texts, path, size):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts.items():
        ids = [*library_ids(text or "", path), 0]
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return sequences


def test_packed_pieces(spark, hard, empty, vocabulary, monkeypatch):
    monkeypatch.setattr(P, "NUMBERED_TOGETHER", 2)
    docs = hard.select("doc_id", "text", "uid").where("doc_id <> 9").union(
        spark.createDataFrame([(100 + k, " ".join(["one"] * (k % 37)), 1) for k in range(200)], "doc_id long, text string, uid long")
    )
    rows = P.pack_documents(docs, vocabulary, size=64).collect()
    sequences = check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, vocabulary, 64)
    used = sum(r.length for r in rows)
    assert used / (64 * len(sequences)) > 0.97
    assert len(P.pack_documents(hard, vocabulary).where("doc_id = 9").collect()) == 2 * len(P.pack_documents(hard.where("doc_id = 9").limit(1), vocabulary).collect())
    assert P.pack_documents(empty, vocabulary).collect() == []
    ids = P.pack_documents(docs.limit(3), vocabulary, keep_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in ids)


@pytest.mark.parametrize("seed", range(5))
def test_patterns_place_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 129), 50, replace=False), rng.integers(1, 10_000, 50))}
    patterns = P.packing_patterns(counts, 128)
    assert all(number > 0 and sum(pattern) <= 128 for number, pattern in patterns)
    placed = {}
    for number, pattern in patterns:
        for length in pattern:
            placed[length] = placed.get(length, 0) + number
    assert placed == counts and len(patterns) <= 2 * 128
    ranges = {}
    for length, low, high, _, _ in P.pattern_places(patterns):
        assert ranges.get(length, 0) == low
        ranges[length] = high
    assert ranges == counts
