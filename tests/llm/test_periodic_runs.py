"""Runs of repeated words against their definition."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from placework.llm.periodic_runs import periodic_runs, run_digests, stitched, tiles_of, with_planted_period
from placework.llm.queries import table


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs_of(words):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            run = words[i : j + q]
            if len(run) >= max(12, 2 * q):
                if next(p for p in range(1, q + 1) if run[p:] == run[: len(run) - p]) == q:
                    out.append((i, len(run), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def hostile_rows():
    r = random.Random(5)
    rows = []
    for k in range(200):
        letters = "abcdefg"[: r.choice([1, 2, 3, 7])]
        if k % 5 == 0:
            words = [r.choice(letters) for _ in range(r.randrange(0, 150))]
        elif k % 5 == 1:
            unit = [r.choice(letters) for _ in range(r.randrange(1, 40))]
            words = unit * r.randrange(1, 9) + [r.choice(letters) for _ in range(r.randrange(0, 9))]
        elif k % 5 == 2:
            words = [str(r.randrange(300)) for _ in range(400)]
            s, p = r.randrange(200), r.randrange(1, 90)
            words = words[:s] + [words[s + (i - s) % p] for i in range(s, 400)]
        elif k % 5 == 3:
            words = []
            for _ in range(4):
                unit = [str(r.randrange(40)) for _ in range(r.randrange(1, 30))]
                words += (unit * 5)[: r.randrange(1, 5 * len(unit))]
        else:  # words of Fibonacci, which have most runs
            x, y = ["a"], ["a", "b"]
            for _ in range(r.randrange(3, 10)):
                x, y = y, y + x
            words = y[:200]
        rows.append((k, r.choice([" ", "\n", " \t"]).join(words)))
    return [*rows, (None, None), (None, "a " * 30), (7, ""), (7, ""), (8, " x y x " * 20), (9, " x y " * 12)]


@pytest.mark.parametrize("options", [(8, 8192, 16), (3, 16, 2), (3, 8, 1), (5, 64, 1)])
def test_runs_and_collapsed_text_for_any_size_of_tile(spark, options):
    rows = hostile_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("content", F.lit("x"))
    got = Counter((r.doc_id, tuple(tuple(x) for x in r.runs), r.collapsed) for r in periodic_runs(docs, *options).collect())
    expected = Counter()
    for doc_id, text in rows:
        words = words_of(text)
        runs = runs_of(words)
        expected[doc_id, tuple(runs), collapsed(words, runs)] += 1
    assert got == expected


def test_query_on_documents_with_planted_periods(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("length(text) < 3000").limit(150)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(10**6 + k, " ".join(str(i * i % 97) for i in range(k))) for k in range(1, 120)]
    expected = {}
    for doc_id, text in rows:
        words = words_of(text)
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_of(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, collapsed(words, runs))]
        expected[doc_id] = (len(runs), *head, *digests)
    data = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in run_digests(periodic_runs(with_planted_period(data))).collect()}
    assert got == expected and sum(v[0] > 0 for v in got.values()) > 10


def test_long_text_over_many_tiles(spark):
    words = [str(i % 1000) for i in range(20_000)] + [f"w{i}" for i in range(9_000)] + ["z"] * 10_000
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    row = periodic_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(0, 20_000, 1000), (29_000, 10_000, 1)]
    assert row.collapsed.split(" ") == words[:1000] + words[20_000:29_001]


def test_tiles_cover_every_octave():
    for n in (0, 11, 12, 511, 512, 8192, 8193, 50_000):
        tiles = tiles_of(n)
        octaves = {o for low, high, *_ in tiles for o in range(low, high + 1)}
        assert octaves == set(range(max(0, (n // 2).bit_length() - 1) + 1) if n >= 12 else ())
        for o in octaves:
            cores = sorted(t[2:4] for t in tiles if t[0] <= o <= t[1])
            assert cores[0][0] == 0 and cores[-1][1] == n and all(a[1] == b[0] for a, b in zip(cores, cores[1:]))


def test_intervals_stitch_by_document_and_period(spark):
    found = [(1, 4, 0, 10), (1, 4, 10, 20), (1, 4, 15, 18), (1, 8, 0, 16), (1, 5, 21, 30), (2, 4, 0, 10)]
    got = stitched(spark.createDataFrame(found, "doc_id long, period long, start long, stop long"), ["doc_id"]).collect()
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in got} == {1: [(0, 24, 4), (21, 14, 5)], 2: [(0, 14, 4)]}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert run_digests(periodic_runs(with_planted_period(docs))).count() == 0
