import collections
import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from placework.llm.repeated_spans import remove_repeats, repeated_windows, window_runs
from placework.llm.suffix_array import common_prefixes, suffix_array


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array_and_prefixes(values):
    s = [*values, 0]
    order = sorted(range(len(s)), key=lambda i: s[i:])
    sa = suffix_array(np.array(s))
    assert sa.tolist() == order
    prefix, before = common_prefixes(np.array(s), sa)
    for a, b in zip(order, order[1:]):
        length = 0
        while max(a, b) + length < len(s) and s[a + length] == s[b + length]:
            length += 1
        assert (prefix[b], before[b]) == (length, a)


def test_runs_cover_all_windows_and_follow_the_bytes():
    r = random.Random(2)
    data = bytes(r.choice(b"abc ") for _ in range(500)) + b"ab" * 200
    starts, counts, grams = window_runs(data, 40, 8)
    assert starts.tolist() == [0, *np.cumsum(counts)[:-1].tolist()] and counts.sum() == len(data) - 39
    by_window = {}
    for start, count, gram in zip(starts, counts, grams):
        for k in range(start, start + count):
            assert by_window.setdefault(data[k : k + 40], gram) == gram


def brute(rows, size):
    data = [(text or "").encode() for _, text in rows]
    seen = collections.Counter(d[k : k + size] for d in data for k in range(len(d) - size + 1))
    out = []
    for (doc_id, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - size + 1):
            if seen[d[k : k + size]] > 1:
                gone[k : k + size] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])
        out.append((doc_id, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts():
    r = random.Random(5)
    base = "".join(r.choice("abcd é") for _ in range(300))
    make = [
        lambda: base[r.randint(0, 100) :][: r.randint(0, 200)],
        lambda: "ab " * r.randint(0, 60) + str(r.random()),
        lambda: "".join(r.choice("xyz") for _ in range(r.randint(0, 60))) + base[(a := r.randint(0, 200)) : a + 60] + "".join(r.choice("uvw") for _ in range(40)),
        lambda: r.choice([None, "", "z" * r.randint(0, 100)]),
        lambda: "".join(r.choice("abcdefghij ") for _ in range(r.randint(0, 200))),
    ]
    rows = [(k if k % 9 else None, r.choice(make)()) for k in range(120)]
    return rows + rows[:5]


def test_same_as_brute_force_with_and_without_crowded_grams(spark):
    rows = texts()
    docs = spark.createDataFrame([(*row, "own", 1) for row in rows], "doc_id long, text string, packed string, uid long").repartition(4)
    for many in (1500, 3):
        assert sorted([tuple(r) for r in remove_repeats(docs, 40, 8, many).collect()], key=str) == brute(rows, 40)
    assert remove_repeats(docs.limit(0)).collect() == []


def test_windows_of_a_shard():
    assert [w.tolist() for w in repeated_windows([b"abcabc", b"bcab", b"x", b""], 3)] == [[0, 1, 2, 3], [0, 1], [], []]


def test_production_size(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage = word(450)
    rows = [(1, word(900)), (2, word(300) + passage + word(10)), (3, word(20) + passage + word(500)), (4, passage[:399]), (5, word(399) * 3), (6, "y" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(r) for r in remove_repeats(docs).collect()], key=str) == brute(rows, 400)
