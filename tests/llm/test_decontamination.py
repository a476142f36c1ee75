import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placework.llm import decontamination as C


def distance(item, words):
    """Least edit distance of an item to any run of words, by the plain table."""
    above = list(range(len(item) + 1))
    best = above[-1]
    for word in words:
        row = [0]
        for k, own in enumerate(item, 1):
            row.append(min(above[k] + 1, row[k - 1] + 1, above[k - 1] + (own != word)))
        above = row
        best = min(best, row[-1])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=70), st.lists(st.integers(0, 4), max_size=90))
def test_bit_vectors_give_the_edit_distance(item, words):
    assert C.least_distance(item, words)[0] == distance(item, words)


def edited(r, words, vocabulary, edits):
    words = list(words)
    for _ in range(edits):
        k = r.randrange(len(words))
        kind = r.choice("rid")
        if kind == "r":
            words[k] = r.choice(vocabulary)
        elif kind == "i":
            words.insert(k, r.choice(vocabulary))
        elif len(words) > 1:
            del words[k]
    return words


@pytest.fixture(scope="module")
def case():
    r = random.Random(8)
    vocabulary = [f"word{k}" for k in range(900)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 7, 9, 12, 16, 20, 30, 45])))) for k in range(40)]
    items += [(40, None), (41, ""), (42, "?!"), (None, "an item without an id of its own")]
    docs = []
    for k in range(160):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 200))]
        if k % 2:
            own = (r.choice(items[:40])[1]).split()
            at = r.randint(0, len(words))
            words[at:at] = edited(r, own, vocabulary, r.randint(0, max(1, len(own) // 6)))
        docs.append((k, r.choice([" ", "\n", ", "]).join(words).upper() if k % 5 == 0 else " ".join(words)))
    return docs + [(None, items[9][1] + "!!"), (200, None), (201, ""), (202, "word1 " * 20_000)], items


def test_finds_what_brute_force_finds(spark, case):
    docs, items = case
    words = lambda text: ["".join(c for c in w if c.isalnum() or ord(c) > 127) for w in (text or "").lower().split()]
    want = {}
    for doc_id, text in docs:
        for item_id, item in items:
            item = [w for w in words(item) if w]
            if item:
                d = distance(item, [w for w in words(text) if w])
                if d <= int(C.DISTANCE_SHARE * len(item)):
                    want[doc_id, item_id] = d
    frames = spark.createDataFrame([(*d, "own") for d in docs], "doc_id long, text string, item_id string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in C.benchmark_matches(*frames).collect()}
    assert set(got) <= set(want)
    assert len(set(want) - set(got)) <= 0.02 * len(want)
    assert all(got[k] == want[k] for k in got)
    clean = C.drop_contaminated(*frames)
    assert clean.columns == frames[0].columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_blocks_of_items_give_the_same(spark, case, monkeypatch):
    docs, items = case
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    one = sorted(C.benchmark_matches(*frames).collect(), key=str)
    monkeypatch.setattr(C, "BLOCK_BYTES", 800)
    assert sorted(C.benchmark_matches(*frames).collect(), key=str) == one
    assert C.drop_contaminated(*frames).count() == len(docs) - len({r.doc_id for r in one})


def test_target_recall():
    assert C.expected_recall(16, 0.1, 300) > 0.98
    assert C.expected_recall(40, 0.2, 300) > 0.99


def test_hard_rows(spark, hard, empty):
    items = spark.createDataFrame([(1, "two three four five six")], "item_id long, text string")
    assert sorted(r.doc_id for r in C.benchmark_matches(hard, items).collect()) == [1, 2]
    assert C.benchmark_matches(hard, items.limit(0)).collect() == []
    assert C.benchmark_matches(empty, items).collect() == []
    assert C.drop_contaminated(hard, items).count() == hard.count() - 2
    assert C.drop_contaminated(hard, items.limit(0)).count() == hard.count()
