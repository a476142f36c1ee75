import random

from placework.llm import licenses as L
from placework.llm.decontamination import words_of
from placework.llm.license_texts import TEMPLATES


def test_winnowing_guarantee():
    r = random.Random(1)
    vocabulary = [f"v{k}" for k in range(500)]
    for _ in range(200):
        shared = [r.choice(vocabulary) for _ in range(L.GRAM + L.WINDOW - 1)]
        one, two = ([r.choice(vocabulary) for _ in range(20)] for _ in "ab")
        one[7:7], two[3:3] = shared, shared
        a, b = (set(L.fingerprints(words_of([" ".join(t)])[0])[0].tolist()) for t in (one, two))
        assert a & b


def matched(template, words):
    """Most words in common order (longest common subsequence)."""
    above = [0] * (len(words) + 1)
    for own in template:
        row = [0]
        for k, word in enumerate(words, 1):
            row.append(above[k - 1] + 1 if own == word else max(above[k], row[k - 1]))
        above = row
    return above[-1]


def test_every_template_is_found_with_its_span(spark):
    r = random.Random(2)
    rows, want = [], {}
    for k, (name, text) in enumerate(TEMPLATES.items()):
        filler = " ".join(f"z{r.randrange(99999)}" for _ in range(40))
        rows.append((k, f"{filler}. {text} {filler}", "own"))
        want[k] = (name, len(filler) + 2, len(filler) + 2 + len(text))
    docs = spark.createDataFrame(rows, "doc_id long, text string, template string").repartition(3)
    got = {(r.doc_id, r.template): r for r in L.license_matches(docs).collect()}
    assert len(got) == len(rows)
    for k, (name, start, end) in want.items():
        row = got[k, name]
        assert (row.start, row.end, row.coverage) == (start, end, 1.0)


def test_edited_texts(spark):
    index = L.Index(TEMPLATES)
    template = TEMPLATES["MIT-text"].split()
    r = random.Random(3)
    for _ in range(20):
        words = list(template)
        for _ in range(r.randint(0, 12)):
            k = r.randrange(len(words))
            words[k : k + r.choice([0, 1, 1])] = [f"n{r.randrange(999)}"] if r.random() < 0.7 else []
        (found,) = [m for m in L.scan(index, "before it " + " ".join(words) + " after it") if index.names[m[0]] == "MIT-text"]
        own, all_ = (words_of([t])[0].tolist() for t in (TEMPLATES["MIT-text"], " ".join(words)))
        assert matched(own, all_) - 2 <= found[1] <= matched(own, all_)


def test_hard_rows(spark, hard, empty):
    assert L.license_matches(hard).collect() == []
    assert L.license_matches(empty).collect() == []
    twice = spark.createDataFrame([(None, "All RIGHTS  reserved. x All rights reserved"), (2, "Licensed under CC BY-NC 4.0")], "doc_id long, text string")
    got = sorted((r.template, r.start, r.end) for r in L.license_matches(twice).collect())
    assert got == [("All-rights-reserved", 0, 21), ("All-rights-reserved", 24, 43), ("CC-BY-NC-notice", 0, 27)]


def test_copies_that_touch():
    index = L.Index(TEMPLATES)
    for name, text in TEMPLATES.items():
        own = words_of([text])[0]
        for copies in (2, 5):
            got = [m for m in L.scan(index, "before it " + " ".join([text] * copies) + " after it") if index.names[m[0]] == name]
            assert [m[2:] for m in got] == [(2 + k * len(own), 2 + (k + 1) * len(own)) for k in range(copies)]
    for before in ("", "all rights ", "rights reserved ", "reserved all "):
        for between in ("", "all ", "rights reserved "):
            text = before + between.join(["All rights reserved. "] * 4)
            assert len([m for m in L.scan(index, text) if index.names[m[0]] == "All-rights-reserved"]) == 4


def test_short_templates_with_a_replaced_word(spark):
    index = L.Index(TEMPLATES)
    rows = []
    for name, text in TEMPLATES.items():
        words = text.split()
        if len(words_of([text])[0]) != 5:
            continue
        for k in range(300):
            other = [*words[:2], f"n{k}", *words[3:]]
            rows.append((len(rows), f"z{k} " + " ".join(other) + f" y{k}"))
            assert any(m[1] == 4 for m in L.scan(index, rows[-1][1])), rows[-1]
    assert len(rows) >= 600
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in L.license_matches(docs).collect()} == {k for k, _ in rows}


def plain_matches(template, words):
    """Matches of a template in words: best local alignments over the whole text, one after the other."""
    words, out = list(words), []
    while True:
        above, best = [(0, 0, -1, -1)] * (len(words) + 1), (0, 0, -1, -1)
        for own in template:
            row = [(0, 0, -1, -1)]
            for j, word in enumerate(words):
                score, matched, first, end = above[j]
                cell = (0, 0, -1, -1)
                if own == word:
                    cell = (score + 2, matched + 1, j if first < 0 else first, j + 1)
                elif score > 1:
                    cell = (score - 1, matched, first, end)
                for other in (above[j + 1], row[j]):
                    if other[0] - 1 > cell[0]:
                        cell = (other[0] - 1, *other[1:])
                row.append(cell)
                best = max(best, cell)
            above = row
        _, matched, first, end = best
        if not matched or matched < L.COVERAGE * len(template):
            return out
        out.append((matched, first, end))
        words[first:end] = [None] * (end - first)


def test_matches_of_documents_are_those_of_whole_alignments(spark):
    r = random.Random(6)
    chosen = {n: TEMPLATES[n] for n in ("MIT-notice", "GPL-header", "LGPL-header", "MPL-2.0-header", "CC-text", "CC0-notice", "BSD-conditions", "All-rights-reserved")}
    rows = []
    for k in range(120):
        words = [f"z{r.randrange(60)}" for _ in range(r.randrange(0, 60))]
        for name in r.sample(list(chosen), r.randrange(0, 3)):
            own = chosen[name].split()
            for _ in range(r.choice([0, 0, 1, 2, len(own) // 8])):
                at = r.randrange(len(own))
                own[at : at + r.choice([0, 1, 1])] = [f"n{r.randrange(999)}"] if r.random() < 0.7 else []
            words += own + [f"z{r.randrange(60)}" for _ in range(r.choice([0, 3, 40]))]
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for m in L.license_matches(docs, chosen).collect():
        got.setdefault(m.doc_id, set()).add((m.template, m.matched_words))
    hashes = {n: words_of([t])[0].tolist() for n, t in chosen.items()}
    for k, text in rows:
        words = words_of([text])[0].tolist()
        found = [(m, a, b, i, n) for i, n in enumerate(chosen) for m, a, b in plain_matches(hashes[n], words)]
        found.sort(key=lambda f: (-f[0], f[1], f[3]))
        kept = []
        for m, a, b, i, n in found:
            if not any(c <= a and b <= d for _, c, d, _, _ in kept):
                kept.append((m, a, b, i, n))
        assert got.get(k, set()) == {(n, m) for m, _, _, _, n in kept}, text
