import hashlib
import re

import pytest

from placework.llm import personal_data as P

# The base kinds as they are given.
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "a@b.c_d@e.f g@h a.b@c..d e@f.g.h@i.j @x.y x@.y",
    "x" * 60_000,
    "1" * 40_000,
    "9 " * 30_000,
    "+1" + "(" * 4000,
    "😀 é 1.2.3.4.5.6.7.8 and 300.1.1.1 0001.2.3.4 1.2.3",
    None,
    "",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111",
    "+1 (524) 555-7373. +12 345 678 9012@a.b +1 2 +123456789012345678",
    'token = "e7fbfec6a80404dc513b99d3fdbf2a6e53400638" and ssn 123-45-6789 then phone (212) 555-1234',
    "Plain words, some numbers 12 and 345, a date 2020-01-02, a long_identifier_without_any_digit_in_it and commit "
    "0123456789abcdef0123456789abcdef01234567 of order 123-45-6789.",
]


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(GIVEN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (
                kind == "email"
                or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)
                or kind == "phone" and 10 <= len(digits) <= 15
            ):
                out.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return [s[2] for s in sorted(out)]


@pytest.fixture(scope="module")
def model(spark):
    return P.fit_spans(spark)


def test_base_spans_are_those_of_the_given_patterns(spark, model):
    docs = spark.createDataFrame([(k, t, "own", 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, kind string, start long").repartition(3)
    rows = {r.doc_id: r for r in P.personal_data(docs, model).collect()}
    assert len(rows) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        want, row = base_spans(text), rows[k]
        spans = row.spans.split(",") if row.spans else []
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(spans) and len(spans) == len(want) + row.n_added
        assert {kind: row[f"n_{kind}"] for kind in GIVEN} == {kind: sum(s.startswith(kind) for s in want) for kind in GIVEN}
    text = TEXTS[10]
    added = [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in rows[10].spans.split(","))]
    assert added == ['token = "e7fbfec6a80404dc513b99d3fdbf2a6e53400638', "123-45-6789", "(212) 555-1234"]
    assert rows[11].spans == ""


def test_plan_has_no_python(spark, model):
    docs = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = P.personal_data(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapIn", plan)


def test_thresholds_are_precise_on_examples_of_another_seed(spark, model):
    examples = spark.createDataFrame(P.labelled_spans(600, seed=44), "doc_id long, text string, label double")
    rows = P.personal_data(examples, model).join(examples, "doc_id").collect()
    found = [r.label for r in rows if r.n_added]
    assert sum(found) / len(found) > 0.95
    assert sum(found) / sum(r.label for r in rows) > 0.7


def test_hard_rows(spark, model, hard, empty):
    assert P.personal_data(hard, model).count() == hard.count()
    assert P.personal_data(empty, model).collect() == []
