"""Repaired conversations against a search over all edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from placework.llm import conversation_repair as repair
from placework.llm.queries import table

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
# Of the wanted order: what comes after nothing, system, user, assistant.
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """Cost, edits and turns of the cheapest repair of (role, text, fault), the least edits in ASCII order."""

    @functools.cache
    def best(i, state, inserts):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        needed = NEXT[state][-1]
        name = {"u": "user", "a": "assistant"}[needed]
        if inserts < 3:
            cost, edits, turns = best(i, needed, inserts + 1)
            ways.append((cost + 2, "I" + edits, ((name, ""), *turns)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, edits, turns = best(i + 1, state, 0)
            ways.append((cost + 3, "D" + edits, turns))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                cost, edits, turns = best(i + 1, needed, 0)
                ways.append((cost + 2 + extra, "R" + edits, ((name, text), *turns)))
                if role[:1] and role[:1] in NEXT[state]:
                    cost, edits, turns = best(i + 1, role[:1], 0)
                    ways.append((cost + extra, "K" + edits, ((role, text), *turns)))
        return min(ways) if ways else (10**9, "", ())

    return best(0, "", 0)


def expected(rows):
    by_id = {}
    for conv, turn, role, text in rows:
        kept = by_id.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, kept in by_id.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, marked = set(), []
        for _, role, text in kept:
            core = text.strip(" \t\n\v\f\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {r[0] for r in kept if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, repaired = cheapest(tuple(marked))
        lines = [f"{role}:{text}" for role, text in repaired]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = ((gaps, *counts, illegal, cost, audit, digest), lines)
    return out


def hostile_rows():
    r = random.Random(2)
    roles = ["user", "assistant", "system", "tool", "", "ux", None]
    texts = [None, "", " \n", "Hi.", "Yes", "No!", "ok \t", "Wait?\r\n", "é.", "aé", " "]
    rows = []
    for conv in [*range(250), None]:
        for _ in range(r.randrange(1, 12) if conv != 7 else 120):
            turn = r.choice([None, r.randrange(-5, 30), r.randrange(0, 900)])
            rows.append((conv, turn, r.choice(roles), r.choice(texts)))
    # Repeated rows, and a conversation that the damage leaves without rows.
    dropped = next(c for c in range(10_000, 20_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, *[(900, 3, "user", "same.")] * 60, (dropped, 0, "user", "gone.")]


@pytest.mark.parametrize("size", [(4096, 4 << 20), (3, 4 << 20), (50, 20)])
def test_reports_for_any_size_of_chunk(spark, monkeypatch, size):
    monkeypatch.setattr(repair, "CHUNK_ROWS", size[0])
    monkeypatch.setattr(repair, "CHUNK_BYTES", size[1])
    rows = hostile_rows()
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    data = data.withColumn("part", F.lit("x")).withColumn("mark", F.lit(1)).withColumn("cost", F.lit(0))
    want = expected(rows)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.planted_report(data).collect()}
    assert got == {conv: report for conv, (report, _) in want.items()}
    turns = {}
    for r in repair.repaired_turns(repair.with_planted_faults(data)).collect():
        turns.setdefault(r.conv_id, []).append((r.number, f"{r.role}:{r.text}"))
    for conv, (_, lines) in want.items():
        assert sorted(turns.get(conv, [])) == list(enumerate(lines))


def test_query_on_stored_conversations(spark, sf_dir):
    data = table(spark, sf_dir, "conversations")
    rows = [tuple(r) for r in data.select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.planted_report(data).collect()}
    assert got == {conv: report for conv, (report, _) in expected(rows).items()}


def test_ranges_that_end_inside_conversations(spark):
    """A range must not end between the mark of a first row and the row: it would count as a duplicate."""
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = hostile_rows()
        data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
        got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.planted_report(data).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == {conv: report for conv, (report, _) in expected(rows).items()}


def test_block_tables_against_all_edits():
    tables = repair.tables()
    end = tables.number[repair._less_minimum(repair.END)[0]]
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    r = random.Random(3)
    for _ in range(1500):
        symbols = "".join(r.choice(repair.SYMBOLS) for _ in range(r.randrange(0, 22)))
        rows = [("tool", "", "blank") if s == "X" else (names[s.lower()], "t", "truncated" if s.isupper() else "") for s in symbols]
        edits, state = tables.trace(symbols, end, repair.START)
        borders, total = tables.read_back(symbols, end)
        cost, audit, _ = cheapest(tuple(rows))
        assert (edits + repair.final_inserts(state), total + tables.vectors[borders[-1]][repair.START]) == (audit, cost)


def test_empty_table(spark):
    data = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.planted_report(data).count() == 0
    assert repair.repaired_turns(data).count() == 0
