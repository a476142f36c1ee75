"""Cheapest repair of a conversation's turns to the order system?, (user, assistant)+, by Four-Russians block tables.

A row may be kept, given the role user or assistant (2), or deleted (3); an empty user or assistant turn may be inserted
anywhere (2); a row that stays without an end of sentence costs 1. Rows that are blank or repeat an earlier row must go.
The order is an automaton of four states, so the cost still to come from a place on is a vector of four numbers.
Less their minimum only some dozens of vectors occur. For each of them and each block of four symbols the vector before
the block and the cost added are computed once, from the rules; conversations are then read from their end by
look-ups. The edits are traced from the start: each block is expanded backward from the vector behind it into its four
columns, and of the edits that keep the cost the first in ASCII order (D, I, K, R) is taken. No two edits of one letter
lead to different states, so this is the least of all cheapest strings of edits.

Rows are dealt by ranges of conversation and turn, sorted, and cut into chunks. A conversation that lies inside one
range and one chunk is done there. The chunks of others give their cost from each state to each (16 numbers); these
are scanned from a conversation's end for the vector behind each chunk, and the chunks stream through the trace in order,
one chunk in memory at a time. Which row of a conversation is the first with its role and text is an aggregate; its result
is dealt with the rows, as a mark that sorts before the row meant.
"""

from __future__ import annotations

import hashlib
import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

# White space as the contract has it, and ends of sentences.
NO_SPACE = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

START, SYSTEM, USER, ASSISTANT = range(4)
# The state after an inserted or renamed turn, and that after a kept one of each initial.
NEEDED = (USER, USER, ASSISTANT, USER)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
ROLES = {USER: "user", ASSISTANT: "assistant"}
RENAME, DELETE, INSERT, OPEN_END = 2, 3, 2, 1
# Symbols: initial of the role (o: another), capital for a row without an end of sentence, X for a row that must go.
SYMBOLS = "suaoSUAOX"
BLOCK = 4
NEVER = 1 << 40

CHUNK_ROWS = 4096
CHUNK_BYTES = 4 << 20


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Costs when turns may be inserted first; a third insert would come back to a state seen."""
    once = [min(c, INSERT + costs[NEEDED[p]]) for p, c in enumerate(costs)]
    return tuple(min(c, INSERT + once[NEEDED[p]], NEVER) for p, c in enumerate(once))


END = _with_inserts([0, NEVER, NEVER, 0])


def step_back(symbol: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """The costs from before a symbol on, of the costs after it."""
    extra = OPEN_END if symbol.isupper() else 0
    costs = []
    for p in range(4):
        ways = [DELETE + after[p]]
        if symbol != "X":
            ways.append(RENAME + extra + after[NEEDED[p]])
            kept = KEPT[symbol.lower()].get(p)
            if kept is not None:
                ways.append(extra + after[kept])
        costs.append(min(ways))
    return _with_inserts(costs)


def _less_minimum(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(c - least if c < NEVER else NEVER for c in costs), least


class BlockTables:
    """All vectors that can occur, and where each block of BLOCK symbols leads from each of them."""

    def __init__(self):
        ends = [_with_inserts([0 if p == q else NEVER for p in range(4)]) for q in range(4)]
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        for costs in (END, *ends):
            self._number(_less_minimum(costs)[0])
        after, cost = [], []
        for vector in self.vectors:  # grows while it is read
            steps = [_less_minimum(step_back(s, vector)) for s in SYMBOLS]
            after.append([self._number(v) for v, _ in steps])
            cost.append([least for _, least in steps])
        # One symbol, then two, ...: the table of a block is that of its last symbols, followed by one more before them.
        one, one_cost = np.array(after), np.array(cost)
        block, block_cost = one, one_cost
        for _ in range(BLOCK - 1):
            block_cost = block_cost[:, None, :] + np.stack([one_cost[block, s] for s in range(len(SYMBOLS))], axis=1)
            block = np.stack([one[block, s] for s in range(len(SYMBOLS))], axis=1)
            block, block_cost = block.reshape(len(self.vectors), -1), block_cost.reshape(len(self.vectors), -1)
        codes = ("".join(c) for c in itertools.product(SYMBOLS, repeat=BLOCK))
        self.code = {text: k for k, text in enumerate(codes)}
        self.block, self.block_cost = block.tolist(), block_cost.tolist()
        self.one, self.one_cost = one.tolist(), one_cost.tolist()
        self.expanded: dict[tuple, tuple[str, int]] = {}

    def _number(self, vector: tuple[int, ...]) -> int:
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector]

    def read_back(self, symbols: str, after: int) -> tuple[list[int], int]:
        """Numbers of the vectors at the borders of a text's blocks, the last block's right border first, and the cost added.

        Blocks are counted from the left; the last one may be shorter.
        """
        rest = len(symbols) % BLOCK
        borders, total = [after], 0
        for symbol in reversed(symbols[len(symbols) - rest :]):
            s = SYMBOLS.index(symbol)
            total += self.one_cost[after][s]
            after = self.one[after][s]
        if rest:
            borders.append(after)
        for at in range(len(symbols) - rest - BLOCK, -1, -BLOCK):
            code = self.code[symbols[at : at + BLOCK]]
            total += self.block_cost[after][code]
            after = self.block[after][code]
            borders.append(after)
        return borders, total

    def transfer(self, symbols: str) -> list[int]:
        """Cost from each state before the symbols (minor) to each state behind them (major)."""
        out = []
        for q in range(4):
            vector, least = _less_minimum(_with_inserts([0 if p == q else NEVER for p in range(4)]))
            borders, total = self.read_back(symbols, self.number[vector])
            out += [min(NEVER, c + total + least) for c in self.vectors[borders[-1]]]
        return out

    def trace(self, symbols: str, after: int, state: int) -> tuple[str, int]:
        """The least string of cheapest edits of the symbols from a state, and the state behind them."""
        borders, _ = self.read_back(symbols, after)
        edits = []
        for k, at in enumerate(range(0, len(symbols), BLOCK)):
            key = (symbols[at : at + BLOCK], borders[-2 - k], state)
            if key not in self.expanded:
                if len(self.expanded) > 1 << 18:
                    self.expanded.clear()
                self.expanded[key] = self._expand(*key)
            letters, state = self.expanded[key]
            edits.append(letters)
        return "".join(edits), state

    def _expand(self, symbols: str, after: int, state: int) -> tuple[str, int]:
        columns = [self.vectors[after]]
        for symbol in reversed(symbols):
            columns.append(step_back(symbol, columns[-1]))
        columns.reverse()
        letters = ""
        for k, symbol in enumerate(symbols):
            here, behind, extra = columns[k], columns[k + 1], OPEN_END if symbol.isupper() else 0
            kept = KEPT[symbol.lower()] if symbol != "X" else {}
            while True:
                if here[state] == DELETE + behind[state]:
                    letters += "D"
                elif here[state] == INSERT + here[NEEDED[state]]:
                    letters, state = letters + "I", NEEDED[state]
                    continue
                elif state in kept and here[state] == extra + behind[kept[state]]:
                    letters, state = letters + "K", kept[state]
                else:
                    letters, state = letters + "R", NEEDED[state]
                break
        return letters, state


def tables() -> BlockTables:
    """Kept in the process: tasks that come with a copy of this module share them."""
    if "_placework_repair" not in sys.__dict__:
        sys.__dict__["_placework_repair"] = BlockTables()
    return sys.__dict__["_placework_repair"]


def final_inserts(state: int) -> str:
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


# ------------------------------------------------------------------------------------------------ rows to chunks


class Chunk:
    """Consecutive rows of a conversation: their symbols, the rows that may stay, and counts."""

    def __init__(self):
        self.symbols, self.kept, self.size, self.length = [], [], 0, 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
        self.first = self.last = ""  # role initials
        self.first_turn = self.last_turn = None

    def add(self, turn, role: str, text: str, fault: str, times: int = 1) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if fault in ("blank", "duplicate"):
            self.symbols.append("X" * times)
        else:
            self.symbols.append(initial.upper() if fault else initial)
            self.kept.append((role, text))
            self.size += len(text) + len(role)
        self.length += times
        if fault:
            self.counts[fault] += times
        if self.last:
            self.counts["illegal"] += (self.last + initial) not in LEGAL
        self.counts["illegal"] += (times - 1) * ((initial + initial) not in LEGAL)
        self.first, self.last = self.first or initial, initial
        if turn is not None:
            self.counts["turns"] += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def row(self) -> dict:
        return {
            "symbols": "".join(self.symbols),
            "kept": [{"role": r, "text": t} for r, t in self.kept],
            **self.counts,
            "first": self.first,
            "last": self.last,
            "first_turn": self.first_turn,
            "last_turn": self.last_turn,
        }


LEGAL = ("su", "ua", "au")
CHUNK_FIELDS = (
    "symbols string, kept array<struct<role:string,text:string>>, blank long, duplicate long, truncated long, "
    "illegal long, turns long, first string, last string, first_turn long, last_turn long"
)


class Repair:
    """A conversation's chunks in order, with the vector behind each -> its report and its repaired turns."""

    def __init__(self, rows: bool):
        self.rows = rows
        self.state, self.cost, self.number = START, 0, 0
        self.edits, self.hash = [], hashlib.sha256()
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.last, self.first_turn, self.last_turn = "", None, None

    def add(self, chunk: dict, after: int) -> Iterator[tuple[int, str, str]]:
        for name in self.counts:
            self.counts[name] += chunk[name]
        if self.last and chunk["first"]:
            self.counts["illegal"] += (self.last + chunk["first"]) not in LEGAL
        self.last = chunk["last"] or self.last
        if chunk["first_turn"] is not None:
            self.counts["turns"] -= chunk["first_turn"] == self.last_turn
            self.first_turn = chunk["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = chunk["last_turn"]
        state = self.state
        edits, self.state = tables().trace(chunk["symbols"], after, state)
        yield from self._apply(edits, state, chunk["symbols"], chunk["kept"])

    def _apply(self, edits: str, state: int, symbols: str, kept: list) -> Iterator[tuple[int, str, str]]:
        self.edits.append(edits)
        at, rows = 0, iter(kept)
        for edit in edits:
            if edit == "I":
                self.cost += INSERT
                state = NEEDED[state]
                yield self._turn(ROLES[state], "")
                continue
            symbol = symbols[at]
            at += 1
            row = next(rows) if symbol != "X" else None
            if edit == "D":
                self.cost += DELETE
                continue
            self.cost += OPEN_END if symbol.isupper() else 0
            if edit == "K":
                state = KEPT[symbol.lower()][state]
                yield self._turn(row["role"], row["text"])
            else:
                self.cost += RENAME
                state = NEEDED[state]
                yield self._turn(ROLES[state], row["text"])

    def _turn(self, role: str, text: str) -> tuple[int, str, str]:
        self.hash.update(f"{chr(10) if self.number else ''}{role}:{text}".encode())
        self.number += 1
        return self.number - 1, role, text

    def end(self) -> Iterator[tuple[int, str, str]]:
        yield from self._apply(final_inserts(self.state), self.state, "", [])

    def report(self) -> dict:
        c = self.counts
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - c["turns"]
        return {
            "gaps": gaps,
            **{k: c[k] for k in ("blank", "duplicate", "truncated", "illegal")},
            "cost": self.cost,
            "audit": "".join(self.edits),
            "repaired_sha256": self.hash.hexdigest(),
        }


REPORT_FIELDS = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted rows and marks -> (conversation, number of its chunk here, chunk, whether it is the last one here)."""
    current, chunk, number, mark, have = None, None, 0, None, False
    fields = ["conv_id", "turn", "role", "digest", "mark", "text", "times", "blank", "open"]
    for conv, turn, role, digest, is_mark, text, times, blank, open_ in _columns(batches, fields):
        if have and conv != current:
            yield current, number, chunk, True
            have = False
        if not have:
            current, chunk, number, mark, have = conv, Chunk(), 0, None, True
        if is_mark:
            mark = (turn, role, digest)
            continue
        fault = "blank" if blank else "duplicate" if mark != (turn, role, digest) else "truncated" if open_ else ""
        again = times - 1
        if chunk.length >= CHUNK_ROWS or chunk.size >= CHUNK_BYTES:
            yield current, number, chunk, False
            chunk, number = Chunk(), number + 1
        chunk.add(turn, role, text, fault)
        while again:
            if chunk.length >= CHUNK_ROWS:
                yield current, number, chunk, False
                chunk, number = Chunk(), number + 1
            part = min(again, CHUNK_ROWS - chunk.length)
            chunk.add(turn, role, text, "blank" if blank else "duplicate", part)
            again -= part
    if have:
        yield current, number, chunk, True


def _out(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _in_batches(rows: Iterator[dict], schema: pa.Schema, size=lambda row: 1, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= most:
            yield _out(held, schema)
            held, total = [], 0
    if held:
        yield _out(held, schema)


def _first_pass(schema: pa.Schema, rows: bool):
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        part, first = TaskContext.get().partitionId(), True
        held = None  # the last conversation of a range may go on in the next one
        whole_end = tables().number[_less_minimum(END)[0]]
        for conv, number, chunk, last in _chunks(batches):
            if held is not None:
                yield finish(held, part, whole_end)
                held = None
            if first or number or not last:
                yield unfinished(conv, part, number, chunk)
                first = first and not last
            else:
                held = (conv, number, chunk)
        if held is not None:
            yield unfinished(held[0], part, held[1], held[2])

    def finish(held: tuple, part: int, after: int) -> dict:
        conv, number, chunk = held
        repair = Repair(rows)
        turns = [*repair.add(chunk.row(), after), *repair.end()]
        done = [{"number": n, "role": r, "text": t} for n, r, t in turns] if rows else None
        return {"conv_id": conv, "part": part, "chunk": number, "report": repair.report(), "done": done}

    def unfinished(conv, part: int, number: int, chunk: Chunk) -> dict:
        row = chunk.row()
        return {"conv_id": conv, "part": part, "chunk": number, "transfer": tables().transfer(row["symbols"]), "rest": row}

    def size(row: dict) -> int:
        kept = row.get("rest", {}).get("kept", ())
        return 512 + sum(len(k["text"]) for k in kept) + sum(len(d["text"]) for d in row.get("done") or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(one(batches), schema, size, CHUNK_BYTES)

    return run


def _vectors_behind(schema: pa.Schema):
    """Chunks from a conversation's last to its first -> the number of the vector behind each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        current, costs, have = None, END, False
        for conv, part, number, transfer in _columns(batches, ["conv_id", "part", "chunk", "transfer"]):
            if not have or conv != current:
                current, costs, have = conv, END, True
            costs, _ = _less_minimum(costs)
            yield {"conv_id": conv, "part": part, "chunk": number, "after": tables().number[costs]}
            costs = tuple(min(NEVER, *(transfer[4 * q + p] + costs[q] for q in range(4))) for p in range(4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(scan(batches), schema)

    return run


def _second_pass(schema: pa.Schema, rows: bool):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        current, repair = None, None

        def close() -> Iterator[dict]:
            for n, role, text in repair.end():
                if rows:
                    yield {"conv_id": current, "number": n, "role": role, "text": text}
            if not rows:
                yield {"conv_id": current, **repair.report()}

        for conv, rest, after in _columns(batches, ["conv_id", "rest", "after"]):
            if repair is not None and conv != current:
                yield from close()
                repair = None
            if repair is None:
                current, repair = conv, Repair(rows)
            for n, role, text in repair.add(rest, after):
                if rows:
                    yield {"conv_id": conv, "number": n, "role": role, "text": text}
        if repair is not None:
            yield from close()

    def size(row: dict) -> int:
        return 256 + len(row.get("text") or "") + len(row.get("audit") or "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(stream(batches), schema, size, CHUNK_BYTES)

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _fields(first: T.StructField, ddl: str) -> T.StructType:
    return T.StructType([first, *T._parse_datatype_string(ddl)])


def _repaired(conversations: DataFrame, rows: bool) -> DataFrame:
    conv = T.StructField("conv_id", conversations.schema["conv_id"].dataType)
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    plain = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    )
    # Equal rows meet in each map task, so a row that is there a million times is one row.
    keys = ["conv_id", "turn", "role"]
    counted = plain.groupBy(*keys, "text").agg(F.count("*").alias("times"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    blank, open_ = ~F.col("text").rlike(NO_SPACE), ~F.col("text").rlike(ENDED)
    data = counted.select(*keys, digest, F.lit(1).alias("order"), "text", "times", blank.alias("blank"), open_.alias("open"))
    # Null turns come first, so a least turn that skipped them would be wrong: false sorts before true.
    least = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    firsts = plain.select(*keys, digest).groupBy("conv_id", "role", "digest").agg(least.alias("first"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("text", "string"), ("times", "long"), ("blank", "boolean"), ("open", "boolean"))]
    marks = firsts.select("conv_id", F.col("first.turn").alias("turn"), "role", "digest", F.lit(0).alias("order"), *none)
    # Ranges end between keys, never between a mark and its row.
    place = [*keys, "digest"]
    dealt = data.unionByName(marks).repartitionByRange(*place).sortWithinPartitions(*place, "order")
    dealt = dealt.select("conv_id", "turn", "role", "digest", (F.col("order") == 0).alias("mark"), "text", "times", "blank", "open")
    turns = "number long, role string, text string"
    first = _fields(
        conv,
        "part int, chunk long, transfer array<long>, "
        f"rest struct<{CHUNK_FIELDS}>, report struct<{REPORT_FIELDS}>, done array<struct<{turns}>>",
    )
    chunks = written(dealt.mapInArrow(_first_pass(_arrow(first), rows), first), "repair-chunks")
    at = ["conv_id", "part", "chunk"]
    cut = chunks.where("rest IS NOT NULL")
    behind = _fields(conv, "part int, chunk long, after int")
    back = cut.select(*at, "transfer").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("chunk"))
    vectors = back.mapInArrow(_vectors_behind(_arrow(behind)), behind)
    vectors = vectors.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.col("chunk").alias("_chunk"), "after")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")) & (F.col("chunk") == F.col("_chunk"))
    stream = cut.select(*at, "rest").join(vectors, same).select(*at, "rest", "after")
    stream = stream.repartition("conv_id").sortWithinPartitions(*at)
    second = _fields(conv, turns if rows else REPORT_FIELDS)
    streamed = stream.mapInArrow(_second_pass(_arrow(second), rows), second)
    done = chunks.where("rest IS NULL")
    done = done.select("conv_id", F.inline("done")) if rows else done.select("conv_id", "report.*")
    return done.unionByName(streamed)


def repair_report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    conversations: conv_id, turn, role, text. Rows of a conversation are in the order of turn (nulls first), role, SHA-256 of
    the text; equal rows follow each other. Null roles and texts are one space; a null conv_id is a conversation. An
    empty table gives an empty result; other columns are ignored. audit has an edit's initial (K, R, D, I) per edit;
    repaired_sha256 is that of `role:text` of the repaired turns, joined by line ends.
    A conversation's audit, and the stream that its hash is taken of, are in one task by their nature; the rows of a
    long one pass as chunks of up to 4,096 rows, one at a time.
    """
    return _repaired(conversations, False)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, number (from 0), role, text of the repaired turns of every conversation; rules as for `repair_report`."""
    return _repaired(conversations, True)


# ------------------------------------------------------------------------------------------------ planted faults


def with_planted_faults(conversations: DataFrame) -> DataFrame:
    """The rows after damage by k = crc32(`conv_id:turn`) % 20 (nulls: one space).

    0 drops a row, 1 empties its text, 2 removes its `.!?`, 3 repeats it, 4 makes its role user.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("k")).where("k <> 0")
    changed = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("k") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        changed.alias("text"),
        F.explode(F.sequence(F.lit(1), times)).alias("_n"),
    ).drop("_n")


def planted_report(conversations: DataFrame) -> DataFrame:
    """The report of every conversation after the damage, those without rows left included."""
    report = repair_report(with_planted_faults(conversations))
    report = report.withColumnRenamed("conv_id", "_conv")
    ids = conversations.select("conv_id").distinct()
    joined = ids.join(report, ids["conv_id"].eqNullSafe(report["_conv"]), "left")
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    columns = [f.name for f in T._parse_datatype_string(REPORT_FIELDS)]
    return joined.select("conv_id", *[F.coalesce(c, F.lit(none.get(c, 0))).alias(c) for c in columns])
