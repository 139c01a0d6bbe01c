"""Conversation structure repair: a Viterbi search in parallel, by rank convergence.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Its rows can be
kept, given another role, deleted, and empty rows can be inserted; the cheapest edits are a
shortest path over four states (nothing yet, after s, after u, after a). Costs to go are
computed backwards, so that the least of the cheapest paths can be read off forwards.

Rows are dealt by range in the order of conversation, turn, role and text, and cut into
chunks, so a conversation of any length spreads over tasks. All chunks of a long
conversation go backwards at once, from a speculative cost vector except for the last. A
vector counts up to a constant, so what a chunk passes on soon does not depend on what it
got: fix-up rounds rerun the chunks whose vector was wrong, and a rerun ends as soon as its
vector differs from that of the former run by a constant only. Then each chunk gives the
state that it would leave each state in; these four numbers, followed through the chunks,
give the state in which each is entered, and all chunks trace their edits at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.common import looked_up, small_batches
from loanlens.session import settle

#: Rows and bytes of text in a chunk.
CHUNK = 4096
CHUNK_BYTES = 1 << 20
#: Chunks that go to Python at once.
BATCH = 200
#: Costs of edits; a truncated row that is not deleted costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: Cost vector after the last row: a user's turn needs an answer, a system's a pair.
_END = (0, 2 * INSERT, INSERT, 0)
_GUESS = (0, 0, 0, 0)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_LETTER = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
_LEGAL = {"su", "ua", "au"}
_BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")

Vector = tuple[int, int, int, int]
#: What the search needs of a row: state that its role leads to or None, whether it must go,
#: whether it is truncated, number of copies. Further copies must go.
Step = tuple[int | None, bool, bool, int]

_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_STEP = pa.struct([("letter", pa.int32()), ("forced", pa.bool_()), ("cut", pa.bool_()), ("copies", pa.int64())])
_VECTOR = "array<bigint>"
_CHUNK = (
    "conv_id {conv}, part int, seq int, steps array<struct<letter:int,forced:boolean,cut:boolean,copies:bigint>>, "
    "turns array<struct<role:string,text:string>>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "first string, last string, low bigint, high bigint, turns_seen bigint"
)


def fault_of(text: str, later: bool) -> str | None:
    """First fault of a row; ``later`` says that its role and text were seen earlier."""
    seen = text.rstrip(_BLANKS)
    if not seen:
        return "blank"
    if later:
        return "duplicate"
    return None if seen[-1] in ".!?" else "truncated"


def backward(step: Step, b: Vector) -> Vector:
    """Costs to go before a row from those after it, insertions in front of it included."""
    letter, forced, cut, copies = step
    more = DELETE * (copies - 1)
    v = [DELETE + x for x in b]
    if not forced:
        extra = TRUNCATED if cut else 0
        user = extra + b[_USER] + (0 if letter == _USER else REROLE)
        answer = extra + b[_ASSISTANT] + (0 if letter == _ASSISTANT else REROLE)
        v = [min(v[0], user), min(v[1], user), min(v[2], answer), min(v[3], user)]
        if letter == _SYSTEM:
            v[_START] = min(v[_START], extra + b[_SYSTEM])
    u = min(v[_USER], INSERT + v[_ASSISTANT])
    return (more + min(v[0], INSERT + u), more + min(v[1], INSERT + u), more + u, more + min(v[3], INSERT + v[2]))


def levelled(v: Vector) -> Vector:
    """The vector less its least cost: equal for vectors that differ by a constant."""
    return tuple(x - min(v) for x in v)


def start_of(steps: list[Step], end: Vector) -> Vector:
    for step in reversed(steps):
        end = backward(step, end)
    return end


def fixed_up(steps: list[Step], old_end: Vector, old_start: Vector, end: Vector) -> Vector:
    """The vector before the steps for another one after them. Goes back along both until
    they differ by a constant, from where on they do so up to the first step."""
    old = old_end
    for step in reversed(steps):
        if levelled(old) == levelled(end):
            break
        old, end = backward(step, old), backward(step, end)
    else:
        return end
    return tuple(x + end[0] - old[0] for x in old_start)


def traced(steps: list[Step], state: int, end: Vector, last: bool) -> tuple[str, list[tuple[str, int | None, int]], int, int]:
    """Least of the cheapest edits from a state: their initials, (edit, row, state) of each
    row that results, the state at the end and the cost."""
    costs = [end]
    for step in reversed(steps):
        costs.append(backward(step, costs[-1]))
    costs.reverse()
    audit, rows, begun = [], [], costs[0][state]
    for i, (letter, forced, cut, copies) in enumerate(steps):
        more, extra = DELETE * (copies - 1), TRUNCATED if cut else 0
        while True:
            b, left, after = costs[i][state], costs[i + 1], _NEXT[state]
            # In ASCII order: Delete, Insert, Keep, Rerole.
            if b == DELETE + more + left[state]:
                audit.append("D")
            elif b == INSERT + costs[i][after]:
                audit.append("I")
                rows.append(("I", None, after))
                state = after
                continue
            elif not forced and letter is not None and (letter == after or letter == _SYSTEM and state == _START) and b == extra + more + left[letter]:
                audit.append("K")
                rows.append(("K", i, letter))
                state = letter
            else:
                audit.append("R")
                rows.append(("R", i, after))
                state = after
            break
        audit.append("D" * (copies - 1))
    while last and state in (_SYSTEM, _USER):
        state = _NEXT[state]
        audit.append("I")
        rows.append(("I", None, state))
    return "".join(audit), rows, state, begun - (0 if last else end[state])


def _chunker(rows_most: int, bytes_most: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        schema, open_, conv, size = None, [], None, 0

        def closed() -> pa.RecordBatch:
            steps, turns, count, illegal, before, low, high, seen = [], [], dict.fromkeys(FAULTS, 0), 0, None, None, None, 0
            for turn, role, text, copies, later in open_:
                fault = fault_of(text, later)
                if fault:
                    count[fault] += 1
                count["blank" if fault == "blank" else "duplicate"] += copies - 1
                initial = role[:1]
                illegal += (before is not None and before + initial not in _LEGAL) + copies - 1
                before = initial
                if turn is not None and turn != high:
                    low, high, seen = turn if low is None else low, turn, seen + 1
                steps.append({"letter": _LETTER.get(initial), "forced": fault in ("blank", "duplicate"), "cut": fault == "truncated", "copies": copies})
                turns.append({"role": role, "text": text})
            row = {
                "conv_id": conv, "part": part, "seq": seq, "steps": steps, "turns": turns, **count, "illegal": illegal,
                "first": open_[0][1][:1], "last": before, "low": low, "high": high, "turns_seen": seen,
            }
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            if schema is None:
                i64, text = pa.int64(), pa.string()
                fields = {"conv_id": batch.schema.field("conv_id").type, "part": pa.int32(), "seq": pa.int32(), "steps": pa.list_(_STEP), "turns": pa.list_(_TURN)}
                fields |= dict.fromkeys([*FAULTS, "illegal"], i64) | {"first": text, "last": text, "low": i64, "high": i64, "turns_seen": i64}
                schema = pa.schema(fields)
            for row in batch.to_pylist():
                if open_ and (row["conv_id"] != conv or len(open_) >= rows_most or size >= bytes_most):
                    yield closed()
                    seq, size, open_ = seq + 1, 0, []
                conv = row["conv_id"]
                size += len(row["text"])
                open_.append((row["turn"], row["role"], row["text"], row["copies"], row["later"]))
        if open_:
            yield closed()

    return cut


def chunked(rows: DataFrame, chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (conv_id, turn, role, text) in order, cut into chunks, with the faults in each."""
    space = {c: F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")}
    rows = rows.select("conv_id", "turn", "role", "text").withColumns(space)
    known = F.sha2(F.col("text"), 256)
    # Only texts that a conversation repeats are looked up.
    repeated = (
        rows.groupBy("conv_id", "role", known.alias("_known"))
        .agg(F.count("*").alias("n"), F.min("turn").alias("_low"), F.max(F.col("turn").isNull()).alias("_untimed"))
        .where("n > 1")
        .select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), "_known", "_low", "_untimed")
    )
    copies = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (known == F.col("_known"))
    later = F.col("turn").isNotNull() & (F.col("_untimed") | (F.col("turn") > F.col("_low")))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    placed = (
        copies.join(looked_up(repeated), same, "left")
        .select("conv_id", "turn", "role", "text", "copies", F.coalesce(later, F.lit(False)).alias("later"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )
    conv = rows.schema["conv_id"].dataType.simpleString()
    return settle(placed.mapInArrow(_chunker(chunk, chunk_bytes), _CHUNK.format(conv=conv)))


def _steps(listed: list[dict]) -> list[Step]:
    return [(s["letter"], s["forced"], s["cut"], s["copies"]) for s in listed]


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        ends = [_END if r["k"] == r["chunks"] else _GUESS for r in rows]
        starts = [start_of(_steps(r["steps"]), e) for r, e in zip(rows, ends)]
        yield _with(batch, end=ends, start=starts)


def _fix_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, ends = [], []
        for r in batch.to_pylist():
            old, new = tuple(r["end"]), tuple(r["passed"] or r["end"])
            starts.append(tuple(r["start"]) if new == old else fixed_up(_steps(r["steps"]), old, tuple(r["start"]), new))
            ends.append(new)
        yield _with(batch.drop_columns(["end", "start", "passed"]), end=ends, start=starts)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[traced(_steps(r["steps"]), q, tuple(r["end"]), r["k"] == r["chunks"])[2] for q in range(4)] for r in batch.to_pylist()]
        yield _with(batch.drop_columns(["steps"]), exits=found)


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks come by conversation and number."""
    state = _START
    for batch in batches:
        entries = []
        for k, exits in zip(batch["k"].to_pylist(), batch["exits"].to_pylist()):
            state = _START if k == 1 else state
            entries.append(state)
            state = exits[state]
        yield batch.drop_columns(["exits"]).append_column("entry", pa.array(entries, pa.int32()))


def _with(batch: pa.RecordBatch, **columns: list) -> pa.RecordBatch:
    for name, values in columns.items():
        batch = batch.append_column(name, pa.array([list(v) for v in values], pa.list_(pa.int64())))
    return batch


def converged(chunks: DataFrame) -> DataFrame:
    """(conv_id, part, seq, k, chunks, end, entry) of the chunks of long conversations: their
    cost vector after the last row and the state before the first."""
    conv = chunks.schema["conv_id"].dataType.simpleString()
    head = f"conv_id {conv}, part int, seq int, k bigint, chunks bigint"
    steps = f"{head}, steps {chunks.schema['steps'].dataType.simpleString()}"
    at = settle(chunks.mapInArrow(_first_pass, f"{steps}, end {_VECTOR}, start {_VECTOR}"))
    least = F.array_min("start")
    while True:
        passed = at.select(
            F.col("conv_id").alias("_conv"), (F.col("k") - 1).alias("_k"), F.transform("start", lambda x: x - least).alias("passed")
        )
        after = at.join(passed, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("k") == F.col("_k")), "left").drop("_conv", "_k")
        after = settle(after)
        if not after.where("passed <> end").limit(1).count():
            break
        at = settle(after.mapInArrow(_fix_up, f"{steps}, end {_VECTOR}, start {_VECTOR}"))
    exits = at.select("conv_id", "part", "seq", "k", "chunks", "steps", "end").mapInArrow(_exits, f"{head}, end {_VECTOR}, exits {_VECTOR}")
    placed = exits.repartition("conv_id").sortWithinPartitions("conv_id", "k")
    return settle(placed.mapInArrow(_enter, f"{head}, end {_VECTOR}, entry int"))


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        audits, costs, repaired = [], [], []
        for r in batch.to_pylist():
            end = tuple(r["end"] or _END)
            audit, rows, _, cost = traced(_steps(r["steps"]), r["entry"] or _START, end, r["k"] == r["chunks"])
            turn = lambda edit, i, q: {"role": r["turns"][i]["role"] if edit == "K" else _ROLE[q], "text": "" if i is None else r["turns"][i]["text"]}  # noqa: E731,B023
            audits.append(audit)
            costs.append(cost)
            repaired.append([turn(*row) for row in rows])
        batch = batch.drop_columns(["steps", "turns", "end", "entry"])
        for name, values, kind in (("cost", costs, pa.int64()), ("audit", audits, pa.string()), ("repaired", repaired, pa.list_(_TURN))):
            batch = batch.append_column(name, pa.array(values, kind))
        yield batch


def repaired_chunks(conversations: DataFrame, chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Repaired conversations in chunks, numbered by ``k`` of ``chunks``: their rows as
    ``repaired`` (role, text), ``audit`` and ``cost`` of the edits, and the faults.

    Takes conv_id, turn, role and text; other columns have no part. Rows are ordered by turn
    (nulls first), then role and text. A null role or text counts as one space, rows with a
    null conv_id are a conversation. Of rows equal in role and text all but the first are
    duplicates, repeated rows among them. The first fault counts: blank, duplicate,
    truncated. Blank and duplicate rows must be deleted. Of the cheapest edits the
    ASCII-least initials are taken (Delete, Insert, Keep, Rerole).
    """
    chunks = chunked(conversations, chunk, chunk_bytes)
    several = looked_up(chunks.groupBy("conv_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("conv_id").alias("_conv")))
    is_long = F.col("conv_id").eqNullSafe(F.col("_conv"))
    short = chunks.join(several, is_long, "left_anti").withColumns(
        {"k": F.lit(1).cast("bigint"), "chunks": F.lit(1).cast("bigint"), "end": F.lit(None).cast(_VECTOR), "entry": F.lit(None).cast("int")}
    )
    # A number per chunk of a long conversation; one row for thousands of its rows.
    inside = Window.partitionBy("conv_id")
    ours = chunks.join(several, is_long, "left_semi")
    numbered = ours.select("conv_id", "part", "seq", "steps").withColumns(
        {"k": F.row_number().over(inside.orderBy("part", "seq")).cast("bigint"), "chunks": F.count("*").over(inside)}
    )
    conv = chunks.schema["conv_id"].dataType.simpleString()
    rest = _CHUNK.format(conv=conv).split(", turns array")[0].split(", steps")[0]
    stats = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, low bigint, high bigint, turns_seen bigint"
    schema = f"{rest}, {stats}, k bigint, chunks bigint, cost bigint, audit string, repaired array<struct<role:string,text:string>>"
    with small_batches(chunks.sparkSession, BATCH):
        states = converged(numbered.select("conv_id", "part", "seq", "k", "chunks", "steps")).drop("conv_id")
        long = ours.join(states, ["part", "seq"]).select(short.columns)
        return settle(short.unionByName(long).mapInArrow(_trace, schema))


REPORT = "conv_id {conv}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a conversation from its chunks, which come in order; texts are hashed as
    they come."""

    def chunks():
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.schema, batch.slice(i, 1).to_pylist()[0]

    for conv, group in groupby(chunks(), lambda c: c[1]["conv_id"]):
        total, digest, audit, before, low, high, seen, begun = dict.fromkeys([*FAULTS, "illegal", "cost"], 0), hashlib.sha256(), [], None, None, None, 0, False
        for schema, c in group:
            for name in total:
                total[name] += c[name]
            total["illegal"] += before is not None and before + c["first"] not in _LEGAL
            before = c["last"]
            if c["low"] is not None:
                low, seen = c["low"] if low is None else low, seen + c["turns_seen"] - (c["low"] == high)
                high = c["high"]
            audit.append(c["audit"])
            for turn in c["repaired"]:
                digest.update((("\n" if begun else "") + f"{turn['role']}:{turn['text']}").encode())
                begun = True
        row = {"conv_id": conv, "gaps": 0 if low is None else high - low + 1 - seen, **total, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
        kinds = [schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
        names = ("conv_id", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256")
        yield pa.RecordBatch.from_pylist([row], pa.schema(list(zip(names, kinds))))


def report(chunks: DataFrame) -> DataFrame:
    """One row per conversation of ``repaired_chunks``: gaps between its turns, faults, illegal
    neighbours, cost, audit and the SHA-256 of its repaired ``role:text`` lines.

    A digest follows its text from begin to end, so the chunks of one conversation meet in
    a task, which holds one of them at a time.
    """
    conv = chunks.schema["conv_id"].dataType.simpleString()
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns_seen"), F.lit(0)).cast("bigint")
    short = chunks.where("chunks = 1").select(
        "conv_id", gaps.alias("gaps"), *FAULTS, "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256")
    )
    long = chunks.where("chunks > 1").repartition("conv_id").sortWithinPartitions("conv_id", "k")
    return short.unionByName(long.mapInArrow(_fold, REPORT.format(conv=conv)))
