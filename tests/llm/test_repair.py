"""Conversation repair against a plain search over all edits, at any chunk size."""

import random
import re
from functools import lru_cache
from hashlib import sha256

import pytest

from loanlens.llm import repair

ROWS = "conv_id bigint, turn bigint, role string, text string, k bigint, audit string"


def plain(rows):
    """Faults, cost, audit and repaired lines of one conversation, by search of all edits."""
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0d]", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    step = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, q, inserted):
        found = [(0, "", ())] if i == len(rows) and q in ("", "a") else []
        add = lambda cost, edit, line, rest: found.append((cost + rest[0], edit + rest[1], line + rest[2])) if rest else None
        if inserted < 3:
            for letter, role in (("u", "user"), ("a", "assistant")):
                if letter in step[q]:
                    add(5, "I", (f"{role}:",), best(i, letter, inserted + 1))
        if i < len(rows):
            _, role, text = rows[i]
            add(2, "D", (), best(i + 1, q, 0))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                if role[:1] and role[0] in step[q]:
                    add(more, "K", (f"{role}:{text}",), best(i + 1, role[0], 0))
                for letter, name in (("u", "user"), ("a", "assistant")):
                    if letter in step[q]:
                        add(1 + more, "R", (f"{name}:{text}",), best(i + 1, letter, 0))
        return min(found, default=None)

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    count = [faults.count(f) for f in repair.FAULTS]
    return (gaps, *count, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha256("\n".join(lines).encode()).hexdigest())


def conversations():
    random.seed(5)
    made = {}
    for c in range(60):
        good = random.random() < 0.5
        rows = []
        for t in range(random.randint(1, 24)):
            role = ["user", "assistant"][t % 2] if good and random.random() < 0.8 else random.choice(["system", "user", "assistant", "tool", "u2", "", None])
            text = random.choice(["Yes.", "No!", f"t{t}.", f"t{t}?", f"open {t}", "", " \n", None, "end. \t"])
            rows.append((random.choice([t, t + 3, None, t // 4]), role, text))
        made[None if c == 7 else c] = rows
    made[100] = [(1, "user", "same.")] * 9 + [(None, "user", "same.")] * 2 + [(2, "assistant", "x.")] * 3
    made[101] = [(0, "user", "")]
    made[102] = [(None, None, None)]
    made[103] = [(i, ["user", "assistant"][i % 2], f"long {i}.") for i in range(80)]
    made[104] = [(i, "user", f"{i}") for i in range(40)]
    made[105] = [(i, "system", f"{i}.") for i in range(40)]
    made[106] = [(0, "user", "y" * 300_000 + "."), (1, "assistant", "z" * 300_000)]
    return made


@pytest.fixture(scope="module")
def table(spark):
    rows = [(c, *r, 5, "mine") for c, rows in conversations().items() for r in rows]
    random.shuffle(rows)
    return spark.createDataFrame(rows, ROWS)


@pytest.mark.parametrize("chunk", [4096, 7, 1])
def test_repair_equals_plain_search(spark, table, chunk):
    chunks = repair.repaired_chunks(table, chunk, 1 << 20)
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(chunks).collect()}
    want = {c: plain(rows) for c, rows in conversations().items()}
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], c
    for conv in {r.conv_id for r in chunks.where("chunks = 1").collect()} - {None}:
        initials = "".join(t.role[0] for t in chunks.where(f"conv_id = {conv}").first().repaired)
        assert re.fullmatch("(s?(ua)+)?", initials)
        break


def test_fix_up_stops_where_vectors_differ_by_a_constant():
    random.seed(8)
    for _ in range(300):
        steps = [(random.choice([None, 1, 2, 3]), random.random() < 0.2, random.random() < 0.3, random.choice([1, 1, 1, 4])) for _ in range(random.randint(0, 12))]
        ends = [tuple(random.randint(0, 12) for _ in range(4)) for _ in range(2)]
        ends = [repair.start_of([(2, False, False, 1)], e) for e in ends]
        first = repair.start_of(steps, ends[0])
        assert repair.fixed_up(steps, ends[0], first, ends[1]) == repair.start_of(steps, ends[1])


def test_empty_table(spark, table):
    assert repair.report(repair.repaired_chunks(table.limit(0))).count() == 0
