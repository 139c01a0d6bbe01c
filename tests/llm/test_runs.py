"""Periodic runs against a direct search over all periods."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from loanlens.llm import runs
from loanlens.llm.queries import QUERIES


def direct(words):
    """All runs as (start, length, period), by start, then period."""
    n, best = len(words), {}
    for p in range(1, n // 4 + 1):
        x = 0
        while x < n - p:
            end = x
            while end < n - p and words[end] == words[end + p]:
                end += 1
            length = end - x + p
            if end > x and length >= max(6, 4 * p):
                best.setdefault((x, length), p)
            x = end + 1
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def without(words, found):
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in dropped]


def test_z_function():
    random.seed(1)
    for _ in range(200):
        s = random.choices([0, 1], k=random.randint(0, 30))
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert runs.z_function(s) == want


def texts():
    random.seed(2)
    made = []
    for k in range(250):
        words = random.choices([f"w{i}" for i in range(random.choice([1, 2, 3, 500]))], k=random.randint(0, 120))
        for _ in range(random.randint(0, 3)):
            p = random.randint(1, 25)
            block = random.choices(["a", "b", "c", f"d{k}"], k=p)
            repeat = (block * 9)[: int(p * random.uniform(2.5, 8))]
            at = random.randint(0, len(words))
            words[at:at] = repeat
        made.append(words)
    return made


def test_tiles_find_every_run():
    for words in texts():
        found = runs.whole_fragments(runs.numbered(words))
        assert sorted((s, e - s + p, p) for p, s, e in found) == sorted(direct(words)), words


EDGES = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "a  a\ta\na\x0ba\x0ca\rb", "x y z w " * 5, "ab " * 3000]


@pytest.mark.parametrize("sizes", [{}, {"long": 0, "span": 1}, {"long": 20, "span": 16}])
def test_operator_equals_direct_search(spark, frame, sizes):
    cases = [" ".join(w) for w in texts()[:80]] + EDGES + ["same text " * 4] * 3
    docs = frame([(i % 70 if i else None, t) for i, t in enumerate(cases)]).withColumnsRenamed({"name": "_row", "offset": "n"})
    got = runs.periodic_runs(docs, **sizes)
    assert got.columns == [c for c in docs.columns if c != "text"] + ["runs", "collapsed"]
    want = []
    for i, t in enumerate(cases):
        words = [w for w in (t or "").encode().split()]
        found = direct(words)
        want.append((i % 70 if i else None, tuple(found), b" ".join(without(words, found)).decode()))
    rows = [(r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_empty_table_and_text_alone(spark, frame):
    docs = frame([(1, "a " * 6)])
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    assert runs.periodic_runs(docs.select("text")).first().collapsed == "a"


def test_query_equals_direct_search_on_a_sample_of_ids(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op12_tiled_runs"](spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for doc, text in texts:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found, row = direct(runs.numbered(words).tolist()) if n < 600 or h % 10 == 0 else None, got[doc]
        if found is None:
            continue
        top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        assert (row.n_runs, row.start, row.length, row.period) == (len(found), *top)
        assert row.exponent_milli == (1000 * top[1] // top[2] if found else None)
        assert row.runs_sha256 == sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
        assert row.collapsed_sha256 == sha256(b" ".join(without(words, found))).hexdigest()
    assert np.mean([r.n_runs > 0 for r in got.values()]) > 0.05
