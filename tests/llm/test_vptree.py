import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.llm import vptree

SCHEMA = "vec_id bigint, embedding array<float>, leaf string, score int"


def brute(rows, queries, k):
    usable = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in usable:
        if i in queries:
            near = []
            for j, w in usable:
                if j != i:
                    total = 0.0
                    for a, b in zip(v, w):
                        total += (a - b) * (a - b)
                    near.append((float(np.sqrt(total)), j))
            out[i] = sorted(near)[:k]
    return out


def found(df, queries, k, factor):
    rows = vptree.nearest(df, df.where(F.col("vec_id").isin(queries)), k=k, factor=factor).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.fixture
def small_shards(monkeypatch):
    for name, value in (("SHARD_ROWS", 40), ("LEAF", 8), ("QUERY_ROWS", 3)):
        monkeypatch.setattr(vptree, name, value)


def test_factor_one_is_exact_over_many_shards(spark, small_shards):
    rng = np.random.RandomState(5)
    centres = rng.normal(size=(6, 5)) * 3
    rows = [(i, [float(x) for x in np.float32(centres[i % 6] + rng.normal(size=5))]) for i in range(600)]
    rows += [(i, rows[0][1]) for i in range(600, 760)]  # a hot vector
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    queries = list(range(0, 760, 40))
    want = brute(rows, queries, 10)
    assert found(df, queries, 10, 1.0) == want
    near = found(df, queries, 10, 0.5)
    hits = sum(len(set(near[q]) & set(want[q])) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_edges(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, []),
        (6, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [float("inf"), 0.0]), (9, [0.5, 0.5]),
    ]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in [*rows, (None, [1.0, 1.0])]], SCHEMA)
    assert found(df, [0, 1, 2, 6], 10, 1.0) == brute(rows, [0, 6], 10)
    assert found(df.limit(0), [0], 10, 1.0) == {}
    doubled = df.union(df)
    assert found(doubled, [0], 10, 1.0) == brute(rows, [0], 10)


@pytest.mark.parametrize("trees", [64 << 20, 2_000])
def test_shards_are_parted_until_they_are_small(spark, small_shards, monkeypatch, trees):
    """Routed by a tree on few vectors; each oversized shard gets trees of its own, so that
    what a query meets does not grow with the rows."""
    for name, value in (("SAMPLE", 64), ("SHARD_SAMPLE", 48), ("TREES", trees)):
        monkeypatch.setattr(vptree, name, value)
    levels, met = [], {}
    real = vptree.level_of
    monkeypatch.setattr(vptree, "level_of", lambda *a: levels.append(real(*a)) or levels[-1])
    for n in (700, 4000) if trees > 2_000 else (700,):
        levels.clear()
        rng = np.random.RandomState(3)
        rows = [(i, [float(x) for x in np.float32(rng.normal(size=3))]) for i in range(n)]
        df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
        queries = list(range(0, n, n // 14))
        assert found(df, queries, 5, 1.0) == brute(rows, queries, 5)
        assert any(levels) and (trees > 2_000 or levels[0].blocks > 1)
        met[n] = sum(level is not None for level in levels)
    assert trees == 2_000 or met[4000] >= met[700]


def test_equal_distances_cannot_be_parted(spark, small_shards, monkeypatch):
    monkeypatch.setattr(vptree, "SAMPLE", 64)
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(400)] + [(400 + i, [float(i), 0.5]) for i in range(30)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    assert found(df, [0, 1, 400], 10, 1.0) == brute(rows, [0, 1, 400], 10)
