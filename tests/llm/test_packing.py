from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from loanlens.llm import packing
from loanlens.llm.common import word_count

ROWS = [(1, "a b c"), (2, None), (3, ""), (4, "x " * 100_000), (5, "a b c"), (5, "a b c"), (None, "q")]


def padding(lengths, counts, bounds):
    return sum((min(b for b in bounds if b >= n) - n) * c for n, c in zip(lengths, counts))


def test_boundaries_are_the_best_of_all_choices():
    rng = np.random.RandomState(3)
    for _ in range(30):
        size = rng.randint(1, 9)
        lengths = np.sort(rng.choice(60, size, replace=False))
        counts = rng.randint(1, 20, size)
        for buckets in (1, 2, 3, 9):
            got = packing.optimal_boundaries(lengths, counts, buckets)
            most = min(buckets, size) - 1
            best = min(
                padding(lengths, counts, [*c, lengths[-1]]) for c in combinations(lengths[:-1], most)
            )
            assert len(got) == most + 1 and padding(lengths, counts, got) == best


def test_edges_and_whole_texts(frame):
    rows = packing.pack_buckets(
        frame(ROWS), "doc_id", word_count(F.col("text")), max_len=1000, buckets=3, budget=4000
    ).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sorted(r.start_token for r in by_doc[4]) == [1000 * i for i in range(100)]
    assert sum(r.n_tokens for r in by_doc[4]) == 100_000
    assert len(by_doc[5]) == 2 and len(by_doc[None]) == 1
    assert [r.n_tokens for r in by_doc[2] + by_doc[3]] == [0, 0]
    batches = {}
    for r in rows:
        assert r.n_tokens <= r.bucket_tokens
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for group in batches.values():
        assert sorted(r.slot for r in group) == list(range(len(group)))
        assert len(group) * group[0].bucket_tokens <= 4000
    for bucket in {r.bucket for r in rows}:
        numbers = sorted({r.batch for r in rows if r.bucket == bucket})
        assert numbers == list(range(len(numbers)))


def test_empty(frame):
    assert packing.pack_buckets(frame([]), "doc_id", word_count(F.col("text"))).collect() == []
