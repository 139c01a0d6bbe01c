import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loanlens.llm import jaccard, shingles
from loanlens.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    first = {i: i for i, _ in rows}
    links = {i: 0 for i, _ in rows}

    def root(x):
        while first[x] != x:
            x = first[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                links[i] += 1
                links[j] += 1
                low, high = sorted((root(i), root(j)))
                first[high] = low
    return {i: (len(s), root(i), links[i]) for i, s in sets}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for n in (5, 6, 7, 8, 9, 10, 12, 14, 20, 40, 120):
        base = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 1 + n // 20)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], ["new" + str(rng.random())], [words[at], "more"]])
            texts.append(" ".join(words))
    for _ in range(80):  # unlike texts that share a passage
        own = [rng.choice(vocabulary) for _ in range(rng.randint(10, 60))]
        texts.append(" ".join([*own, *passage]))
    texts += [texts[0]] * 40 + [None, "", " \t\n", "One", "one", "one two", "é É", "É é"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def results(df, links=False):
    found = jaccard.similarity_classes(df, links=links).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, *((r.n_links,) if links else ())) for r in found}


def test_overlap_is_the_exact_bound():
    for a in range(1, 60):
        for b in range(1, 60):
            least = min((o for o in range(1, min(a, b) + 1) if 100 * o >= 80 * (a + b - o)), default=None)
            assert (least is not None) == (b in jaccard.partners(a))
            assert least in (None, jaccard.overlap(a, b))


def test_sketches_never_exceed_the_difference():
    rng = np.random.RandomState(1)
    for _ in range(200):
        common = rng.randint(0, 2**62, rng.randint(0, 400)).astype(np.uint64)
        sets = [np.unique(np.append(common, rng.randint(0, 2**62, rng.randint(1, 300)).astype(np.uint64))) for _ in "ab"]
        a, b = (shingles.sketches(s, np.array([len(s)]))[0] for s in sets)
        assert shingles.differing(a, b) <= len(np.setxor1d(*sets))


def test_sets_have_the_contract_sizes():
    texts = [t for _, t in corpus(0)]
    sizes = np.concatenate([s for _, _, s in shingles.shingle_sets(pa.array(texts, pa.string()))])
    assert sizes.tolist() == [len(shingle_set(t)) for t in texts]


@pytest.mark.parametrize("links", [False, True])
@pytest.mark.parametrize("seed, run, family, task", [(1, 50, 4000, 1_000_000), (2, 3, 4000, 1_000_000), (3, 3, 6, 2_000), (4, 2, 3, 300)])
def test_equals_brute_force(frame, monkeypatch, seed, run, family, task, links):
    """With short runs, with long ones, with hot lists, and with blocks that are cut in parts."""
    monkeypatch.setattr(jaccard, "RUN", run)
    monkeypatch.setattr(jaccard, "FAMILY", family)
    monkeypatch.setattr(jaccard, "TASK", task)
    rows = corpus(seed)
    assert results(frame(rows), links) == {i: r if links else r[:2] for i, r in brute(rows).items()}


def test_links_of_light_sets_are_found_by_subsets_alone(frame, monkeypatch):
    """Five-word shingles of eight and nine words: sets of four and five that share four."""
    rng = random.Random(7)
    rows = []
    for i in range(40):
        words = [f"u{i}w{k}" for k in range(8)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join([*words, "end"])), (3 * i + 2, " ".join(["other", *words[:7]]))]
    rng.shuffle(rows)
    histogram = {4: 80, 5: 40}
    assert jaccard.boundary(histogram) >= 5
    monkeypatch.setattr(jaccard, "_near", lambda batches: iter(()))
    monkeypatch.setattr(jaccard, "_verified", lambda docs, candidates: candidates.select("name", candidates.name.alias("root")).limit(0))
    assert results(frame(rows)) == {i: r[:2] for i, r in brute(rows).items()}
    assert any(r[1] != i for i, r in brute(rows).items())


def test_near_copies_are_joined_without_comparing_all(frame, monkeypatch):
    """A family hangs together after a few of its sets have been scanned."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(80)]
    texts = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(80)] = f"new{i}"
        texts.append(" ".join(words))
    table = pa.table({"text": texts})
    hashes, sizes = map(np.concatenate, zip(*[(h, s) for _, h, s in shingles.shingle_sets(table["text"].combine_chunks())]))
    names = shingles.set_ids(hashes, sizes).view(np.int64)
    table = pa.table({"text": texts, "name": names, "block": np.zeros(300, np.int64), "known": names, "ask": np.ones(300, bool)})
    asked = []
    real = np.bincount
    monkeypatch.setattr(jaccard.np, "bincount", lambda *a, **k: asked.append(1) or real(*a, **k))
    found = jaccard._joined(table)
    monkeypatch.undo()
    assert len(set(found["root"].to_pylist())) == 1 and len(asked) < 40


def test_edges(frame):
    assert results(frame([])) == {}
    long = "a b c d e f g " * 60_000
    rows = [(1, long), (2, long + "x"), (3, None), (3, None), (4, "p q"), (4, "p q"), (None, "p q")]
    got = jaccard.similarity_classes(frame(rows), links=True).collect()
    by = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.n_links) for r in got if r.doc_id != 1 and r.doc_id != 2)
    assert by == [(-1, 1, None, 0), (3, 0, 3, 0), (3, 0, 3, 0), (4, 1, 4, 1), (4, 1, 4, 1)]


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 4999)]
    random.Random(4).shuffle(edges)
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 4999: 4999, 5000: 4999}
