import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from loanlens.llm import langid
from loanlens.llm.queries import QUERIES


def summed(word, probability, pieces):
    """Probability of a word by listing all its segmentations."""
    word, total = "▁" + word, 0.0
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        parts, last = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                parts.append(word[last:i])
                last = i
        parts.append(word[last:])
        p = 1.0
        for part in parts:
            if part in pieces:
                p *= probability[pieces.index(part), 0]
            else:
                p *= probability[len(pieces), 0] if len(part) == 1 else 0
        total += p
    return total


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "ab", "b", "abc", "c", "▁ab"]
    probability = np.linspace(0.01, 0.2, len(pieces) + 1)[:, None]
    words = ["abc", "a", "bca", "zab", "cc", "aabbcc"]
    got = langid.Lattice(words, langid.Pieces(pieces)).log_probabilities(probability)
    want = [np.log(summed(w, probability, pieces)) for w in words]
    assert np.allclose(got[:, 0], want)


def test_runs_longer_than_a_window(monkeypatch):
    pieces = ["▁", "▁a", "a", "ab", "b", "abc", "c", "▁ab", "bcab"]
    probability = np.stack([np.linspace(0.01, 0.2, len(pieces) + 1), np.linspace(0.1, 0.02, len(pieces) + 1)], 1)
    words = ["abcabcabcab", "a", "", "bca", "zabcab" * 2, "abcabz", "cccc"]
    for window in (1, 2, 3, 5, 30):
        monkeypatch.setattr(langid, "WINDOW", window)
        got = langid.run_log_probabilities(words, langid.Pieces(pieces), probability)
        for lang in range(2):
            want = [np.log(summed(w, probability[:, lang : lang + 1], pieces)) for w in words]
            assert np.allclose(got[:, lang], want)
    # Far below the smallest number, and without a cut: a run of no end is one word.
    (long,) = langid.run_log_probabilities(["ab" * 50_000], langid.Pieces(["▁", "a", "b"]), np.full((4, 1), 1e-4))
    assert np.isclose(long[0], 100_001 * np.log(1e-4))
    assert langid.words_of("É" * 500 + " x1y") == ["é" * 500, "x", "y"]


def test_query_against_all_segmentations(frame, monkeypatch):
    """Estimates, sums and scores of small documents, by listing every segmentation."""
    pieces = ["▁", "▁a", "a", "ab", "b", "c", "ca", "▁d"]
    monkeypatch.setattr(langid, "vocabulary", lambda path: pieces)
    monkeypatch.setattr(langid, "WINDOW", 4)
    docs = [(i, t, g) for i, (t, g) in enumerate(
        [("ab ab a", "x"), ("abab b", "x"), ("ca d", "y"), ("cada ac", "y"), ("dca", "y"), ("aba bac", "x"), ("caca", "y"), ("abd", "x"), ("zab", "x"), ("dd cc ab", "y")]
    )]
    df = frame([(i, t) for i, t, _ in docs])
    of = F.create_map(*[F.lit(v) for i, _, g in docs for v in (i, g)])
    df = df.withColumn("lang", of[F.col("doc_id")]).withColumn("_next", F.lit(3))

    def ways(word, p):
        """(probability, pieces) of each segmentation."""
        word = "▁" + word
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            ends = [i for i, c in enumerate(cuts, 1) if c] + [len(word)]
            parts = [word[b:e] for b, e in zip([0, *ends], ends)]
            if all(x in pieces or len(x) == 1 for x in parts):
                used = [pieces.index(x) if x in pieces else len(pieces) for x in parts]
                yield np.prod(p[used]), used

    taught = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 4 != 2]
    model, prior = {}, {}
    for lang in ("x", "y"):
        mine = [w for _, t, g in taught if g == lang for w in t.split()]
        prior[lang] = np.mean([g == lang for _, _, g in taught])
        p = np.full(len(pieces) + 1, 1 / (len(pieces) + 1))
        for _ in range(langid.ROUNDS):
            counts = np.zeros(len(p))
            for word in mine:
                all_ways = list(ways(word, p))
                for mass, used in all_ways:
                    np.add.at(counts, used, mass / sum(m for m, _ in all_ways))
            p = (counts + langid._SMOOTH) / (counts.sum() + langid._SMOOTH * len(p))
        model[lang] = p
    assert 0 < len(taught) < len(docs)
    got = {r.doc_id: r for r in langid.identified(df).collect()}
    for i, text, _ in docs:
        mass = {g: prior[g] * np.prod([sum(m for m, _ in ways(w, model[g])) for w in text.split()]) for g in model}
        best = max(mass, key=mass.get)
        assert got[i]._language.lang_pred == best and got[i]._next == 3
        assert np.isclose(got[i]._language.score, mass[best] / sum(mass.values()), rtol=1e-3)


def test_expected_counts_add_up():
    pieces = langid.Pieces(["▁", "a", "b", "ab", "▁a"])
    probability = np.full((6, 1), 0.1)
    counts = langid.Lattice(["ab"], pieces).expected(probability, np.array([[2.0]]))[:, 0]
    # Letters that the pieces cover, the start mark included: three for each of two words.
    assert np.isclose(counts @ [1, 1, 1, 2, 2, 1], 6)


def test_accuracy_on_held_out_documents(spark, sf_dir):
    rows = QUERIES["op4_marginal_language"](spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(frame, spark):
    texts = [(0, None), (1, ""), (2, "12 ½ ---"), (3, "漢" * 50_000 + " the word " * 20), (4, "the word " * 100_000), (5, "the"), (5, "the"), (None, "x")]
    df = frame(texts).withColumn("lang", F.when(F.col("doc_id") > 2, F.col("lang")))
    got = langid.identified(df).collect()
    assert len(got) == len(texts) and got[0].source == "s"
    by = {r.doc_id: r._language for r in got}
    assert [by[i].lang_pred for i in range(6)] == ["und"] * 3 + ["en"] * 3
    assert by[0].score == 0
    unlabelled = langid.identified(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r._language.lang_pred for r in unlabelled} == {"und"}
    assert langid.identified(df.limit(0)).collect() == []


def test_more_labels_than_are_held_at_once(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.lang for r in docs.select("lang").distinct().collect()} - {None}

    def found():
        return sorted((r.doc_id, r._language.lang_pred, round(r._language.score, 6)) for r in langid.identified(docs).collect())

    whole = found()
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    assert len(labels) > 2 and found() == whole
    assert {lang for _, lang, _ in whole} - {langid.UNKNOWN} == labels
