"""Forests counted over blocks of rows, and searches that grow all their trees in the same passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.operators import packed, search, trees
from loanlens.session import settle

SIZES = [3, 3, 4, 40, 66, 9, 66]


@pytest.fixture(scope="module")
def few_rows(spark):
    """Binned rows of a made table, on several partitions and in memory."""
    rng = np.random.default_rng(8)
    rows = [(i, *(float(rng.integers(0, n)) for n in (2, 3, 30, 300, 300)), None if i % 9 == 0 else float(rng.random()), i % 3, int(rng.random() < 0.3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double, e double, g double, fold int, y int")
    bins = trees.fit_bins(df, ["a", "b", "c", "d", "e", "g"], sizes=(60,))
    table = settle(trees.binned(df, bins, "k", "y", keep=["fold"]).repartition(3))
    return table, bins, trees.sent_rows(table, bins, ["fold"]).value


@pytest.mark.parametrize("levels", [0, 1, 4, 9])
def test_sums_counted_over_blocks(levels):
    """Those of a plain histogram, below and above the levels that are passed at once."""
    rng = np.random.default_rng(levels)
    sizes, n = np.array(SIZES), 5000
    x = np.stack([rng.integers(0, size, n) for size in SIZES]).astype(np.uint8)
    y, weight = rng.random(n) < 0.3, rng.integers(1, 4, n).astype(float)
    tree = trees.Tree(0)
    tree.add(0, (0.0, 0.0), 66)
    for node in range(2**levels - 1):
        if node >= len(tree.left):
            break
        if node % 7 == 5 or tree.depth[node] == levels:
            continue
        tree.feature[node], tree.route[node] = int(rng.integers(0, 7)), rng.random(66) < 0.5
        tree.left[node], tree.right[node] = (tree.add(tree.depth[node] + 1, (0.0, 0.0), 66) for _ in range(2))
    nodes = [i for i, d in enumerate(tree.depth) if d == levels]
    columns = np.sort(np.argsort(rng.random((len(nodes), 7)), axis=1)[:, :4], axis=1)
    ahead = trees.Ahead(trees.Params(kind="gini"), 0, levels, np.array(tree.feature, np.int16), np.packbits(np.array(tree.route), axis=1),
                        np.array(tree.left, np.int32), np.array(nodes, np.int32), columns.astype(np.int16))
    few, whole = packed.combined(x, sizes), ahead.whole(66)
    assert few.columns == [0, 1, 2]
    at, ranges = packed.layout(columns, sizes, few), [(0, 1200), (2000, n)]
    for w in (weight, None):
        got = packed.count(packed.sample(x, sizes, few, few.code, y, w), whole, packed.masks(whole), at, sizes, ranges)
        inside = np.r_[0:1200, 2000:n]
        position = np.full(len(tree.left), -1)
        position[nodes] = np.arange(len(nodes))
        place = position[tree.place(x.T[inside].astype(np.int16))]
        counts = np.ones(n) if w is None else w
        want = trees.histogram(x.T[inside].astype(np.int16), place, (counts[inside] * y[inside], counts[inside]), columns, 66)
        here = np.arange(66) < sizes[columns][..., None]
        assert np.array_equal(np.column_stack([got[:, 1], got.sum(1)]), want[here])
        assert np.array_equal(packed.widened(packed.pa.scalar(packed.narrow(got).tobytes(), packed.pa.binary()), got.size), got.ravel())


def test_forests_of_weights_and_shares(few_rows):
    """Weights that are no whole numbers, labels between 0 and 1, weighted ones, two fold columns."""
    table, bins, _ = few_rows
    odd = settle(table.withColumn("w", F.col("w") * 0.375 + F.col("fold")).withColumn("other", 2 - F.col("fold")))
    shares = settle(odd.withColumn("y", F.when(F.col("fold") == 2, 0.25).otherwise(F.col("y"))))
    plain = trees.forest(6, numTrees=2, maxDepth=8, subsamplingRate=0.7)
    for frame in (odd, shares):
        rows = trees.sent_rows(frame, bins, ["fold", "other"]).value
        plans = [trees.replace(plain, fold=(c, k), ones=o) for c, k, o in (("fold", 0, 1.0), ("fold", 2, 1.0), ("other", 1, 3.0))]
        far = trees.grow(plans, bins, trees.measure_on_spark(frame, bins))
        near = trees.grow(plans, bins, trees.measure_here(rows, bins))
        for a, b in zip(far, near):
            assert any(len(t.left) > 60 for t in b.trees)
            assert np.abs(trees.raw_scores(a, rows.x[0]) - trees.raw_scores(b, rows.x[0])).max() < 1e-9


def test_a_search_in_passes_grows_its_plans_together(few_rows, monkeypatch):
    """All folds of all boosted settings share passes, as do forests of the same rows; settings
    of other least gains share their trees. Rows are packed once."""
    table, bins, _ = few_rows
    passes, packs = [], []
    plain, pack = trees.grow_trees, packed.pack
    monkeypatch.setattr(trees, "grow_trees", lambda jobs, *rest: (passes.append(len(jobs)), plain(jobs, *rest)))
    monkeypatch.setattr(packed, "pack", lambda *of: (packs.append(1), pack(*of))[1])
    plans = search.forest_plans({"maxDepth": [2, 7], "maxBins": [60], "numTrees": [1, 3], "impurity": ["gini", "entropy"], "subsamplingRate": [0.4, 0.7]}, [60], 6)
    boosted = search.boosted_plans({"max_depth": [3], "n_estimators": [2], "gamma": [0, 1, 5], "alpha": [0, 1]})
    found = search.over_folds(table, bins, plans, ["fold"], 3, sent=0)
    assert passes == [2 * 3 * 3] * 2 and packs == [1]
    passes.clear()
    found_boosted = search.over_folds(table, bins, boosted, ["fold"], 3, sent=0)
    assert len(passes) == 2 and passes[0] == 2 * 3 and packs == [1]
    for mine, of in ((found, plans), (found_boosted, boosted)):
        here = search.over_folds(table, bins, of, ["fold"], 3)
        assert mine.settings == here.settings and np.allclose(mine.means, here.means, atol=1e-3 if of is boosted else 1e-9)


def test_margins_of_one_search_column_are_not_read_by_the_next(few_rows, monkeypatch):
    table, bins, _ = few_rows
    frame = settle(table.withColumn("other", 2 - F.col("fold")))
    monkeypatch.setattr(trees, "LAG", 2)
    measures, plain = [], trees.measure_on_spark
    monkeypatch.setattr(trees, "measure_on_spark", lambda *of: (measures.append(1), plain(*of))[1])
    plans = search.boosted_plans({"max_depth": [2], "n_estimators": [5], "gamma": [0, 1], "alpha": [0, 1]})
    assert [len(of) for of in search._together(plans)] == [2, 2]
    passes = search.over_folds(frame, bins, plans, ["fold", "other"], 3, sent=0)
    # One for forests, one for each family and column of folds.
    assert len(measures) == 1 + 2 * 2
    here = search.over_folds(frame, bins, plans, ["fold", "other"], 3)
    assert passes.settings == here.settings and np.allclose(passes.means, here.means, atol=1e-3)
