"""Trees, forests, boosting and searches: against plain searches, Spark's own trees, direct
fits, and the same rows in memory and in passes."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loanlens import settings
from loanlens.operators import evaluate, logit, models, prep, quantiles, search, trees, windows
from loanlens.session import settle

NUMBERS = ["AMT_CREDIT", "AMT_ANNUITY", "CNT_CHILDREN", "AMT_GOODS_PRICE"]
CATEGORIES = ["CODE_GENDER", "OCCUPATION_TYPE"]


@pytest.fixture(scope="module")
def grown(app):
    """Binned rows with gaps and categories, on several partitions and in memory."""
    df = prep.stratified_folds(app, "TARGET", "SK_ID_CURR", k=3, repeats=1)
    bins = trees.fit_bins(df, NUMBERS, CATEGORIES, sizes=(12, 30))
    table = settle(trees.binned(df, bins, "SK_ID_CURR", "TARGET", keep=["SK_ID_CURR", "fold_1"]).repartition(5))
    return table, bins, trees.sent_rows(table, bins, ["fold_1"]).value


PLANS = [
    trees.boosted(**settings.BOOSTED_PUBLISHED | {"num_round": 2, "num_parallel_tree": 2}),
    trees.boosted(max_depth=6, grow_policy="lossguide", max_leaves=7, num_round=3, gamma=0.5, alpha=0.3, lambda_=2.0),
    trees.boosted(max_depth=3, min_child_weight=5, num_round=2, scale_pos_weight=12),
    trees.forest(6, numTrees=4, maxDepth=6, impurity="entropy", subsamplingRate=0.4, x=1),
    trees.forest(6, numTrees=1, maxDepth=5),
    trees.Params(kind="gini", trees=3, depth=4, random_cuts=True, columns_by_node=0.5, fold=("fold_1", 1)),
]


@pytest.mark.parametrize("p", PLANS, ids=range(len(PLANS)))
def test_passes_over_a_table_grow_the_trees_that_rows_in_memory_do(grown, p):
    table, bins, rows = grown
    far = trees.grow([p], bins, trees.measure_on_spark(table, bins))[0]
    near = trees.grow([p], bins, trees.measure_here(rows, bins))[0]
    assert [t.left for t in far.trees] == [t.left for t in near.trees] and any(len(t.left) > 1 for t in near.trees)
    a, b = (trees.raw_scores(m, rows.x[p.x]) for m in (far, near))
    assert np.abs(a - b).max() < 1e-9
    assert p.leaves == 0 or all((len(t.left) + 1) // 2 <= p.leaves for t in far.trees)
    assert trees.auc(rows.y, a) > 0.7


def test_small_blocks_and_passes_change_nothing(grown, monkeypatch):
    table, bins, rows = grown
    whole = trees.grow(PLANS[:1], bins, trees.measure_here(rows, bins))[0]
    monkeypatch.setattr(trees, "CELLS", 500)
    monkeypatch.setattr(trees, "BLOCK", 100)
    monkeypatch.setattr(trees, "BRANCHES", 2)
    cut = trees.grow(PLANS[:1], bins, trees.measure_on_spark(table, bins))[0]
    assert np.abs(trees.raw_scores(whole, rows.x[0]) - trees.raw_scores(cut, rows.x[0])).max() < 1e-9


def test_one_deep_fit_serves_shallower_and_smaller_ones(grown):
    table, bins, rows = grown
    for make in (lambda d, n: trees.forest(6, numTrees=n, maxDepth=d, subsamplingRate=0.7, seed=5), lambda d, n: trees.boosted(max_depth=3, num_round=n, subsample=0.6)):
        deep = trees.grow([make(8, 6)], bins, trees.measure_here(rows, bins))[0]
        for depth, count in ((2, 3), (5, 6), (8, 4)):
            direct = trees.grow([make(depth, count)], bins, trees.measure_here(rows, bins))[0]
            at = depth if deep.p.kind != "boost" else None
            assert np.array_equal(trees.raw_scores(deep, rows.x[0], at, count), trees.raw_scores(direct, rows.x[0]))


def test_a_tree_equals_sparks_on_columns_of_few_values(app):
    """All columns, no sample, balanced classes; Spark ends a tree where all leaves agree."""
    df = prep.class_weights(app, "TARGET").select(
        "SK_ID_CURR", "TARGET", "classWeights", (F.col("AMT_CREDIT") / 60000).cast("int").alias("a"), F.col("CNT_CHILDREN").alias("b"), F.col("REGION_RATING_CLIENT").alias("c")
    )
    df = settle(prep.assemble(df, ["a", "b", "c"]))
    bins = trees.fit_bins(df, ["a", "b", "c"], sizes=(32,))
    table = settle(trees.binned(df, bins, "SK_ID_CURR", "TARGET", "classWeights", keep=["SK_ID_CURR"]))
    for impurity in ("gini", "entropy"):
        ours = trees.fit(table, bins[0], trees.forest(3, numTrees=1, maxDepth=5, impurity=impurity))
        for depth in (1, 3, 5):
            theirs = DecisionTreeClassifier(labelCol="TARGET", weightCol="classWeights", maxDepth=depth, impurity=impurity).fit(df)
            b = theirs.transform(df).select("SK_ID_CURR", vector_to_array("probability")[1].alias("theirs"))
            both = trees.score(ours, table, ["SK_ID_CURR"], depth=depth, merge=True).join(b, "SK_ID_CURR")
            assert both.where(F.abs(F.col("probability") - F.col("theirs")) > 1e-9).count() == 0


def test_splits_equal_a_search_of_all(spark):
    """Cuts with gaps on either side, and all subsets of categories."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        width, p = 6, trees.boosted(lambda_=float(rng.integers(0, 3)), alpha=float(rng.integers(0, 2)), min_child_weight=0.3)
        hist = np.zeros((1, 2, width, 2))
        cells = rng.normal(size=width), rng.random(width) * (rng.random(width) > 0.3)
        hist[0, 0] = np.where(cells[1] > 0, cells, 0).T
        hist[0, 1] = hist[0, 0][rng.permutation(width)]
        got = trees.best_splits(hist, p, np.array([True, False]), np.array([[0, 1]]), 0, np.array([0]))[0]
        total, found = hist[0, 0].sum(0), []
        worth = lambda s: max(abs(s[0]) - p.l1, 0) ** 2 / (s[1] + p.l2) if s[1] + p.l2 > 0 else 0.0
        sides = [(0, [*gap, *range(1, cut + 1)]) for cut in range(width) for gap in ((), (0,))]
        sides += [(1, list(c)) for k in range(1, width) for c in combinations(range(width), k)]
        for f, left in sides:
            l = hist[0, f][left].sum(0)
            if l[1] >= p.child and total[1] - l[1] >= p.child:
                found.append(worth(l) + worth(total - l) - worth(total))
        best = max(found, default=0.0)
        if p.l1 == 0:
            assert abs(got.gain - max(best, 0.0)) < 1e-9 or best <= trees.LEAST_GAIN
        assert got.gain <= max(best, 0.0) + 1e-9


def test_node_table_and_importance(grown, spark):
    table, bins, rows = grown
    model = trees.fit(table, bins[0], PLANS[0])
    nodes = trees.node_table(model, spark)
    assert nodes.where("left IS NOT NULL AND (rule IS NULL OR gain <= 1)").count() == 0
    assert nodes.select("tree").distinct().count() == len(model.trees)
    found = trees.importance(nodes).collect()
    assert sum(r.splits for r in found) == sum(l >= 0 for t in model.trees for l in t.left)
    assert found[0].splits == max(r.splits for r in found) and all(r.mean_cover > 0 for r in found)
    inside = [r.rule for r in nodes.where("feature = 'OCCUPATION_TYPE'").collect()]
    assert all(rule.startswith("OCCUPATION_TYPE in (") for rule in inside)


def test_unseen_and_missing_values_have_a_way(grown, app):
    table, bins, _ = grown
    model = trees.fit(table, bins[0], PLANS[2])
    odd = app.limit(3).select("SK_ID_CURR", *[F.lit(None).cast("double").alias(n) for n in NUMBERS], *[F.lit("new").alias(c) for c in CATEGORIES])
    scored = trees.score(model, trees.binned(odd, bins[:1], "SK_ID_CURR"), []).collect()
    assert len(scored) == 3 and len({r.raw_score for r in scored}) == 1
    with pytest.raises(ValueError, match="categories"):
        trees.fit_bins(app, [], ["SK_ID_CURR"])


def test_search_sent_and_in_passes_agree(grown, spark):
    table, bins, _ = grown
    plans = search.forest_plans({"maxDepth": [2, 4], "maxBins": [12, 30], "numTrees": [1, 3]}, [12, 30], 6)
    plans += search.boosted_plans({"max_depth": [2], "n_estimators": [1, 2], "grow_policy": ["depthwise", "lossguide"], "lamda": [0, 1]})
    assert len(plans) == 3
    sent = search.over_folds(table, bins, plans, ["fold_1"], 3)
    passes = search.over_folds(table, bins, plans, ["fold_1"], 3, sent=0)
    assert sent.settings == passes.settings and len(sent.settings) == 10
    assert np.allclose(sent.means, passes.means) and np.allclose(sent.deviations, passes.deviations)
    model, reading = search.fit_best(table, bins, sent)
    assert sent.means[sent.settings.index(reading.setting)] == max(sent.means)
    again, _ = search.fit_best(table, bins, sent, sent=0)
    assert [t.left for t in model.trees] == [t.left for t in again.trees]
    assert sum(r.is_best for r in search.results(sent, spark).collect()) >= 1


def test_published_grids():
    names = [r.setting for p in search.forest_plans(settings.FOREST_GRID, [20, 60, 100], 9) for r in p.readings]
    assert len(set(names)) == 216
    plans = search.boosted_plans(settings.BOOSTED_GRID)
    assert len(plans) == 972 and sum(len(p.readings) for p in plans) == 2916


def test_exact_order_statistics(spark):
    rng = np.random.default_rng(2)
    values = {"u": rng.random(3000), "few": rng.integers(0, 7, 3000).astype(float), "hot": np.where(rng.random(3000) < 0.4, 5.0, rng.normal(size=3000)), "one": np.full(3000, 2.0)}
    rows = [tuple(None if rng.random() < 0.05 else float(v) for v in row) for row in zip(*values.values())]
    df = spark.createDataFrame(rows + [(float("nan"), None, -0.0, None)] * 3, ", ".join(f"{n} double" for n in values))
    counts = quantiles.counted_values(df, list(values))
    got = {(r["feature"], r["parts"], r["i"]): r["value"] for r in quantiles.order_statistics(counts, [4, 20]).collect()}
    for at, name in enumerate(values):
        known = sorted([r[at] for r in rows if r[at] is not None] + ([0.0] * 3 if name == "hot" else []))
        for m in (4, 20):
            for i in range(1, m):
                assert got[name, m, i] == known[max(1, -(-i * len(known) // m)) - 1]
    cuts = quantiles.cut_points(counts, [20])[20]
    assert cuts["few"] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and cuts["one"] == []
    assert quantiles.counted_values(df.limit(0), ["u"]).count() == 0


@pytest.fixture(scope="module")
def vectors(app):
    train = prep.class_weights(app.na.fill(0.0, ["AMT_INCOME_TOTAL"]), "TARGET")
    df = prep.assemble(train, ["AMT_CREDIT", "AMT_INCOME_TOTAL", "CNT_CHILDREN", "AMT_ANNUITY"])
    return settle(prep.stratified_folds(df.select("SK_ID_CURR", "TARGET", "features", "classWeights"), "TARGET", "SK_ID_CURR", k=3, repeats=1))


@pytest.mark.parametrize("reg, elastic, intercept", [(0.0, 0.0, True), (0.02, 0.5, True), (0.3, 0.0, False), (0.05, 1.0, False)])
def test_logistic_equals_sparks(vectors, reg, elastic, intercept):
    theirs = models.logistic(vectors, regParam=reg, elasticNetParam=elastic, fitIntercept=intercept, maxIter=500, tol=1e-12)
    rows = logit.rows_of(vectors, "TARGET", "classWeights")
    ours = logit.fit_setting(rows, {"regParam": reg, "elasticNetParam": elastic, "fitIntercept": intercept, "maxIter": 100})
    c = theirs.coefficients.toArray()
    assert np.allclose(ours.coefficients, c, rtol=1e-4, atol=1e-4 * np.abs(c).max()) and abs(ours.intercept - theirs.intercept) < 1e-4
    scored = logit.score(ours, vectors, ["SK_ID_CURR"]).join(
        models.score(theirs, vectors, ["SK_ID_CURR"]).select("SK_ID_CURR", F.col("probability").alias("p")), "SK_ID_CURR"
    )
    assert scored.where(F.abs(F.col("probability") - F.col("p")) > 1e-4).count() == 0


def test_logistic_search_equals_single_fits(vectors):
    grid = {"regParam": [0.0, 0.1], "elasticNetParam": [0.0, 1.0], "maxIter": [1, 100]}
    rows = logit.rows_of(vectors, "TARGET", "classWeights", "fold_1")
    found, by_name = logit.search(rows, grid, 3)
    assert len(found.settings) == 8 and set(by_name) == set(found.settings)
    for name in (found.settings[0], found.settings[-1]):
        single = []
        for k in range(3):
            model = logit.fit_setting(logit.rows_of(vectors.where(F.col("fold_1") != k), "TARGET", "classWeights"), by_name[name])
            scored = logit.score(model, vectors.where(F.col("fold_1") == k), ["TARGET"])
            single.append(evaluate.roc_auc(windows.running_class_counts(scored, "raw_score", "TARGET")).head()[0])
        assert abs(np.mean(single) - found.means[found.settings.index(name)]) < 1e-6


def test_counts_by_group_equal_counts_of_each(spark):
    rng = np.random.default_rng(6)
    rows = [(["a", "b", None][k % 3], float(rng.integers(0, 40 if k % 3 else 900)), int(rng.random() < 0.3)) for k in range(3000)]
    df = spark.createDataFrame(rows, "m string, s double, y int")
    both = settle(windows.running_class_counts(df, "s", "y", buckets=5, by=["m"]))
    for m in ("a", "b", None):
        same = F.col("m").eqNullSafe(F.lit(m))
        alone = windows.running_class_counts(df.where(same), "s", "y")
        mine = both.where(same).drop("m")
        assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, mine.collect()))
        assert evaluate.roc_auc(both, ["m"]).where(same).head().auc == evaluate.roc_auc(alone).head().auc
        assert tuple(evaluate.best_threshold(both, ["m"]).where(same).head())[1:] == tuple(evaluate.best_threshold(alone).head())
        assert evaluate.roc_curve(both, ["m"]).where(same).count() == evaluate.roc_curve(alone).count()


def test_settings_of_other_least_gains_share_their_trees(grown, monkeypatch):
    """Equal to fits of their own, and as long as no split gains too little grown once."""
    table, bins, rows = grown
    grown_trees, plain = [], trees.grow_trees
    monkeypatch.setattr(trees, "grow_trees", lambda jobs, *rest: (grown_trees.append(len(jobs)), plain(jobs, *rest)))
    for ones in (92.0, 1.0):
        plans = [trees.boosted(max_depth=4, num_round=4, gamma=g, scale_pos_weight=ones, subsample=0.8) for g in (5.0, 0.0, 1.0)]
        assert trees.differ_in_gain([*plans, PLANS[1]]) == [[0, 1, 2], [3]]
        grown_trees.clear()
        shared = trees.grow_alike(plans, bins, trees.measure_here(rows, bins))
        assert grown_trees[0] == 1 and sum(grown_trees) < 12
        for p, model in zip(plans, shared):
            alone = trees.grow([p], bins, trees.measure_here(rows, bins))[0]
            assert [(t.left, t.feature, t.sums) for t in model.trees] == [(t.left, t.feature, t.sums) for t in alone.trees]


def test_columns_added_up_together_have_their_own_sums():
    rng = np.random.default_rng(3)
    sizes = [6, 65, 3, 65, 12, 65]
    x = np.column_stack([rng.integers(0, n, 20000) for n in sizes]).astype(np.int16)
    node, stats = rng.integers(-1, 3, len(x)), (rng.integers(-9, 9, len(x)).astype(float), rng.integers(1, 5, len(x)).astype(float))
    columns = np.broadcast_to(np.array([5, 0, 1, 2, 4]), (3, 5))
    joint = trees.joint_cells(x, columns[0], sizes)
    assert len(joint) < len(sizes) and sorted(j for g in joint for j in g.places) == list(range(5))
    together = trees.histogram(x, node, stats, columns, 66, joint)
    assert np.array_equal(together, trees.histogram(x, node, stats, columns, 66))
    ones = (stats[1] * (stats[0] > 0), stats[1])
    got = trees.histogram(x, node, ones, columns, 66)
    for j, c in enumerate(columns[0]):
        for n in range(3):
            for s in (0, 1):
                assert np.array_equal(together[n, j, :, s], np.bincount(x[node == n, c], stats[s][node == n], 66))
                assert np.array_equal(got[n, j, :, s], np.bincount(x[node == n, c], ones[s][node == n], 66))


def test_passes_read_margins_beside_the_rows(grown, monkeypatch):
    """A pass walks the trees since the margins were written, not all of them."""
    table, bins, rows = grown
    p = trees.boosted(max_depth=2, num_round=6, num_parallel_tree=3, subsample=0.7)
    monkeypatch.setattr(trees, "LAG", 4)
    written, plain = [], trees._with_margins
    monkeypatch.setattr(trees, "_with_margins", lambda t, jobs, b, done: (written.append([len(j.before) - done.get(id(j.p), (0, 0))[1] for j in jobs]), plain(t, jobs, b, done))[1])
    far = trees.grow([p], bins, trees.measure_on_spark(table, bins))[0]
    assert written == [[6], [6]]
    near = trees.grow([p], bins, trees.measure_here(rows, bins))[0]
    assert np.abs(trees.raw_scores(far, rows.x[0]) - trees.raw_scores(near, rows.x[0])).max() < 1e-9


def test_scores_at_readings_equal_scores_of_each(grown):
    _, bins, rows = grown
    readings = [(d, n) for d in (2, 4, 7) for n in (1, 3, 5, 9)]
    for p, at in ((trees.forest(6, numTrees=5, maxDepth=7, subsamplingRate=0.7), readings), (trees.boosted(max_depth=3, num_round=5), [(None, n) for n in (1, 3, 5, 9)])):
        model = trees.grow([p], bins, trees.measure_here(rows, bins))[0]
        for found, (depth, count) in zip(trees.scores_at(model, rows.x[0], at), at):
            assert np.array_equal(found, trees.raw_scores(model, rows.x[0], depth, count))


def test_cuts_without_counting_all_values(spark, monkeypatch):
    """The cuts of a shuffle of all values, from three passes that shuffle few of them."""
    monkeypatch.setattr(quantiles, "POINTS", 16)
    rng = np.random.default_rng(3)
    n = 4000
    values = {"u": rng.random(n), "few": rng.integers(0, 7, n) - 3.0, "hot": np.where(rng.random(n) < 0.6, 5.0, rng.normal(size=n)), "one": np.full(n, 2.0), "none": np.full(n, np.nan), "far": rng.standard_cauchy(n) ** 3}
    rows = [tuple(None if rng.random() < 0.05 else float(v) for v in row) for row in zip(*values.values())] + [(float("inf"), -0.0, None, None, None, float("-inf"))] * 2
    df = spark.createDataFrame(rows, ", ".join(f"{name} double" for name in values)).repartition(5)
    counts = quantiles.counted_values(df, list(values))
    for lower in (False, True):
        assert quantiles.column_cuts(df, list(values), [4, 20, 60], lower) == quantiles.cut_points(counts, [4, 20, 60], lower)
    assert quantiles.column_cuts(df.limit(0), ["u"], [20]) == {20: {}}


def test_areas_by_ranges(spark):
    rng = np.random.default_rng(4)
    n = 3000
    s = np.round(rng.normal(size=n), 2)
    s[:40], s[40:50], s[50:60] = np.nan, np.inf, -0.0
    y, fold = (rng.random(n) < 0.3 + 0.1 * (s > 0)).astype(float), rng.integers(0, 3, n)
    fold[y == 0] = np.minimum(fold[y == 0], 1)  # the last fold has ones only
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(y, fold, s)], "y double, fold int, s double").repartition(4)

    def scores(batch):
        values = batch["s"].combine_chunks().to_numpy()
        return batch["y"].combine_chunks().to_numpy(), batch["fold"].combine_chunks().to_numpy(), np.column_stack([values, -values])

    asked = df.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("model")).withColumn("v", F.when(F.col("model") == 0, F.col("s")).otherwise(-F.col("s")))
    theirs = evaluate.roc_auc(windows.running_class_counts(asked, "v", "y", by=["model", "fold"]), ["model", "fold"]).collect()
    wanted = {(r["model"], r["fold"]): r["auc"] for r in theirs}
    for most in (200, None):
        assert {(a.model, a.group): a.auc for a in evaluate.areas(df, scores, most)} == wanted


def test_passes_read_even_files_and_count_columns_once(spark, monkeypatch):
    """Many trees of many nodes: their columns are drawn a few times per tree and level, and no
    task of a pass reads most of the rows."""
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.integers(0, 30)), float(rng.integers(0, 30)), float(rng.integers(0, 30)), int(rng.random() < 0.4)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y int").coalesce(1)
    bins = trees.fit_bins(df, ["a", "b", "c"])
    table = settle(trees.binned(df, bins, "k", "y"), evenly=True)
    sizes = [r["n"] for r in table.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * min(sizes)
    made, columns = [], trees.columns_of
    monkeypatch.setattr(trees, "columns_of", lambda *of: made.append(1) or columns(*of))
    p = trees.Params(kind="gini", trees=20, depth=4, columns_by_node=0.5, child=0.0, replace=True)
    passes = trees.fit(table, bins[0], p, most=0)
    assert len(made) <= 3 * 20 * 4
    here = trees.fit(table, bins[0], p)
    assert [t.left for t in passes.trees] == [t.left for t in here.trees]
