"""Operators without an SQL counterpart: models, binning, imputation, components."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from loanlens import settings
from loanlens.operators import components, evaluate, impute, models, prep, windows, woe
from loanlens.plans.queries import COMPONENT_COLUMNS, MODEL_CATEGORIES, MODEL_NUMBERS, QUERIES
from loanlens.session import settle


@pytest.fixture(scope="module")
def parts(app):
    train, test = prep.split(app, "SK_ID_CURR")
    train = prep.class_weights(train, "TARGET")
    stages = prep.prep_pipeline(MODEL_CATEGORIES, MODEL_NUMBERS, "TARGET").fit(train)
    keep = ["SK_ID_CURR", "TARGET", "features"]
    return (
        settle(stages.transform(train).select(*keep, "classWeights")),
        settle(stages.transform(test).select(*keep)),
    )


def auc(scored):
    counts = windows.running_class_counts(scored, "raw_score", "TARGET")
    return evaluate.roc_auc(counts).head()[0]


def test_models_rank_well_and_auc_agrees_with_spark(parts):
    train, test = parts
    for model in (
        models.logistic(train, **settings.LOGISTIC_TUNED),
        models.random_forest(train),
        models.boosted_trees(train, **settings.BOOSTED_TUNED),
    ):
        scored = models.score(model, test)
        assert scored.columns == ["TARGET", "raw_score", "probability", "prediction"]
        ours = auc(scored)
        assert ours > 0.7
        sparks = BinaryClassificationEvaluator(labelCol="TARGET", numBins=0).evaluate(model.transform(test))
        assert abs(ours - sparks) < 1e-9


def test_thresholded_decisions(parts):
    train, test = parts
    model = models.logistic(train, **settings.LOGISTIC_QUICK)
    scored = models.score(model, test)
    wrong = scored.where((F.col("probability") > settings.LOGISTIC_THRESHOLD) != (F.col("prediction") == 1))
    assert wrong.count() == 0


def test_boosted_settings_reach_spark():
    estimator = models.boosted_estimator(
        **{k: v for k, v in settings.BOOSTED_TUNED.items() if k != "scale_pos_weight"}
    )
    assert estimator.getStepSize() == 0.075 and estimator.getMaxIter() == 10
    assert estimator.getMinInfoGain() == 1.0
    assert models.boosted_estimator(gamma=1, total_weight=1e6).getMinInfoGain() == 1e-6
    assert estimator.getMaxDepth() == 4 and estimator.getFeatureSubsetStrategy() == "0.7"


def test_search_over_given_and_drawn_folds(parts, spark):
    train, _ = parts
    estimator = LogisticRegression(labelCol="TARGET", weightCol="classWeights", maxIter=5)
    grid = {"regParam": [0.01, 2.0], "threshold": [0.4, 0.6]}
    folded = prep.stratified_folds(train, "TARGET", "SK_ID_CURR", k=2, repeats=1)
    given = models.cross_validate(estimator, grid, folded, folds=2, fold_col="fold_1")
    drawn = models.cross_validate(estimator, grid, train, folds=2)
    for search in (given, drawn):
        assert search.best_model.getThreshold() == 0.4
        assert len(search.settings) == 2 and all(0.5 < mean < 1 for mean in search.means)
        table = models.cv_results(search, spark).collect()
        assert [row.is_best for row in table] == [True, False]
    fold0 = estimator.copy({estimator.regParam: 0.01}).fit(folded.where("fold_1 != 0"))
    fold1 = estimator.copy({estimator.regParam: 0.01}).fit(folded.where("fold_1 != 1"))
    measure = BinaryClassificationEvaluator(labelCol="TARGET").evaluate
    expected = (measure(fold0.transform(folded.where("fold_1 = 0"))) + measure(fold1.transform(folded.where("fold_1 = 1")))) / 2
    assert abs(given.means[given.settings.index("regParam=0.01")] - expected) < 1e-9


def test_boosted_search_covers_weights_and_repeats(parts):
    train, _ = parts
    folded = settle(prep.stratified_folds(train, "TARGET", "SK_ID_CURR", k=2, repeats=2))
    grid = {"scale_pos_weight": [1, 92], "max_depth": [2], "n_estimators": [2], "colsample_bytree": [0.4]}
    found = models.grid_search_boosted(folded, grid, ["fold_1", "fold_2"], 2).collect()
    assert {row.setting.split(",")[0] for row in found} == {"scale_pos_weight=1", "scale_pos_weight=92"}
    assert sum(row.is_best for row in found) == 1 and all(row.sd_auc >= 0 for row in found)


def test_importance_names(parts):
    train, test = parts
    model = models.random_forest(train)
    table = models.feature_importance(model, test).collect()
    assert table[0].feature == "AMT_CREDIT" and abs(sum(r.importance for r in table) - 1) < 1e-9


def test_saved_stages_give_the_same_vectors(app, tmp_path):
    from pyspark.ml import PipelineModel

    fitted = prep.prep_pipeline(["CODE_GENDER"], ["AMT_CREDIT"], "TARGET").fit(app)
    fitted.save(str(tmp_path / "stages"))
    again = PipelineModel.load(str(tmp_path / "stages"))
    a, b = (m.transform(app).orderBy("SK_ID_CURR").select("features").collect() for m in (fitted, again))
    assert a == b


def test_chained_imputation_fills_only_gaps(app):
    cols = ["AMT_CREDIT", "AMT_GOODS_PRICE", "CNT_CHILDREN", "DAYS_EMPLOYED", "DAYS_BIRTH"]
    df = app.select("SK_ID_CURR", *cols)
    got = impute.impute_chained(df, cols, rounds=3)
    assert got.dtypes == df.dtypes and got.count() == df.count()
    assert got.na.drop().count() == df.count()
    both = df.alias("a").join(got.alias("b"), "SK_ID_CURR")
    for name in cols:
        changed = both.where(F.col(f"a.{name}").isNotNull() & (F.col(f"a.{name}") != F.col(f"b.{name}")))
        assert changed.count() == 0


def test_chained_imputation_with_many_columns_and_patterns(spark):
    """Sixty gappy columns of a hundred: far more gap patterns than are listed. The
    columns hang on three hidden numbers, which the others give away."""
    rng = np.random.RandomState(7)
    hidden = rng.normal(size=(800, 3))
    whole = hidden @ rng.normal(size=(3, 100)) + 0.01 * rng.normal(size=(800, 100))
    holes = (rng.rand(800, 100) < 0.1) & (np.arange(100) < 60)
    cols = [f"c{i}" for i in range(100)]
    data = [[None if h else float(v) for v, h in zip(*row)] for row in zip(whole, holes)]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in cols)).repartition(5)
    df = df.withColumn("k", F.monotonically_increasing_id())
    got = {tuple(r)[60]: r for r in impute.impute_chained(df, cols, rounds=6, at_once=20).collect()}
    error = [abs(got[row[60]][f"c{i}"] - row[i]) for row, hole in zip(whole, holes) for i in np.flatnonzero(hole)]
    assert np.median(error) < 0.1 and len(got) == 800


@pytest.fixture(scope="module")
def gappy(spark):
    """Three gappy columns of four, a whole-number one and a clashing name among them."""
    rng = np.random.RandomState(3)
    x = rng.normal(size=600)
    y, z = 2 * x + 0.3 * rng.normal(size=600), np.round(20 * x + 5 * rng.normal(size=600))
    v = y - x + 0.2 * rng.normal(size=600)
    rows = [
        (i, float(x[i]), None if i % 7 == 0 else float(y[i]), None if i % 5 == 1 else int(z[i]), None if i % 11 == 2 else float(v[i]), "kept")
        for i in range(600)
    ]
    return settle(spark.createDataFrame(rows, "k long, x double, y double, z int, v double, _filled string").repartition(4))


def reference_chain(df, cols, rounds):
    """The same by NumPy over all rows."""
    rows = df.orderBy("k").select(*[F.col(c).cast("double") for c in cols]).collect()
    x = np.array([[np.nan if v is None else v for v in r] for r in rows])
    gaps = np.isnan(x)
    filled = np.where(gaps, np.nanmean(x, axis=0), x)
    order = sorted((j for j in range(len(cols)) if gaps[:, j].any()), key=lambda j: gaps[:, j].sum())
    for _ in range(rounds):
        for j in order:
            a = np.column_stack([np.ones(len(x)), np.delete(filled, j, axis=1)])
            b = np.linalg.lstsq(a[~gaps[:, j]], x[~gaps[:, j], j], rcond=None)[0]
            filled[gaps[:, j], j] = a[gaps[:, j]] @ b
    return filled


@pytest.mark.parametrize("patterns", [256, 0, 3])
def test_chained_imputation_refits_each_column_in_turn(gappy, patterns):
    cols = ["x", "y", "z", "v"]
    floats = gappy.withColumn("z", F.col("z").cast("double"))
    fit = impute.fit_chained(floats, cols, rounds=3, tol=0.0, patterns=patterns)
    got = fit.transform(floats).orderBy("k")
    assert got.columns == gappy.columns and got.where("_filled <> 'kept'").count() == 0
    assert np.allclose(np.array(got.select(cols).collect(), float), reference_chain(floats, cols, 3), atol=1e-8)
    whole = impute.impute_chained(gappy, cols, rounds=3, tol=0.0, patterns=patterns).orderBy("k")
    assert [r.z for r in whole.collect()] == [int(v) for v in reference_chain(floats, cols, 3)[:, 2]]


def test_chained_imputation_stops_when_nothing_moves(gappy):
    cols = ["x", "y", "z", "v"]
    by_pattern, by_pass = (impute.fit_chained(gappy, cols, rounds=30, tol=1e-3, patterns=n).chains[0] for n in (256, 0))
    assert 6 <= len(by_pattern) < 90 and abs(len(by_pass) - len(by_pattern)) <= 3


def test_a_fit_on_train_rows_fills_test_rows(gappy):
    cols = ["x", "y", "v"]
    train, test = gappy.where("k < 400"), gappy.where("k >= 400")
    fit = impute.fit_chained(train, cols, rounds=4, tol=0.0)
    got = fit.transform(test)
    assert got.select(cols).na.drop().count() == test.count()
    # A gap in a column without gaps in fitting gets the mean.
    odd = fit.transform(test.withColumn("x", F.lit(None).cast("double"))).first()
    assert abs(odd.x - fit.mean["x"]) < 1e-9
    alone = fit.transform(test.limit(1)).first()
    assert alone == got.where(F.col("k") == alone.k).first()


def test_drawn_imputations_are_repeatable_and_centred(gappy):
    cols = ["x", "y", "v"]
    how = {"rounds": 2, "draws": 20, "key": "k"}
    one = impute.fit_chained(gappy, cols, seed=1, **how)
    assert len(one.chains) == 20 and len({s.sigma for c in one.chains for s in c}) > 20
    again = impute.fit_chained(gappy.repartition(3), cols, seed=1, **how)
    a, b = (m.transform(gappy).orderBy("k").collect() for m in (one, again))
    assert all(abs(p.y - q.y) < 1e-6 for p, q in zip(a, b))
    other = impute.fit_chained(gappy, cols, seed=2, **how).transform(gappy).orderBy("k").collect()
    assert any(abs(p.y - q.y) > 1e-3 for p, q in zip(a, other))
    plain = impute.impute_chained(gappy, cols, rounds=2).orderBy("k").collect()
    away = [p.y - q.y for i, (p, q) in enumerate(zip(a, plain)) if i % 7 == 0]
    assert abs(np.mean(away)) < 0.1 and 0 < np.std(away) < 0.3
    with pytest.raises(ValueError, match="key"):
        impute.fit_chained(gappy, cols, draws=2)


def test_chained_imputation_recovers_a_line(spark):
    df = spark.range(200).select(
        F.col("id").cast("double").alias("x"),
        F.when(F.col("id") % 7 != 0, F.col("id") * 3.0 + 5).alias("y"),
        F.when(F.col("id") % 11 != 3, 40 - F.col("id") * 0.5).alias("z"),
    )
    got = impute.impute_chained(df, ["x", "y", "z"], rounds=20, tol=1e-9).collect()
    for row in got:
        assert abs(row.y - (row.x * 3 + 5)) < 0.1 and abs(row.z - (40 - row.x * 0.5)) < 0.1


def test_bins_are_monotone_and_whole(app):
    cols = ["AMT_CREDIT", "AMT_GOODS_PRICE", "YEARS_OLD"]
    bins = woe.monotone_bins(app, cols, "TARGET").orderBy("feature", "bin").collect()
    for name in cols:
        mine = [row for row in bins if row.feature == name]
        rates = [row.event_rate for row in mine]
        assert len(mine) <= 20 and (rates == sorted(rates) or rates == sorted(rates, reverse=True))
        assert mine[0].lower == float("-inf") and mine[-1].upper == float("inf")
        assert all(a.upper == b.lower for a, b in zip(mine, mine[1:]))
        assert sum(row.rows for row in mine) == app.where(F.col(name).isNotNull()).count()
        for row in mine:
            inside = app.where((F.col(name) >= row.lower) & (F.col(name) < row.upper))
            assert inside.count() == row.rows and inside.where("TARGET = 1").count() == row.events


def test_bins_have_the_greatest_information_value():
    from itertools import combinations

    rng = np.random.RandomState(9)
    for _ in range(40):
        m = rng.randint(1, 9)
        parts = [(int(n), int(rng.randint(0, n + 1))) for n in rng.randint(1, 30, m)]
        rows, events = sum(n for n, _ in parts), sum(e for _, e in parts)
        found = []
        for k in range(m):
            for begins in combinations(range(1, m), k):
                edges = [0, *begins, m]
                bins = [(sum(p[0] for p in parts[a:b]), sum(p[1] for p in parts[a:b])) for a, b in zip(edges, edges[1:])]
                steps = {np.sign(e2 * n1 - e1 * n2) for (n1, e1), (n2, e2) in zip(bins, bins[1:])}
                if steps in (set(), {1}, {-1}):
                    found.append((sum(woe._iv(n, e, rows, events) for n, e in bins), edges[:-1]))
        got = woe.best_monotone(parts)
        value = next(v for v, begins in found if begins == got)
        assert value >= max(v for v, _ in found) - 1e-12


def test_elimination_follows_from_the_sums():
    rng = np.random.RandomState(2)
    x = rng.normal(size=(400, 5))
    x[:, 3] = 7.0
    y = 3 * x[:, 0] - 1.0 * x[:, 1] + 0.2 * x[:, 4] + rng.normal(size=400)
    z = np.column_stack([np.ones(400), x, y])
    assert woe.eliminated(z.T @ z) == [3, 2, 4, 1, 0]


def test_evidence_is_fitted_once_and_looked_up_alike(app, monkeypatch):
    cols = ["AMT_CREDIT", "CODE_GENDER", "OCCUPATION_TYPE", "CNT_CHILDREN"]
    evidence = woe.fit_evidence(app, cols, "TARGET")
    names = [f"{c}_woe" for c in cols]
    odd = app.select("SK_ID_CURR", *cols).unionByName(
        app.limit(1).select(F.lit(-1).cast("bigint").alias("SK_ID_CURR"), F.lit(float("nan")).alias("AMT_CREDIT"), F.lit("new").alias("CODE_GENDER"),
                            F.lit(None).cast("string").alias("OCCUPATION_TYPE"), F.lit(None).cast("int").alias("CNT_CHILDREN"))
    )
    listed = evidence.apply(odd)
    assert listed.columns == [*odd.columns, *names]
    assert "Join" not in listed._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(woe, "LISTED", 0)
    joined = evidence.apply(odd)
    assert sorted(map(tuple, listed.select("SK_ID_CURR", *names).collect())) == sorted(map(tuple, joined.select("SK_ID_CURR", *names).collect()))


def test_correlation_of_many_columns_takes_as_many_exchanges_as_of_few(spark, tmp_path):
    rng = np.random.RandomState(5)
    x = rng.normal(size=(300, 100)) @ np.diag(rng.rand(100) * 50) + 1e6
    x[:, 7] = 3.0
    x[rng.rand(300, 100) < 0.02] = np.nan
    cols = [f"c{i}" for i in range(100)]
    df = settle(spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"{c} double" for c in cols)).repartition(3))
    from loanlens.operators import distributions

    got = {(r.feature_a, r.feature_b): r["corr"] for r in distributions.correlation(df, cols).collect()}
    import pandas as pd

    want = pd.DataFrame(x, columns=cols).corr().to_numpy()
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            assert got[a, b] is None if 7 in (i, j) else abs(got[a, b] - want[i, j]) < 1e-9
    few = [c for c in cols[:12] if c != "c7"]
    ranks = pd.DataFrame(x, columns=cols)[few].dropna().rank().corr().to_numpy()
    by_rank = {(r.feature_a, r.feature_b): r["corr"] for r in distributions.correlation(df, few, "spearman").collect()}
    assert all(abs(by_rank[a, b] - ranks[i, j]) < 1e-9 for i, a in enumerate(few) for j, b in enumerate(few))
    for n in (2, 11):
        plan = distributions._ranked(df.na.drop(subset=few[:n]).select(F.array(*few[:n]).alias("x")))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") <= 8


def test_votes(app):
    cols = ["AMT_CREDIT", "CODE_GENDER", "OCCUPATION_TYPE", "YEARS_OLD", "NAME_EDUCATION_TYPE"]
    votes = woe.vote_features(app, cols, "TARGET", keep=3, each=2).collect()
    assert votes[0].feature == "AMT_CREDIT" and votes[0].votes == 6
    assert len(votes) == 3 and all(1 <= row.votes <= 6 for row in votes)


def test_components_equal_numpy(app):
    x = np.array(app.select(COMPONENT_COLUMNS).orderBy("SK_ID_CURR").collect(), dtype=float)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    order = np.argsort(values)[::-1]
    model = components.fit_pca(app, COMPONENT_COLUMNS, 7)
    shares = components.explained_variance(model, app).orderBy("component").collect()
    assert np.allclose([r.explained_variance for r in shares], (values / values.sum())[order][:7])
    assert np.allclose([r.cumulative for r in shares], np.cumsum((values / values.sum())[order][:7]))
    names = [f"principal_component_{i + 1}" for i in range(7)]
    found = components.pca(app, COMPONENT_COLUMNS, 7, model).orderBy("SK_ID_CURR")
    got = np.array(found.select(names).collect())
    assert np.allclose(np.abs(got), np.abs(z @ vectors[:, order[:7]]), atol=1e-6)
    loadings = model.model.pc.toArray()
    assert np.allclose(loadings.T @ loadings, np.eye(7), atol=1e-9)
    assert {"SK_ID_CURR", "TARGET"} <= set(found.columns)


@pytest.mark.parametrize("name", ["logistic_on_woe", "score", "explained_variance_of_seven", "impute_chained"])
def test_registered_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
