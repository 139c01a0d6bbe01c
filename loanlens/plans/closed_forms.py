"""Models whose fit has a closed form, each on the applicant table and in plain SQL.

A logistic model on the indicators of one category gives each category its weighted
share of defaults; a tree of depth one on 0/1 columns gives each side of its split its
share; a single boosting round turns the weighted mean of +1 and -1 into a probability.
So the wiring of weights, vectors, folds, scores and reports is checked exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens import settings
from loanlens.operators import evaluate, features, logit, models, prep, search, trees, windows
from loanlens.plans.applications import applications
from loanlens.plans.oracles import APPLICATIONS, HASH_SPLIT
from loanlens.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RICH = 440_000.0
STUMP = {"weightCol": "classWeights", "numTrees": 1, "maxDepth": 1, "bootstrap": False, "featureSubsetStrategy": "all"}


def query(build):
    QUERIES[build.__name__] = build
    return build


def by_category(spark, sf_dir):
    """Train and test rows with the indicators of one category."""
    df = applications(spark, sf_dir).select("SK_ID_CURR", "TARGET", "CODE_GENDER")
    df = prep.one_hot(settle(df), ["CODE_GENDER"], drop_last=False).withColumnRenamed("CODE_GENDERclassVec", "features")
    train, test = prep.split(df, "SK_ID_CURR")
    return settle(prep.class_weights(train, "TARGET").select("SK_ID_CURR", "TARGET", "features", "classWeights")), test


def category_scores(spark, sf_dir):
    train, test = by_category(spark, sf_dir)
    model = models.logistic(train, maxIter=200, tol=1e-12, fitIntercept=False, standardization=False)
    keep = ["SK_ID_CURR", "TARGET"]
    return models.score(model, train, keep), models.score(model, test, keep)


def flags(spark, sf_dir):
    df = applications(spark, sf_dir).select(
        "SK_ID_CURR",
        "TARGET",
        (F.col("AMT_CREDIT") > RICH).cast("int").alias("rich"),
        (F.col("FLAG_OWN_REALTY") == "Y").cast("int").alias("home"),
    )
    # Spark merges leaves that decide alike, so the classes are balanced by weights.
    df = prep.class_weights(settle(df), "TARGET")
    return settle(prep.assemble(df, ["rich", "home"]).select("SK_ID_CURR", "TARGET", "features", "classWeights"))


@query
def logistic_of_category(spark, sf_dir):
    _, test = category_scores(spark, sf_dir)
    return test.select("SK_ID_CURR", "TARGET", F.round("probability", 4).alias("probability"), "prediction")


@query
def model_auc(spark, sf_dir):
    """Area under the curve of the model's own score, on the part it saw and on the other."""
    found = []
    for part, scored in zip(("train", "test"), category_scores(spark, sf_dir)):
        auc = evaluate.roc_auc(windows.running_class_counts(scored, "probability", "TARGET"))
        found.append(auc.select(F.lit(part).alias("part"), F.round("auc", 9).alias("auc")))
    return found[0].unionByName(found[1])


@query
def model_confusion(spark, sf_dir):
    """Decisions of the model's score at the fixed threshold."""
    _, test = category_scores(spark, sf_dir)
    decided = features.apply_threshold(test.drop("prediction"), "probability", settings.LOGISTIC_THRESHOLD)
    return evaluate.confusion_matrix(decided, "TARGET", "prediction")


@query
def tree_of_flags(spark, sf_dir):
    train, test = prep.split(flags(spark, sf_dir), "SK_ID_CURR")
    scored = models.score(models.random_forest(train, **STUMP), test, ["SK_ID_CURR", "TARGET"])
    return scored.select("SK_ID_CURR", "TARGET", F.round("probability", 9).alias("probability"), "prediction")


@query
def importance_of_flags(spark, sf_dir):
    df = flags(spark, sf_dir)
    found = models.feature_importance(models.random_forest(df, **STUMP), df)
    return found.select("feature", F.round("importance", 9).alias("importance"))


@query
def boosted_of_flags(spark, sf_dir):
    train, test = prep.split(flags(spark, sf_dir), "SK_ID_CURR")
    model = models.boosted_trees(train, scale_pos_weight=3.0, num_round=1, max_depth=1)
    scored = models.score(model, test, ["SK_ID_CURR", "TARGET"])
    return scored.select(
        "SK_ID_CURR", "TARGET", F.round("raw_score", 9).alias("raw_score"), F.round("probability", 9).alias("probability")
    )


@query
def boosted_confusion(spark, sf_dir):
    """Decisions of boosted trees at their fixed threshold."""
    train, test = prep.split(flags(spark, sf_dir), "SK_ID_CURR")
    model = models.boosted_trees(train, scale_pos_weight=92.0, num_round=1, max_depth=1)
    scored = models.score(model, test, ["TARGET"]).drop("prediction")
    decided = features.apply_threshold(scored, "probability", settings.BOOSTED_THRESHOLD)
    return evaluate.confusion_matrix(decided, "TARGET", "prediction")


@query
def cross_validated_tree(spark, sf_dir):
    df = prep.stratified_folds(flags(spark, sf_dir), "TARGET", "SK_ID_CURR", k=5, repeats=1)
    estimator = RandomForestClassifier(labelCol="TARGET", **{k: v for k, v in STUMP.items() if k != "maxDepth"})
    search = models.cross_validate(estimator, {"maxDepth": [1]}, df, folds=5, fold_col="fold_1")
    found = models.cv_results(search, spark)
    return found.withColumns({c: F.round(c, 9) for c in ("mean_auc", "sd_auc")})


@query
def boosted_search_of_flags(spark, sf_dir):
    df = prep.stratified_folds(flags(spark, sf_dir), "TARGET", "SK_ID_CURR", k=10, repeats=3)
    grid = {"scale_pos_weight": [1, 75], "max_depth": [1], "num_round": [1]}
    found = models.grid_search_boosted(df, grid, ["fold_1", "fold_2", "fold_3"], folds=10)
    return found.withColumns({c: F.round(c, 9) for c in ("mean_auc", "sd_auc")}).drop("is_best")


def flag_rows(spark, sf_dir):
    df = applications(spark, sf_dir).select(
        "SK_ID_CURR",
        "TARGET",
        (F.col("AMT_CREDIT") > RICH).cast("int").alias("rich"),
        (F.col("FLAG_OWN_REALTY") == "Y").cast("int").alias("home"),
    )
    return settle(df)


def second_order(spark, sf_dir):
    """One round of second-order boosting, two levels, both penalties 1."""
    train, test = prep.split(flag_rows(spark, sf_dir), "SK_ID_CURR")
    bins = trees.fit_bins(train, ["rich", "home"])
    keep = ["SK_ID_CURR", "TARGET"]
    rows = [trees.binned(part, bins, "SK_ID_CURR", "TARGET", keep=keep) for part in (train, test)]
    params = trees.boosted(max_depth=2, num_round=1, scale_pos_weight=3.0, alpha=1.0, lambda_=1.0)
    return trees.fit(settle(rows[0]), bins[0], params), rows[1]


@query
def second_order_of_flags(spark, sf_dir):
    model, test = second_order(spark, sf_dir)
    scored = trees.score(model, test, ["SK_ID_CURR", "TARGET"])
    return scored.withColumns({c: F.round(c, 9) for c in ("raw_score", "probability")})


@query
def split_counts_of_flags(spark, sf_dir):
    model, _ = second_order(spark, sf_dir)
    found = trees.importance(trees.node_table(model, spark))
    sums = [F.round(c, 6).alias(c) for c in ("total_gain", "total_cover")]
    return found.select("feature", F.col("splits"), *sums)


@query
def forest_search_of_flags(spark, sf_dir):
    """Two depths of a tree, of which the deeper one ranks better."""
    df = prep.class_weights(flag_rows(spark, sf_dir), "TARGET")
    folded = prep.stratified_folds(df, "TARGET", "SK_ID_CURR", k=5, repeats=1)
    bins = trees.fit_bins(df, ["rich", "home"])
    table = settle(trees.binned(folded, bins, "SK_ID_CURR", "TARGET", "classWeights", keep=["fold_1"]))
    plans = search.forest_plans({"maxDepth": [1, 2], "numTrees": [1]}, [20], 2)
    found = search.results(search.over_folds(table, bins, plans, ["fold_1"], 5), spark)
    return found.withColumns({c: F.round(c, 9) for c in ("mean_auc", "sd_auc")})


@query
def logistic_search_of_category(spark, sf_dir):
    """Without a penalty the model is that of the category's shares; with a large one it
    knows nothing."""
    df = applications(spark, sf_dir).select("SK_ID_CURR", "TARGET", "CODE_GENDER")
    df = prep.one_hot(settle(df), ["CODE_GENDER"], drop_last=False).withColumnRenamed("CODE_GENDERclassVec", "features")
    folded = prep.stratified_folds(prep.class_weights(df, "TARGET"), "TARGET", "SK_ID_CURR", k=5, repeats=1)
    rows = logit.rows_of(folded, "TARGET", "classWeights", "fold_1")
    found, _ = logit.search(rows, {"regParam": [0.0, 50.0], "elasticNetParam": [1.0], "fitIntercept": [False]}, 5)
    return search.results(found, spark).withColumns({c: F.round(c, 9) for c in ("mean_auc", "sd_auc")})


def by_part(spark, sf_dir):
    """Scores of two models, each on its train and its test part, counted together."""
    found = []
    for part, scored in zip(("train", "test"), category_scores(spark, sf_dir)):
        found.append(scored.select(F.lit("logistic").alias("model"), F.lit(part).alias("part"), "TARGET", "probability"))
    train, test = prep.split(flags(spark, sf_dir), "SK_ID_CURR")
    forest = models.random_forest(train, **STUMP)
    for part, rows in (("train", train), ("test", test)):
        scored = models.score(forest, rows, ["TARGET"])
        found.append(scored.select(F.lit("tree").alias("model"), F.lit(part).alias("part"), "TARGET", "probability"))
    long = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    return windows.running_class_counts(long.withColumn("probability", F.round("probability", 4)), "probability", "TARGET", by=["model", "part"])


@query
def curves_of_models(spark, sf_dir):
    """Area, best threshold and its F measure of all models and parts, from one table."""
    counts, by = by_part(spark, sf_dir), ["model", "part"]
    found = evaluate.roc_auc(counts, by).join(evaluate.best_threshold(counts, by), by)
    return found.select(*by, F.round("auc", 9).alias("auc"), "threshold", F.round("f_measure", 9).alias("f_measure"))


@query
def roc_of_models(spark, sf_dir):
    by = ["model", "part"]
    found = evaluate.roc_curve(by_part(spark, sf_dir), by)
    return found.withColumns({c: F.round(c, 9) for c in ("fpr", "tpr")})


# ---- the same in SQL ----

_BASE = APPLICATIONS + f""",
f AS (
  SELECT SK_ID_CURR, TARGET, CODE_GENDER, CAST(AMT_CREDIT > {RICH} AS INT) AS rich,
    CAST(FLAG_OWN_REALTY = 'Y' AS INT) AS home, {HASH_SPLIT} AS train FROM app),
s AS (SELECT avg(CASE WHEN TARGET = 1 THEN 0.0::DOUBLE ELSE 1.0 END) AS s FROM f WHERE train),
p AS (
  SELECT CODE_GENDER, sum(CASE WHEN TARGET = 1 THEN s ELSE 0 END)
    / sum(CASE WHEN TARGET = 1 THEN s ELSE 1 - s END) AS p FROM f, s WHERE train GROUP BY 1)
"""


def _auc_of_folds(repeats: int, k: int) -> str:
    """Area per fold of a score that only tells rich from others, rich being riskier."""
    numbered = " UNION ALL ".join(
        f"SELECT TARGET, rich, {r} AS repeat, (row_number() OVER (PARTITION BY TARGET ORDER BY "
        f"md5('1:{r}:' || CAST(SK_ID_CURR AS VARCHAR)), SK_ID_CURR) - 1) % {k} AS fold FROM f"
        for r in range(1, repeats + 1)
    )
    return (
        f", n AS ({numbered}), a AS (SELECT repeat, fold, (1.0::DOUBLE + "
        "sum(rich * TARGET)::DOUBLE / sum(TARGET) - sum(rich * (1 - TARGET))::DOUBLE / sum(1 - TARGET)) / 2 AS auc "
        "FROM n GROUP BY repeat, fold), r AS (SELECT round(avg(auc), 9) AS mean_auc, round(stddev_pop(auc), 9) AS sd_auc FROM a) "
    )


# Sums of gradients and Hessians at an even chance, the first and the second split.
_SECOND_ORDER = _BASE + """, c AS (
  SELECT rich, home, sum(CASE WHEN TARGET = 1 THEN -1.5::DOUBLE ELSE 0.5 END) AS g,
    sum(CASE WHEN TARGET = 1 THEN 0.75::DOUBLE ELSE 0.25 END) AS h FROM f WHERE train GROUP BY 1, 2),
sides AS (
  SELECT 'rich' AS feature, rich AS v, sum(g) AS g, sum(h) AS h FROM c GROUP BY 2
  UNION ALL SELECT 'home', home, sum(g), sum(h) FROM c GROUP BY 2),
worth AS (SELECT *, pow(greatest(abs(g) - 1, 0), 2) / (h + 1) AS s FROM sides),
root AS (SELECT sum(g) AS g, sum(h) AS h, pow(greatest(abs(sum(g)) - 1, 0), 2) / (sum(h) + 1) AS s FROM c),
one AS (
  SELECT feature, sum(worth.s) - max(root.s) AS gain FROM worth, root GROUP BY 1 ORDER BY 2 DESC, feature DESC LIMIT 1),
n AS (SELECT v, g, h, s FROM worth SEMI JOIN one USING (feature)),
cells AS (
  SELECT CASE WHEN one.feature = 'rich' THEN rich ELSE home END AS v, rich, home, g, h,
    pow(greatest(abs(g) - 1, 0), 2) / (h + 1) AS s FROM c, one),
two AS (
  SELECT n.v, sum(cells.s) - max(n.s) AS gain, max(n.h) AS cover FROM cells JOIN n USING (v)
  GROUP BY 1 HAVING min(cells.h) >= 1 AND count(*) = 2 AND sum(cells.s) - max(n.s) > 1e-6),
leaf AS (
  SELECT rich, home, -0.3 * sign(g) * greatest(abs(g) - 1, 0) / (h + 1) AS raw FROM (
    SELECT rich, home, CASE WHEN two.v IS NULL THEN n.g ELSE cells.g END AS g, CASE WHEN two.v IS NULL THEN n.h ELSE cells.h END AS h
    FROM cells JOIN n USING (v) LEFT JOIN two USING (v)))
"""

_FOLDS = """, k AS (
  SELECT TARGET, CODE_GENDER, rich, home, (row_number() OVER (PARTITION BY TARGET ORDER BY
    md5('1:1:' || CAST(SK_ID_CURR AS VARCHAR)), SK_ID_CURR) - 1) % 5 AS fold FROM f),
z AS (SELECT avg(CASE WHEN TARGET = 1 THEN 0.0::DOUBLE ELSE 1.0 END) AS z FROM f),
out AS (SELECT unnest(range(5)) AS held)"""


def _share_by_fold(columns: str) -> str:
    """Weighted share of ones by columns, without each fold; its area on that fold."""
    return f"""SELECT held, sum(ones * (2 * below + zeros))::DOUBLE / (2 * sum(ones) * sum(zeros)) AS auc FROM (
  SELECT held, p, sum(ones) AS ones, sum(zeros) AS zeros,
    coalesce(sum(sum(zeros)) OVER (PARTITION BY held ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (
    SELECT held, {columns}, sum(CASE WHEN fold <> held THEN CASE WHEN TARGET = 1 THEN z ELSE 0 END END)
        / sum(CASE WHEN fold <> held THEN CASE WHEN TARGET = 1 THEN z ELSE 1 - z END END) AS p,
      count(*) FILTER (fold = held AND TARGET = 1) AS ones, count(*) FILTER (fold = held AND TARGET = 0) AS zeros
    FROM k, z, out GROUP BY held, {columns}) GROUP BY held, p) GROUP BY held"""


# Counts of ones and zeros by the rounded score of two models, by part.
_CURVES = _BASE + """, z AS (SELECT avg(CASE WHEN TARGET = 1 THEN 0.0::DOUBLE ELSE 1.0 END) AS z FROM f),
t AS (SELECT rich, sum(CASE WHEN TARGET = 1 THEN z ELSE 0 END) / sum(CASE WHEN TARGET = 1 THEN z ELSE 1 - z END) AS q
  FROM f, z WHERE train GROUP BY 1),
c AS (
  SELECT model, part, threshold, sum(TARGET) AS ones, count(*) AS n FROM (
    SELECT 'logistic' AS model, CASE WHEN train THEN 'train' ELSE 'test' END AS part, round(p, 4) AS threshold, TARGET
    FROM f JOIN p USING (CODE_GENDER)
    UNION ALL SELECT 'tree', CASE WHEN train THEN 'train' ELSE 'test' END, round(q, 4), TARGET FROM f JOIN t USING (rich))
  GROUP BY 1, 2, 3),
w AS (
  SELECT *, sum(ones) OVER u AS ones_above, sum(n) OVER u AS n_above, sum(ones) OVER g AS p, sum(n) OVER g AS m FROM c
  WINDOW u AS (PARTITION BY model, part ORDER BY threshold DESC), g AS (PARTITION BY model, part))
"""

ORACLES = {
    "logistic_of_category": _BASE
    + "SELECT SK_ID_CURR, TARGET, round(p, 4) AS probability, CAST(p > 0.5 AS INT) AS prediction "
    "FROM f JOIN p USING (CODE_GENDER) WHERE NOT train",
    "model_auc": _BASE
    + """, c AS (
  SELECT train, p, sum(TARGET) AS ones, sum(1 - TARGET) AS zeros FROM f JOIN p USING (CODE_GENDER) GROUP BY 1, 2),
w AS (SELECT *, coalesce(sum(zeros) OVER (PARTITION BY train ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT CASE WHEN train THEN 'train' ELSE 'test' END AS part,
  round(CAST(sum(ones * (2 * below + zeros)) AS DOUBLE) / (2.0::DOUBLE * CAST(sum(ones) AS DOUBLE) * CAST(sum(zeros) AS DOUBLE)), 9) AS auc
FROM w GROUP BY train""",
    "model_confusion": _BASE
    + f"""SELECT TARGET AS actual, count(*) FILTER (p <= {settings.LOGISTIC_THRESHOLD}) AS predicted_0,
  count(*) FILTER (p > {settings.LOGISTIC_THRESHOLD}) AS predicted_1
FROM f JOIN p USING (CODE_GENDER) WHERE NOT train GROUP BY 1""",
    "tree_of_flags": _BASE
    + """, z AS (SELECT avg(CASE WHEN TARGET = 1 THEN 0.0::DOUBLE ELSE 1.0 END) AS z FROM f),
t AS (SELECT rich, sum(CASE WHEN TARGET = 1 THEN z ELSE 0 END) / sum(CASE WHEN TARGET = 1 THEN z ELSE 1 - z END) AS q
  FROM f, z WHERE train GROUP BY 1)
SELECT SK_ID_CURR, TARGET, round(q, 9) AS probability, CAST(q > 0.5 AS INT) AS prediction
FROM f JOIN t USING (rich) WHERE NOT train""",
    "importance_of_flags": "SELECT * FROM (VALUES ('rich', 1.0::DOUBLE), ('home', 0.0::DOUBLE)) t(feature, importance)",
    "boosted_of_flags": _BASE
    + """, t AS (
  SELECT rich, sum(CASE WHEN TARGET = 1 THEN 3.0::DOUBLE ELSE -1.0 END) / sum(CASE WHEN TARGET = 1 THEN 3.0::DOUBLE ELSE 1.0 END) AS m
  FROM f WHERE train GROUP BY 1)
SELECT SK_ID_CURR, TARGET, round(m, 9) AS raw_score, round(1 / (1 + exp(-2 * m)), 9) AS probability
FROM f JOIN t USING (rich) WHERE NOT train""",
    "boosted_confusion": _BASE
    + f""", t AS (
  SELECT rich, sum(CASE WHEN TARGET = 1 THEN 92.0::DOUBLE ELSE -1.0 END) / sum(CASE WHEN TARGET = 1 THEN 92.0::DOUBLE ELSE 1.0 END) AS m
  FROM f WHERE train GROUP BY 1)
SELECT TARGET AS actual, count(*) FILTER (1 / (1 + exp(-2 * m)) <= {settings.BOOSTED_THRESHOLD}) AS predicted_0,
  count(*) FILTER (1 / (1 + exp(-2 * m)) > {settings.BOOSTED_THRESHOLD}) AS predicted_1
FROM f JOIN t USING (rich) WHERE NOT train GROUP BY 1""",
    "cross_validated_tree": _BASE + _auc_of_folds(1, 5)
    + "SELECT 'maxDepth=1' AS setting, mean_auc, sd_auc, true AS is_best FROM r",
    "boosted_search_of_flags": _BASE + _auc_of_folds(3, 10)
    + "SELECT unnest(['scale_pos_weight=1, maxDepth=1, maxIter=1', 'scale_pos_weight=75, maxDepth=1, maxIter=1']) AS setting, "
    "mean_auc, sd_auc FROM r",
    "second_order_of_flags": _SECOND_ORDER
    + "SELECT SK_ID_CURR, TARGET, round(raw, 9) AS raw_score, round(1 / (1 + exp(-raw)), 9) AS probability, "
    "CAST(1 / (1 + exp(-raw)) > 0.5 AS INT) AS prediction FROM f JOIN leaf USING (rich, home) WHERE NOT train",
    "split_counts_of_flags": _SECOND_ORDER
    + """SELECT feature, count(*) AS splits, round(sum(gain), 6) AS total_gain, round(sum(cover), 6) AS total_cover FROM (
  SELECT feature, gain, root.h AS cover FROM one, root
  UNION ALL SELECT CASE WHEN feature = 'rich' THEN 'home' ELSE 'rich' END, two.gain, two.cover FROM two, one) GROUP BY feature""",
    "forest_search_of_flags": _BASE + _FOLDS
    + f""", a1 AS ({_share_by_fold("rich")}), a2 AS ({_share_by_fold("rich, home")}),
r AS (
  SELECT 'maxDepth=1, numTrees=1' AS setting, avg(auc) AS m, stddev_pop(auc) AS d FROM a1
  UNION ALL SELECT 'maxDepth=2, numTrees=1', avg(auc), stddev_pop(auc) FROM a2)
SELECT setting, round(m, 9) AS mean_auc, round(d, 9) AS sd_auc, m = max(m) OVER () AS is_best FROM r""",
    "logistic_search_of_category": _BASE + _FOLDS
    + f""", a1 AS ({_share_by_fold("CODE_GENDER")}),
r AS (SELECT 0.0 AS reg, avg(auc) AS m, stddev_pop(auc) AS d FROM a1 UNION ALL SELECT 50.0, 0.5, 0.0)
SELECT 'elasticNetParam=1.0, fitIntercept=False, maxIter=100, regParam=' || CAST(reg AS VARCHAR) AS setting,
  round(m, 9) AS mean_auc, round(d, 9) AS sd_auc, m = max(m) OVER () AS is_best FROM r""",
    "curves_of_models": _CURVES
    + """, a AS (
  SELECT model, part, round(CAST(sum(ones * (2 * (m - p - (n_above - ones_above)) + n - ones)) AS DOUBLE)
    / (2.0::DOUBLE * max(p) * max(m - p)), 9) AS auc,
    max({'f': 2.0::DOUBLE * ones_above / (p + n_above), 'threshold': threshold}) AS best FROM w GROUP BY 1, 2)
SELECT model, part, auc, best.threshold AS threshold, round(best.f, 9) AS f_measure FROM a""",
    "roc_of_models": _CURVES
    + """SELECT model, part, threshold, round(CAST(n_above - ones_above AS DOUBLE) / (m - p), 9) AS fpr,
  round(CAST(ones_above AS DOUBLE) / p, 9) AS tpr FROM w
UNION ALL SELECT DISTINCT model, part, NULL, 0.0::DOUBLE, 0.0::DOUBLE FROM w""",
}
