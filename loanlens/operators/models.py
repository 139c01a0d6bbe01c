"""Default models, their tuning and their reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool
from statistics import fmean, pstdev
from typing import NamedTuple

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.functions import hash_number
from loanlens.session import settle, small_frame

# The deepest tree that Spark grows.
DEEPEST = 30

# Settings that change neither the ranking of the rows nor the AUC of a logistic model.
NEUTRAL_SETTINGS = ("aggregationDepth", "threshold")


def logistic(train: DataFrame, weight: str | None = "classWeights", label: str = "TARGET", **params) -> Model:
    """Class-weighted logistic regression; ``params`` are those of the Spark estimator."""
    estimator = LogisticRegression(labelCol=label, **params)
    return (estimator.setWeightCol(weight) if weight else estimator).fit(train)


def random_forest(train: DataFrame, label: str = "TARGET", seed: int = 1, **params) -> Model:
    """Random forest. With indexed categories ``maxBins`` must reach the largest number
    of categories; with indicator vectors it need not."""
    return RandomForestClassifier(labelCol=label, seed=seed, **params).fit(train)


def _depth(depth: int) -> int:
    if depth > DEEPEST:
        raise ValueError(f"Spark grows trees of depth {DEEPEST} at most, not {depth}")
    return depth


def boosted_estimator(
    label: str = "TARGET",
    weight: str | None = None,
    learning_rate: float = 0.1,
    max_depth: int = 5,
    subsample: float = 1.0,
    colsample_bytree: float | None = None,
    min_child_weight: int = 1,
    gamma: float = 0.0,
    num_round: int = 20,
    seed: int = 0,
    total_weight: float = 1.0,
) -> GBTClassifier:
    """Boosted trees under the usual names of a boosting library.

    Near equivalents: features are sampled per node instead of per tree and the least
    child weight is a row count. Gamma is a gain summed over the rows where Spark's
    least gain is a mean, so it is divided by the total weight of the rows. L1 and
    L2 penalties, growth policy and parallel trees have no counterpart.
    """
    estimator = GBTClassifier(
        labelCol=label,
        stepSize=learning_rate,
        maxDepth=_depth(max_depth),
        subsamplingRate=subsample,
        featureSubsetStrategy=str(colsample_bytree) if colsample_bytree else "all",
        minInstancesPerNode=min_child_weight,
        minInfoGain=gamma / total_weight,
        maxIter=num_round,
        seed=seed,
    )
    return estimator.setWeightCol(weight) if weight else estimator


def positive_weight(df: DataFrame, label: str, scale_pos_weight: float, out: str) -> DataFrame:
    """Weight w for ones and 1 for zeros."""
    return df.withColumn(
        out, F.when(F.col(label) == 1, F.lit(float(scale_pos_weight))).otherwise(F.lit(1.0))
    )


def boosted_trees(
    train: DataFrame, label: str = "TARGET", scale_pos_weight: float = 1.0, **params
) -> Model:
    weighted = positive_weight(train, label, scale_pos_weight, "_weight")
    total = weighted.agg(F.sum("_weight")).head()[0]
    return boosted_estimator(label, "_weight", total_weight=total, **params).fit(weighted)


def score(model: Model, df: DataFrame, keep: Sequence[str] = ("TARGET",)) -> DataFrame:
    """Probability of default, raw score of default and decision beside the kept columns."""
    scored = model.transform(df)
    return scored.select(
        *keep,
        vector_to_array("rawPrediction")[1].alias("raw_score"),
        vector_to_array("probability")[1].alias("probability"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def distinct_grid(grid: Mapping[str, Sequence], neutral: Sequence[str] = NEUTRAL_SETTINGS) -> dict:
    """The grid without the parameters that cannot change the measure."""
    return {name: values for name, values in grid.items() if name not in neutral}


def _param_maps(estimator: Estimator, grid: Mapping[str, Sequence]) -> list:
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    return builder.build()


class Search(NamedTuple):
    """A finished grid search: the best setting fitted on all rows, and all results."""

    best_model: Model
    settings: list[str]
    means: list[float]
    deviations: list[float]


def cross_validate(
    estimator: Estimator,
    grid: Mapping[str, Sequence],
    train: DataFrame,
    folds: int = 5,
    label: str = "TARGET",
    fold_col: str | None = None,
    key: str = "SK_ID_CURR",
    parallelism: int = 4,
    seed: int = 1,
) -> Search:
    """Grid search by area under ROC; settings of equal result are tried once.

    Folds are numbers from 0 in ``fold_col`` (see ``stratified_folds``), or else drawn
    by a hash of ``key``. They are plain filters of the rows, which are written once
    with only the columns the estimator reads; ``CrossValidator`` would test the fold
    column with a Python function row by row. The best model also gets the first value
    of each setting that cannot change the measure, as a threshold for its decisions.
    """
    if fold_col is None:
        fold_col = "_fold"
        train = train.withColumn(fold_col, hash_number(f"fold:{seed}", key) % folds)
    maps = _param_maps(estimator, distinct_grid(grid))
    names = [_setting(params) for params in maps]
    evaluator = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    used = [fold_col, label]
    for name in ("featuresCol", "weightCol"):
        if estimator.hasParam(name) and estimator.isDefined(name):
            used.append(estimator.getOrDefault(name))
    # An estimator of several stages reads columns that are not known here.
    rows = settle(train.select(used) if estimator.hasParam("featuresCol") else train)
    measured = _over_folds(estimator, maps, rows, evaluator, folds, fold_col, parallelism)
    means = [fmean(found) for found in measured]
    neutral = {estimator.getParam(n): grid[n][0] for n in NEUTRAL_SETTINGS if grid.get(n)}
    best = estimator.fit(rows, {**maps[means.index(max(means))], **neutral})
    return Search(best, names, means, [pstdev(found) for found in measured])


def _over_folds(
    estimator: Estimator,
    maps: list,
    rows: DataFrame,
    evaluator: BinaryClassificationEvaluator,
    folds: int,
    fold_col: str,
    parallelism: int,
) -> list[list[float]]:
    """The measure of each setting on each fold, fitted on the other folds."""

    def measure(task: tuple[dict, int]) -> float:
        params, fold = task
        model = estimator.fit(rows.where(F.col(fold_col) != fold), params)
        return evaluator.evaluate(model.transform(rows.where(F.col(fold_col) == fold)))

    with ThreadPool(parallelism) as pool:
        found = pool.map(measure, list(product(maps, range(folds))), chunksize=1)
    return [found[i * folds : (i + 1) * folds] for i in range(len(maps))]


def _setting(params: Mapping) -> str:
    return ", ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda kv: kv[0].name))


def _results(spark: SparkSession, rows: list[tuple[str, float, float]]) -> DataFrame:
    best = max(mean for _, mean, _ in rows)
    marked = [(name, float(mean), float(sd), bool(mean == best)) for name, mean, sd in rows]
    schema = "setting string, mean_auc double, sd_auc double, is_best boolean"
    return small_frame(spark, marked, schema).orderBy(F.desc("mean_auc"), "setting")


def cv_results(search: Search, spark: SparkSession) -> DataFrame:
    """Mean and deviation of the measure per setting, the best one marked."""
    return _results(spark, list(zip(search.settings, search.means, search.deviations)))


# How the settings of a boosted-tree search are called in Spark.
_BOOSTED_NAMES = {
    "learning_rate": "stepSize",
    "max_depth": "maxDepth",
    "subsample": "subsamplingRate",
    "colsample_bytree": "featureSubsetStrategy",
    "min_child_weight": "minInstancesPerNode",
    "gamma": "minInfoGain",
    "n_estimators": "maxIter",
    "num_round": "maxIter",
}


def grid_search_boosted(
    df: DataFrame,
    grid: Mapping[str, Sequence],
    fold_cols: Sequence[str],
    folds: int,
    label: str = "TARGET",
    parallelism: int = 4,
    seed: int = 1,
) -> DataFrame:
    """Boosted-tree settings by area under ROC over repeated stratified folds.

    ``fold_cols`` are the repeats made by ``stratified_folds``. Mean and deviation
    are over all repeats and folds. The class weight is a column, derived from the
    one written table for each of its values. A setting that is not known or has no
    counterpart in Spark, and a tree deeper than Spark's limit, is an error.
    """
    if other := set(grid) - {*_BOOSTED_NAMES, "scale_pos_weight"}:
        raise ValueError(f"no counterpart in Spark: {', '.join(sorted(other))}")
    tree = {_BOOSTED_NAMES[n]: v for n, v in grid.items() if n in _BOOSTED_NAMES}
    if "featureSubsetStrategy" in tree:
        tree["featureSubsetStrategy"] = [str(v) for v in tree["featureSubsetStrategy"]]
    if "maxDepth" in tree:
        tree["maxDepth"] = [_depth(v) for v in tree["maxDepth"]]
    evaluator = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    rows = settle(df.select(label, "features", *fold_cols))
    results = []
    for weight in grid.get("scale_pos_weight", [1]):
        weighted = positive_weight(rows, label, weight, "_weight")
        if "gamma" in grid:
            total = weighted.agg(F.sum("_weight")).head()[0]
            tree["minInfoGain"] = [gamma / total for gamma in grid["gamma"]]
        estimator = boosted_estimator(label, "_weight", seed=seed)
        maps = _param_maps(estimator, tree)
        repeats = [
            _over_folds(estimator, maps, weighted, evaluator, folds, fold_col, parallelism)
            for fold_col in fold_cols
        ]
        for params, *measured in zip(maps, *repeats):
            found = [value for repeat in measured for value in repeat]
            name = f"scale_pos_weight={weight}, {_setting(params)}".rstrip(", ")
            results.append((name, fmean(found), pstdev(found)))
    return _results(df.sparkSession, results)


def vector_names(df: DataFrame, vector: str = "features") -> list[str]:
    """Names of a vector's elements, from the metadata the assembler left."""
    groups = df.schema[vector].metadata["ml_attr"]["attrs"].values()
    found = sorted((attr["idx"], attr["name"]) for group in groups for attr in group)
    return [name for _, name in found]


def feature_importance(model: Model, scored: DataFrame, vector: str = "features") -> DataFrame:
    """Importance per element of the feature vector, highest first."""
    values = model.featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(vector_names(scored, vector), values)]
    table = small_frame(scored.sparkSession, rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")
