"""Every operator as a query on the given tables. Computed values are rounded here,
not in the operators, so that sums in another order still compare equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens import settings
from loanlens.operators import (
    components,
    distributions,
    evaluate,
    features,
    impute,
    joins,
    logit,
    models,
    ordering,
    prep,
    search,
    stages,
    summaries,
    trees,
    windows,
    woe,
)
from loanlens.plans.applications import applications, table
from loanlens.session import new_path, settle, small_frame
from loanlens.sources import tables as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in cols})


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_credit_features(applications(spark, sf_dir))


# ---- sources, sinks, schema ----


@query
def read_csv(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    path = new_path(spark, "orders-csv")
    orders.write.option("header", True).option("sep", ";").csv(path)
    return sources.read_csv(spark, path, schema=orders.schema, sep=";")


@query
def register(spark, sf_dir):
    sources.register(applications(spark, sf_dir), "data")
    return spark.sql(
        "SELECT CODE_GENDER, count(*) AS applicants FROM data GROUP BY CODE_GENDER"
    )


@query
def read_table(spark, sf_dir):
    """A saved table: the one that ``write_prepared`` wrote, by a name of its own in the catalog,
    which is dropped again; its files stay for whoever reads the result."""
    path = new_path(spark, "prepared-orders")
    sources.write_prepared(table(spark, sf_dir, "orders"), path)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    spark.catalog.createTable(name, path=path, source="parquet")
    found = sources.read_table(spark, name).select("o_orderkey", "o_totalprice")
    spark.sql(f"DROP TABLE {name}")
    return found


@query
def write_prepared(spark, sf_dir):
    path = new_path(spark, "prepared")
    sources.write_prepared(applications(spark, sf_dir), path)
    return spark.read.parquet(path)


@query
def sample_rows(spark, sf_dir):
    rows = sources.sample_rows(applications(spark, sf_dir), 10, "SK_ID_CURR", seed=7)
    return rows.select("SK_ID_CURR", "TARGET", "AMT_CREDIT")


@query
def select_by_type(spark, sf_dir):
    return sources.select_by_type(applications(spark, sf_dir), ["integer", "string"])


# ---- projections, filters, scalar expressions ----


@query
def select_cols(spark, sf_dir):
    return features.select_cols(applications(spark, sf_dir), ["SK_ID_CURR", "AMT_CREDIT", "TARGET"])


@query
def drop_cols(spark, sf_dir):
    kept = features.drop_cols(applications(spark, sf_dir), settings.DROP_COLUMNS)
    return kept.select(sorted(kept.columns))


@query
def cast_cols(spark, sf_dir):
    df = applications(spark, sf_dir).select(
        "SK_ID_CURR", "AMT_CREDIT", "AMT_INCOME_TOTAL", "NAME_EDUCATION_TYPE"
    )
    return features.cast_cols(df, ["AMT_CREDIT", "AMT_INCOME_TOTAL", "NAME_EDUCATION_TYPE"], "int")


@query
def rename_cols(spark, sf_dir):
    df = applications(spark, sf_dir).select("SK_ID_CURR", "AMT_CREDIT", "AMT_INCOME_TOTAL")
    named = features.rename_cols(df, {"SK_ID_CURR": "application_id"})
    return features.rename_cols(named, dict.fromkeys(["AMT_CREDIT", "AMT_INCOME_TOTAL"]), prefix="norm_")


@query
def sentinel_to_null(spark, sf_dir):
    df = applications(spark, sf_dir).select("SK_ID_CURR", "DAYS_EMPLOYED")
    return features.sentinel_to_null(df, "DAYS_EMPLOYED", settings.EMPLOYMENT_SENTINEL)


@query
def years_from_days(spark, sf_dir):
    df = applications(spark, sf_dir).select("SK_ID_CURR", "DAYS_BIRTH")
    return features.years_from_days(df, "DAYS_BIRTH", "YEARS_OLD")


@query
def ratio(spark, sf_dir):
    df = applications(spark, sf_dir).select("SK_ID_CURR", "AMT_CREDIT", "AMT_INCOME_TOTAL")
    return features.ratio(df, "AMT_CREDIT", "AMT_INCOME_TOTAL", "CREDIT_INCOME_PERCENTAGE")


@query
def log_feature(spark, sf_dir):
    df = applications(spark, sf_dir).select("SK_ID_CURR", "AMT_INCOME_TOTAL")
    return rounded(features.log_feature(df, "AMT_INCOME_TOTAL", "LOG_INCOME_TOTAL"), 9, "LOG_INCOME_TOTAL")


@query
def add_credit_features(spark, sf_dir):
    logs = ["LOG_INCOME_TOTAL", "LOG_ANNUITY", "LOG_CREDIT", "LOG_YEARS_EMPLOYED"]
    return rounded(featured(spark, sf_dir), 9, *logs).select(
        "SK_ID_CURR",
        "DAYS_EMPLOYED",
        "YEARS_OLD",
        "YEARS_EMPLOYED",
        "ANNUITY_INCOME_PERCENTAGE",
        "CREDIT_INCOME_PERCENTAGE",
        "CREDIT_DURATION",
        "EMP_AGE_PERCENTAGE",
        *logs,
    )


@query
def filter_rows(spark, sf_dir):
    df = features.filter_rows(
        applications(spark, sf_dir),
        (F.col("TARGET") == 1) & (F.col("AMT_CREDIT") > F.col("AMT_INCOME_TOTAL")),
    )
    df = features.filter_rows(df, "OCCUPATION_TYPE IS NOT NULL")
    return df.select("SK_ID_CURR", "OCCUPATION_TYPE", "AMT_CREDIT")


@query
def drop_missing(spark, sf_dir):
    df = applications(spark, sf_dir).select("SK_ID_CURR", "OCCUPATION_TYPE", "AMT_GOODS_PRICE")
    return features.drop_missing(df, ["OCCUPATION_TYPE", "AMT_GOODS_PRICE"])


@query
def fill_missing(spark, sf_dir):
    df = applications(spark, sf_dir).select("SK_ID_CURR", "OCCUPATION_TYPE", "AMT_GOODS_PRICE")
    df = features.fill_missing(df, 0.0, ["AMT_GOODS_PRICE"])
    return features.fill_missing(df, "Unknown", ["OCCUPATION_TYPE"])


@query
def apply_threshold(spark, sf_dir):
    df = applications(spark, sf_dir).select("SK_ID_CURR", "AMT_CREDIT")
    return features.apply_threshold(df, "AMT_CREDIT", 440000.0)


@query
def range_filter(spark, sf_dir):
    df = applications(spark, sf_dir).select("SK_ID_CURR", "AMT_CREDIT")
    return features.range_filter(df, "AMT_CREDIT", 100000.0, 300000.0)


# ---- aggregations ----


@query
def group_mean(spark, sf_dir):
    cols = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_GOODS_PRICE"]
    means = summaries.group_mean(applications(spark, sf_dir), ["TARGET"], cols)
    return rounded(means, 4, *[f"avg_{name}" for name in cols])


@query
def describe_cols(spark, sf_dir):
    table_ = summaries.describe_cols(featured(spark, sf_dir), settings.DESCRIBE_COLUMNS)
    return rounded(table_, 4, "mean", "stddev", "min", "max")


@query
def crosstab(spark, sf_dir):
    return summaries.crosstab(applications(spark, sf_dir), "TARGET", "CODE_GENDER")


@query
def crosstab_with_gaps(spark, sf_dir):
    return summaries.crosstab(
        applications(spark, sf_dir), "OCCUPATION_TYPE", "NAME_CONTRACT_TYPE", ["Cash loans", "Revolving loans"]
    ).withColumnsRenamed({"Cash loans": "cash_loans", "Revolving loans": "revolving_loans"})


@query
def pivot_mean(spark, sf_dir):
    wide = summaries.pivot_mean(
        applications(spark, sf_dir), "TARGET", "CODE_GENDER", "AMT_INCOME_TOTAL"
    )
    return rounded(wide, 4, *[name for name in wide.columns if name != "TARGET"])


@query
def pivot_mean_listed(spark, sf_dir):
    listed = ["BUILDING", "HOUSEHOLD"]
    wide = summaries.pivot_mean(
        applications(spark, sf_dir), "TARGET", "NAME_FAMILY_STATUS", "AMT_INCOME_TOTAL", listed
    )
    return rounded(wide, 4, *listed)


@query
def count_where(spark, sf_dir):
    return summaries.count_where(applications(spark, sf_dir), "AMT_CREDIT > AMT_INCOME_TOTAL")


@query
def group_count(spark, sf_dir):
    return summaries.group_count(applications(spark, sf_dir), "CNT_CHILDREN")


@query
def value_counts(spark, sf_dir):
    return summaries.value_counts(applications(spark, sf_dir), "OCCUPATION_TYPE")


@query
def share_of_total(spark, sf_dir):
    return summaries.share_of_total(applications(spark, sf_dir), "OCCUPATION_TYPE", top=3)


@query
def outcome_rate_by_category(spark, sf_dir):
    return summaries.outcome_rate_by_category(
        applications(spark, sf_dir), settings.OUTCOME_DIMENSIONS
    )


@query
def class_balance(spark, sf_dir):
    return rounded(
        summaries.class_balance(applications(spark, sf_dir)), 9, "share_ones", "share_zeros"
    )


@query
def missing_profile(spark, sf_dir):
    return summaries.missing_profile(featured(spark, sf_dir), exclude=["TARGET"], top=10)


@query
def distinct_missing_rates(spark, sf_dir):
    return summaries.distinct_missing_rates(featured(spark, sf_dir), exclude=["TARGET"])


@query
def histogram(spark, sf_dir):
    df = featured(spark, sf_dir)
    work = df.select((F.col("DAYS_EMPLOYED") / -365).alias("YEARS_OF_WORK"))
    return rounded(
        distributions.histogram(work, "YEARS_OF_WORK", settings.WORK_BINS), 9, "lower", "upper"
    )


@query
def histogram_of_income(spark, sf_dir):
    return rounded(
        distributions.histogram(
            applications(spark, sf_dir), "AMT_INCOME_TOTAL", settings.INCOME_BINS
        ),
        9,
        "lower",
        "upper",
    )


@query
def log_distribution(spark, sf_dir):
    df = applications(spark, sf_dir).select("AMT_INCOME_TOTAL")
    return rounded(distributions.log_distribution(df, "AMT_INCOME_TOTAL", 50), 9, "lower", "upper")


@query
def density(spark, sf_dir):
    df = settle(applications(spark, sf_dir).select("AMT_CREDIT", "AMT_GOODS_PRICE"))
    curves = joins.union_rows(
        distributions.density(df, "AMT_CREDIT"),
        distributions.density(df, "AMT_GOODS_PRICE"),
        ("AMT_CREDIT", "AMT_GOODS_PRICE"),
        "amount",
    )
    return rounded(rounded(curves, 4, "x"), 13, "density")


@query
def correlation(spark, sf_dir):
    df = featured(spark, sf_dir)
    return rounded(distributions.correlation(df, settings.DESCRIBE_COLUMNS), 8, "corr")


@query
def correlation_spearman(spark, sf_dir):
    cols = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_GOODS_PRICE", "CNT_CHILDREN"]
    return rounded(
        distributions.correlation(applications(spark, sf_dir), cols, method="spearman"), 8, "corr"
    )


# ---- joins, set operations ----


@query
def semi_join_where(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )
    return joins.semi_join_where(lines, "l_orderkey", "l_quantity > 40")


@query
def attach_by_key(spark, sf_dir):
    df = applications(spark, sf_dir)
    numbers = df.select("SK_ID_CURR", "AMT_CREDIT", "AMT_INCOME_TOTAL")
    words = df.select("SK_ID_CURR", "CODE_GENDER", "OCCUPATION_TYPE")
    return joins.attach_by_key(numbers, words, "SK_ID_CURR")


@query
def union_rows(spark, sf_dir):
    df = applications(spark, sf_dir)
    paid = summaries.value_counts(df.where("TARGET = 0"), "CODE_GENDER")
    late = summaries.value_counts(df.where("TARGET = 1"), "CODE_GENDER")
    return joins.union_rows(paid, late, ("paid", "default"), "outcome")


# ---- running values ----


@query
def carry_fill(spark, sf_dir):
    df = settle(
        applications(spark, sf_dir).select("SK_ID_CURR", "OCCUPATION_TYPE", "AMT_GOODS_PRICE")
    )
    return windows.carry_fill(df, ["OCCUPATION_TYPE", "AMT_GOODS_PRICE"], "SK_ID_CURR")


@query
def cumulative_share(spark, sf_dir):
    per_count = (
        applications(spark, sf_dir)
        .groupBy("CNT_CHILDREN")
        .agg(F.sum(F.col("AMT_CREDIT").cast("decimal(18,2)")).cast("double").alias("credit"))
    )
    return rounded(
        windows.cumulative_share(per_count, "CNT_CHILDREN", "credit"), 9, "share", "cumulative_share"
    )


def credit_counts(spark, sf_dir):
    return windows.running_class_counts(applications(spark, sf_dir), "AMT_CREDIT", "TARGET")


@query
def running_class_counts(spark, sf_dir):
    return credit_counts(spark, sf_dir)


# ---- sort, limit, top-k ----


@query
def top_k(spark, sf_dir):
    return ordering.top_k(applications(spark, sf_dir), "AMT_INCOME_TOTAL", 10)


@query
def top_k_distinct(spark, sf_dir):
    return ordering.top_k_distinct(applications(spark, sf_dir), "AMT_CREDIT", 5)


@query
def sort_rows(spark, sf_dir):
    df = applications(spark, sf_dir).select("SK_ID_CURR", "OCCUPATION_TYPE", "AMT_CREDIT")
    return ordering.sort_rows(df, [F.desc("OCCUPATION_TYPE"), "AMT_CREDIT", "SK_ID_CURR"])


@query
def head(spark, sf_dir):
    df = applications(spark, sf_dir).select("SK_ID_CURR", "AMT_CREDIT")
    return ordering.head(ordering.sort_rows(df, [F.desc("AMT_CREDIT"), "SK_ID_CURR"]), 20)


# ---- feature preparation ----

NUMBERS = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "DAYS_BIRTH"]


@query
def assemble(spark, sf_dir):
    vectors = prep.assemble(applications(spark, sf_dir), NUMBERS)
    return prep.vector_columns(vectors, "features", ["f1", "f2", "f3"]).select(
        "SK_ID_CURR", "f1", "f2", "f3"
    )


@query
def scale(spark, sf_dir):
    names = [f"scaled_{name}" for name in NUMBERS]
    scaled = prep.scale(applications(spark, sf_dir), NUMBERS)
    spread = prep.vector_columns(scaled, "scaled_features", names)
    return rounded(spread.select("SK_ID_CURR", *names), 6, *names)


@query
def zscore(spark, sf_dir):
    cols = [*NUMBERS, "AMT_GOODS_PRICE"]
    df = prep.zscore(applications(spark, sf_dir), cols)
    names = [f"norm_{name}" for name in cols]
    return rounded(df.select("SK_ID_CURR", *names), 6, *names)


@query
def index_labels(spark, sf_dir):
    df = applications(spark, sf_dir).select("SK_ID_CURR", "OCCUPATION_TYPE", "NAME_EDUCATION_TYPE")
    return prep.index_labels(df, ["OCCUPATION_TYPE", "NAME_EDUCATION_TYPE"])


@query
def one_hot(spark, sf_dir):
    df = applications(spark, sf_dir).select("SK_ID_CURR", "CODE_GENDER")
    encoded = prep.one_hot(df, ["CODE_GENDER"])
    return prep.vector_columns(encoded, "CODE_GENDERclassVec", ["is_first", "is_second"]).select(
        "SK_ID_CURR", "is_first", "is_second"
    )


@query
def prep_stages(spark, sf_dir):
    df = applications(spark, sf_dir)
    stages = prep.prep_pipeline(["CODE_GENDER", "OCCUPATION_TYPE"], ["AMT_CREDIT"], "TARGET")
    names = [f"f{i}" for i in range(8)]
    ready = stages.fit(df).transform(df)
    return prep.vector_columns(ready, "features", names).select("SK_ID_CURR", "label", *names)


@query
def split(spark, sf_dir):
    train, test = prep.split(applications(spark, sf_dir).select("SK_ID_CURR", "TARGET"), "SK_ID_CURR")
    return joins.union_rows(train, test, ("train", "test"), "part")


@query
def class_weights(spark, sf_dir):
    df = applications(spark, sf_dir).select("SK_ID_CURR", "TARGET")
    return rounded(prep.class_weights(df, "TARGET"), 9, "classWeights")


@query
def impute_by(spark, sf_dir):
    df = applications(spark, sf_dir).select("SK_ID_CURR", "AMT_CREDIT", "AMT_GOODS_PRICE")
    return rounded(impute.impute_by(df, "AMT_GOODS_PRICE", "AMT_CREDIT"), 3, "AMT_GOODS_PRICE")


@query
def impute_chained(spark, sf_dir):
    df = features.sentinel_to_null(
        applications(spark, sf_dir), "DAYS_EMPLOYED", settings.EMPLOYMENT_SENTINEL
    )
    cols = ["AMT_CREDIT", "AMT_INCOME_TOTAL", "AMT_GOODS_PRICE", "CNT_CHILDREN", "DAYS_BIRTH", "DAYS_EMPLOYED"]
    df = settle(df.select("SK_ID_CURR", *cols))
    return rounded(impute.impute_chained(df, cols), 2, "AMT_GOODS_PRICE")


@query
def impute_two(spark, sf_dir):
    """Two gappy columns that explain each other, refilled in turn for two rounds."""
    df = features.sentinel_to_null(applications(spark, sf_dir), "DAYS_EMPLOYED", settings.EMPLOYMENT_SENTINEL)
    cols = ["AMT_GOODS_PRICE", "DAYS_EMPLOYED"]
    df = settle(df.select("SK_ID_CURR", *[F.col(c).cast("double").alias(c) for c in cols]))
    return rounded(impute.impute_chained(df, cols, rounds=2, tol=0.0), 2, *cols)


CATEGORIES = ["CODE_GENDER", "NAME_EDUCATION_TYPE", "OCCUPATION_TYPE", "REGION_RATING_CLIENT"]


@query
def woe_table(spark, sf_dir):
    return rounded(
        woe.woe_table(applications(spark, sf_dir), CATEGORIES, "TARGET"), 9, "woe", "iv"
    )


@query
def monotone_bins(spark, sf_dir):
    """The outer bounds, which are infinite, are left empty."""
    cols = ["AMT_CREDIT", "AMT_GOODS_PRICE", "YEARS_OLD"]
    df = settle(featured(spark, sf_dir).select("TARGET", *cols))
    found = woe.monotone_bins(df, cols, "TARGET")
    ends = {c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in ("lower", "upper")}
    return rounded(found.withColumns(ends), 9, "event_rate")


@query
def count_ballots(spark, sf_dir):
    """The ballots of the selectors that need counts only: of six columns three each."""
    cols = [*CATEGORIES, "FLAG_OWN_REALTY", "NAME_INCOME_TYPE"]
    table = settle(woe.woe_table(applications(spark, sf_dir), cols, "TARGET"))
    return rounded(woe.ballots(woe.count_strengths(table), 3), 9, "strength")


@query
def apply_woe(spark, sf_dir):
    df = applications(spark, sf_dir).select("SK_ID_CURR", "TARGET", "AMT_CREDIT", *CATEGORIES)
    inf = float("inf")
    limits = [-inf, 150000.0, 300000.0, 440000.0, inf]
    intervals = [("AMT_CREDIT", i, limits[i], limits[i + 1]) for i in range(4)]
    bins = small_frame(spark, intervals, "feature string, bin int, lower double, upper double")
    cols = ["AMT_CREDIT", *CATEGORIES]
    fitted = woe.woe_table(woe.assign_bins(df, bins), cols, "TARGET")
    names = [f"{name}_woe" for name in cols]
    return rounded(woe.apply_woe(df, fitted, cols, bins).select("SK_ID_CURR", *names), 9, *names)


@query
def rank_by_iv(spark, sf_dir):
    ranked = woe.rank_by_iv(woe.woe_table(applications(spark, sf_dir), CATEGORIES, "TARGET"))
    return rounded(ranked, 9, "information_value")


#: Of the candidates here, which are fewer than the published 25, so many are kept.
KEPT = 10


@query
def vote_features(spark, sf_dir):
    df = features.drop_cols(featured(spark, sf_dir), settings.DROP_COLUMNS)
    cols = [name for name in df.columns if name != "TARGET"]
    return woe.vote_features(df, cols, "TARGET", keep=KEPT)


COMPONENT_COLUMNS = [
    "REGION_RATING_CLIENT",
    "CNT_CHILDREN",
    "AMT_CREDIT",
    "AMT_INCOME_TOTAL",
    "AMT_ANNUITY",
    "YEARS_OLD",
    "CREDIT_DURATION",
    "DAYS_BIRTH",
]


@query
def pca(spark, sf_dir):
    df = featured(spark, sf_dir).select("SK_ID_CURR", "TARGET", *COMPONENT_COLUMNS)
    df = settle(df)
    found = components.pca(df, COMPONENT_COLUMNS, settings.COMPONENTS)
    names = [f"principal_component_{i + 1}" for i in range(settings.COMPONENTS)]
    return rounded(found.select("SK_ID_CURR", "TARGET", *names), 6, *names)


@query
def pca_of_two(spark, sf_dir):
    df = settle(applications(spark, sf_dir).select("SK_ID_CURR", "AMT_CREDIT", "AMT_ANNUITY"))
    found = components.pca(df, ["AMT_CREDIT", "AMT_ANNUITY"], 2)
    names = ["principal_component_1", "principal_component_2"]
    # Both loadings are equally large here, so the sign of the second is left open.
    return found.select(
        "SK_ID_CURR",
        F.round(F.abs(names[0]), 6).alias("size_1"),
        F.round(F.abs(names[1]), 6).alias("size_2"),
    )


@query
def explained_variance(spark, sf_dir):
    df = settle(applications(spark, sf_dir).select("AMT_CREDIT", "AMT_ANNUITY"))
    model = components.fit_pca(df, ["AMT_CREDIT", "AMT_ANNUITY"], 2)
    return rounded(components.explained_variance(model, df), 8, "explained_variance", "cumulative")


@query
def explained_variance_of_seven(spark, sf_dir):
    df = settle(featured(spark, sf_dir).select(COMPONENT_COLUMNS))
    model = components.fit_pca(df, COMPONENT_COLUMNS, settings.COMPONENTS)
    return rounded(components.explained_variance(model, df), 8, "explained_variance", "cumulative")


# ---- models and tuning ----

MODEL_NUMBERS = [
    "AMT_CREDIT",
    "AMT_INCOME_TOTAL",
    "AMT_ANNUITY",
    "CNT_CHILDREN",
    "REGION_RATING_CLIENT",
    "YEARS_OLD",
    "CREDIT_DURATION",
]
MODEL_CATEGORIES = ["CODE_GENDER", "NAME_EDUCATION_TYPE", "OCCUPATION_TYPE"]


def model_parts(spark, sf_dir):
    """Train and test vectors. The prepared table is written once, and so are the train
    vectors, which every fit reads several times."""
    df = featured(spark, sf_dir).select("SK_ID_CURR", "TARGET", *MODEL_NUMBERS, *MODEL_CATEGORIES)
    train, test = prep.split(settle(df, evenly=True), "SK_ID_CURR")
    stages = prep.prep_pipeline(MODEL_CATEGORIES, MODEL_NUMBERS).fit(train)
    keep = ["SK_ID_CURR", "TARGET", "features"]
    ready = prep.class_weights(stages.transform(train).select(keep), "TARGET")
    return settle(ready), stages.transform(test).select(keep)


def scored_rows(model, test):
    found = models.score(model, test, ["SK_ID_CURR", "TARGET"])
    return rounded(found, 6, "raw_score", "probability")


@query
def logistic(spark, sf_dir):
    train, test = model_parts(spark, sf_dir)
    return scored_rows(models.logistic(train, **settings.LOGISTIC_TUNED), test)


@query
def logistic_on_woe(spark, sf_dir):
    """Votes on the training rows choose the features, whose weights of evidence the model
    is fitted on."""
    df = settle(featured(spark, sf_dir), evenly=True)
    train, test = prep.split(df, "SK_ID_CURR", seed=12345)
    candidates = [name for name in df.columns if name not in (*settings.DROP_COLUMNS, "TARGET")]
    evidence = woe.fit_evidence(train, candidates, "TARGET")
    voted = woe.vote_features(train, candidates, "TARGET", keep=KEPT, evidence=evidence).collect()
    cols = [row["feature"] for row in voted]

    def vectors(part):
        # Only what the model reads is written.
        return prep.assemble(evidence.apply(part, cols), [f"{name}_woe" for name in cols]).select("SK_ID_CURR", "TARGET", "features")

    weighted_train = vectors(train).withColumn(
        "classWeights",
        F.when(F.col("TARGET") == 1, settings.ZERO_SHARE).otherwise(1 - settings.ZERO_SHARE),
    )
    return scored_rows(models.logistic(settle(weighted_train), **settings.LOGISTIC_TUNED), vectors(test))


def vector_rows(part, names, bins, keep=()):
    """Vectors as binned rows for trees."""
    return trees.binned(prep.vector_columns(part, "features", names), bins, "SK_ID_CURR", "TARGET", keep=["SK_ID_CURR", "TARGET", *keep])


@query
def random_forest(spark, sf_dir):
    train, test = model_parts(spark, sf_dir)
    names = models.vector_names(train)
    settings_ = dict(settings.FOREST_TUNED)
    bins = trees.fit_bins(prep.vector_columns(train, "features", names), names, sizes=(settings_.pop("maxBins"),))
    model = trees.fit(settle(vector_rows(train, names, bins), evenly=True), bins[0], trees.forest(len(names), **settings_))
    scored = trees.score(model, vector_rows(test, names, bins), ["SK_ID_CURR", "TARGET"])
    return rounded(scored, 6, "raw_score", "probability")


BOOSTED_NUMBERS = [*MODEL_NUMBERS, "AMT_GOODS_PRICE", "DAYS_EMPLOYED"]


def boosted_parts(spark, sf_dir):
    """Binned train and test rows for boosting, which takes gaps and categories as they are."""
    df = featured(spark, sf_dir).select("SK_ID_CURR", "TARGET", *BOOSTED_NUMBERS, *MODEL_CATEGORIES)
    df = features.sentinel_to_null(df, "DAYS_EMPLOYED", settings.EMPLOYMENT_SENTINEL)
    train, test = prep.split(settle(df), "SK_ID_CURR")
    bins = trees.fit_bins(train, BOOSTED_NUMBERS, MODEL_CATEGORIES, sizes=(64,))
    keep = ["SK_ID_CURR", "TARGET"]
    parts = [trees.binned(part, bins, "SK_ID_CURR", "TARGET", keep=keep) for part in (train, test)]
    return settle(parts[0]), parts[1], bins[0]


def published_boosted(spark, sf_dir):
    train, test, bins = boosted_parts(spark, sf_dir)
    return trees.fit(train, bins, trees.boosted(**settings.BOOSTED_PUBLISHED)), test


@query
def boosted_trees(spark, sf_dir):
    model, test = published_boosted(spark, sf_dir)
    return rounded(trees.score(model, test, ["SK_ID_CURR", "TARGET"]), 6, "raw_score", "probability")


@query
def boosted_importance(spark, sf_dir):
    model, _ = published_boosted(spark, sf_dir)
    found = trees.importance(trees.node_table(model, spark))
    return rounded(found, 6, "total_gain", "total_cover", "mean_gain", "mean_cover")


@query
def score(spark, sf_dir):
    train, test = model_parts(spark, sf_dir)
    return scored_rows(models.logistic(train, **settings.LOGISTIC_QUICK), test)


def logistic_search(spark, sf_dir):
    """The whole grid over five folds; settings of equal result are tried once."""
    train, test = model_parts(spark, sf_dir)
    folded = prep.stratified_folds(train, "TARGET", "SK_ID_CURR", k=5, repeats=1)
    rows = logit.rows_of(folded, "TARGET", "classWeights", "fold_1")
    found, by_name = logit.search(rows, models.distinct_grid(settings.LOGISTIC_GRID), folds=5)
    return rows, test, found, by_name


@query
def cross_validate(spark, sf_dir):
    rows, test, found, by_name = logistic_search(spark, sf_dir)
    _, best = found.best()
    model = logit.fit_setting(rows, by_name[best.setting])
    scored = logit.score(model, test, ["SK_ID_CURR", "TARGET"], threshold=settings.LOGISTIC_GRID["threshold"][0])
    return rounded(scored, 6, "raw_score", "probability")


@query
def cv_results(spark, sf_dir):
    _, _, found, _ = logistic_search(spark, sf_dir)
    return rounded(search.results(found, spark), 6, "mean_auc", "sd_auc")


def forest_search(spark, sf_dir):
    """The whole grid over five folds: one fit for all depths and numbers of trees."""
    train, test = model_parts(spark, sf_dir)
    names, sizes = models.vector_names(train), settings.FOREST_GRID["maxBins"]
    folded = prep.stratified_folds(train, "TARGET", "SK_ID_CURR", k=5, repeats=1)
    bins = trees.fit_bins(prep.vector_columns(train, "features", names), names, sizes=sizes)
    table = settle(vector_rows(folded, names, bins, ["fold_1"]), evenly=True)
    plans = search.forest_plans(settings.FOREST_GRID, sizes, len(names))
    return table, test, names, bins, search.over_folds(table, bins, plans, ["fold_1"], 5)


@query
def cross_validate_forest(spark, sf_dir):
    table, test, names, bins, found = forest_search(spark, sf_dir)
    model, reading = search.fit_best(table, bins, found)
    held = vector_rows(test, names, [bins[found.best()[0].x]])
    return rounded(trees.score(model, held, ["SK_ID_CURR", "TARGET"], reading.depth, reading.trees), 6, "raw_score", "probability")


@query
def stratified_folds(spark, sf_dir):
    df = settle(applications(spark, sf_dir).select("SK_ID_CURR", "TARGET"))
    return prep.stratified_folds(df, "TARGET", "SK_ID_CURR", k=10, repeats=3)


#: What of the published grid is searched here; README has the time of the rest.
BOOSTED_SEARCH = {
    "scale_pos_weight": settings.BOOSTED_GRID["scale_pos_weight"],
    "max_depth": settings.BOOSTED_GRID["max_depth"][:1],
    "subsample": settings.BOOSTED_GRID["subsample"],
    "n_estimators": settings.BOOSTED_GRID["n_estimators"][:1],
    "gamma": settings.BOOSTED_GRID["gamma"],
    "alpha": settings.BOOSTED_GRID["alpha"],
}


def boosted_search(spark, sf_dir, grid):
    """Settings over ten folds drawn three times, on all rows."""
    df = featured(spark, sf_dir).select("SK_ID_CURR", "TARGET", *BOOSTED_NUMBERS, *MODEL_CATEGORIES)
    df = settle(features.sentinel_to_null(df, "DAYS_EMPLOYED", settings.EMPLOYMENT_SENTINEL))
    bins = trees.fit_bins(df, BOOSTED_NUMBERS, MODEL_CATEGORIES, sizes=(64,))
    folds = ["fold_1", "fold_2", "fold_3"]
    folded = prep.stratified_folds(df, "TARGET", "SK_ID_CURR", k=10, repeats=3)
    table = settle(trees.binned(folded, bins, "SK_ID_CURR", "TARGET", keep=folds), evenly=True)
    return search.over_folds(table, bins, search.boosted_plans(grid), folds, 10)


@query
def grid_search_boosted(spark, sf_dir):
    found = boosted_search(spark, sf_dir, BOOSTED_SEARCH)
    return rounded(search.results(found, spark), 6, "mean_auc", "sd_auc")


@query
def feature_importance(spark, sf_dir):
    train, test = model_parts(spark, sf_dir)
    model = models.random_forest(train)
    return rounded(models.feature_importance(model, test), 6, "importance")


# ---- the prepared table, and what is trained on it ----

FILLED = ["OCCUPATION_TYPE", "NAME_INCOME_TYPE"]
CHAINED = ["AMT_GOODS_PRICE", "DAYS_EMPLOYED"]


def prepared(spark, sf_dir, numeric, **how):
    """The chain fitted on the train part, saved, loaded and applied to all rows, whose table
    is saved and read again."""
    df = applications(spark, sf_dir)
    df = settle(features.cast_cols(df, CHAINED, "double"), evenly=True)
    train, _ = prep.split(df, "SK_ID_CURR")
    path = new_path(spark, "preparation")
    stages.preparation(FILLED, numeric, "SK_ID_CURR", **how).fit(train).save(path)
    ready = PipelineModel.load(path).transform(df)
    table_path = new_path(spark, "prepared")
    sources.write_prepared(ready, table_path)
    return spark.read.parquet(table_path)


@query
def prepared_chain(spark, sf_dir):
    df = prepared(spark, sf_dir, CHAINED, rounds=2, tol=0.0)
    return rounded(df.select("SK_ID_CURR", *FILLED, *CHAINED, "YEARS_OLD"), 2, *CHAINED)


@query
def model_curves(spark, sf_dir):
    """Area on both parts, best threshold and its F measure of the three published models,
    trained on the prepared table, from one table of running counts."""
    df = prepared(spark, sf_dir, [*BOOSTED_NUMBERS], rounds=5)
    train, test = prep.split(df, "SK_ID_CURR")
    ready = prep.prep_pipeline(MODEL_CATEGORIES, BOOSTED_NUMBERS).fit(train)
    keep = ["SK_ID_CURR", "TARGET", "features"]
    vectors = {"train": settle(prep.class_weights(ready.transform(train).select(keep), "TARGET")), "test": ready.transform(test).select(keep)}
    regression = logit.rows_of(vectors["train"], "TARGET", "classWeights")
    plain = logit.fit_setting(regression, {"regParam": 0.0, "elasticNetParam": 0.8, "fitIntercept": False, "maxIter": 200})
    names = models.vector_names(vectors["train"])
    settings_ = dict(settings.FOREST_TUNED)
    bins = trees.fit_bins(prep.vector_columns(vectors["train"], "features", names), names, sizes=(settings_.pop("maxBins"),))
    rows = {part: settle(vector_rows(v, names, bins), evenly=True) for part, v in vectors.items()}
    forest = trees.fit(rows["train"], bins[0], trees.forest(len(names), **settings_))
    boosted = trees.fit(rows["train"], bins[0], trees.boosted(**settings.BOOSTED_PUBLISHED))
    scored = []
    for part in ("train", "test"):
        by_model = {
            "logistic": logit.score(plain, vectors[part], ["TARGET"]),
            "forest": trees.score(forest, rows[part], ["TARGET"]),
            "boosted": trees.score(boosted, rows[part], ["TARGET"]),
        }
        scored += [s.select(F.lit(m).alias("model"), F.lit(part).alias("part"), "TARGET", "probability") for m, s in by_model.items()]
    long = reduce(DataFrame.unionByName, scored)
    counts, by = windows.running_class_counts(long, "probability", "TARGET", by=["model", "part"]), ["model", "part"]
    found = evaluate.roc_auc(counts, by).join(evaluate.best_threshold(counts, by), by)
    return rounded(found, 6, "auc", "threshold", "f_measure")


# ---- evaluation ----


@query
def roc_auc(spark, sf_dir):
    return rounded(evaluate.roc_auc(credit_counts(spark, sf_dir)), 12, "auc")


@query
def recall_by_threshold(spark, sf_dir):
    return rounded(evaluate.recall_by_threshold(credit_counts(spark, sf_dir)), 9, "recall")


@query
def precision_by_threshold(spark, sf_dir):
    return rounded(evaluate.precision_by_threshold(credit_counts(spark, sf_dir)), 9, "precision")


@query
def precision_recall_curve(spark, sf_dir):
    curve = evaluate.precision_recall_curve(credit_counts(spark, sf_dir))
    return rounded(curve, 9, "recall", "precision")


@query
def f_measure_by_threshold(spark, sf_dir):
    return rounded(evaluate.f_measure_by_threshold(credit_counts(spark, sf_dir)), 9, "f_measure")


@query
def best_threshold(spark, sf_dir):
    return rounded(evaluate.best_threshold(credit_counts(spark, sf_dir)), 9, "f_measure")


@query
def roc_curve(spark, sf_dir):
    return rounded(evaluate.roc_curve(credit_counts(spark, sf_dir)), 9, "fpr", "tpr")


@query
def confusion_matrix(spark, sf_dir):
    decided = features.apply_threshold(applications(spark, sf_dir), "AMT_CREDIT", 440000.0)
    return evaluate.confusion_matrix(decided, "TARGET", "prediction")
