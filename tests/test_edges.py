"""Hand-made frames: NaN, nulls, ties, one class, empty groups, constant columns."""

import math

import pytest
from pyspark.sql import functions as F

from loanlens.operators import (
    components,
    distributions,
    evaluate,
    features,
    impute,
    joins,
    models,
    ordering,
    prep,
    summaries,
    windows,
    woe,
)
from loanlens.sources import read_csv, read_table, register, sample_rows, schema_table, select_by_type

NAN = float("nan")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame(
        [(1, 1.0, "a"), (1, NAN, "b"), (0, None, "a"), (0, 3.0, None)], "t int, x double, c string"
    )


def test_csv_separators_and_inference(spark, tmp_path):
    for sep in ",;":
        path = tmp_path / f"in{ord(sep)}.csv"
        path.write_text(f"id{sep}x\n1{sep}2.5\n2{sep}\n")
        df = read_csv(spark, str(path), sep=sep)
        assert dict(df.dtypes) == {"id": "int", "x": "double"}
        assert rows(df) == [(1, 2.5), (2, None)]
        assert dict(read_csv(spark, str(path), "id bigint, x string", sep).dtypes)["x"] == "string"


def test_schema_and_type_selection(gaps):
    assert rows(schema_table(gaps))[1][1:] == ("x", "double", True)
    assert select_by_type(gaps, "numeric").columns == ["t", "x"]
    assert select_by_type(gaps, ["string"]).columns == ["c"]
    assert select_by_type(gaps, "double").columns == ["x"]
    assert select_by_type(gaps, "integer").columns == ["t"]


def test_register_and_read(spark, gaps):
    register(gaps, "gaps_view")
    assert read_table(spark, "gaps_view").count() == 4


def test_nan_counts_as_missing(gaps):
    clean = features.nan_to_null(gaps)
    assert clean.agg(F.avg("x")).head()[0] == 2.0
    assert rows(summaries.missing_profile(gaps)) == [("c", 1, 25.0), ("t", 0, 0.0), ("x", 2, 50.0)]
    assert rows(summaries.distinct_missing_rates(gaps)) == [(0.0,), (25.0,), (50.0,)]
    assert features.drop_missing(gaps, ["x"]).count() == 2
    assert features.fill_missing(gaps, 9.0, ["x"]).where("x = 9").count() == 2


def test_scalar_expressions(spark):
    df = spark.createDataFrame(
        [(100.0, 0.0, -3650, 365243), (100.0, 40.0, -7300, -365), (5.0, -4.0, 0, 0)],
        "a double, b double, born int, employed int",
    )
    assert [r.q for r in features.ratio(df, "a", "b", "q").collect()] == [None, 3.0, -1.0]
    assert [r.y for r in features.years_from_days(df, "born", "y").collect()] == [10.0, 20.0, 0.0]
    assert [r.l for r in features.log_feature(df, "b", "l").collect()] == [None, math.log(40), None]
    sentinel = features.sentinel_to_null(df, "employed", 365243)
    assert [r.employed for r in sentinel.collect()] == [None, -365, 0]
    cut = features.apply_threshold(df, "b", 0.0, "p")
    assert [r.p for r in cut.collect()] == [0, 1, 0]


def test_cast_cuts_toward_zero_and_spares_bad_text(spark):
    df = spark.createDataFrame([(1.9, "7"), (-1.9, "x")], "a double, b string")
    assert rows(features.cast_cols(df, ["a", "b"], "int")) == [(-1, None), (1, 7)]


def test_crosstab_and_pivot_with_null_category(gaps):
    table = summaries.crosstab(gaps, "t", "c")
    assert set(table.columns) == {"t", "null", "a", "b"}
    assert {r.t: (r.a, r.b, r["null"]) for r in table.collect()} == {1: (1, 1, 0), 0: (1, 0, 1)}
    listed = summaries.pivot_mean(features.nan_to_null(gaps), "t", "c", "x", ["a"])
    assert rows(listed) == [(0, None), (1, 1.0)]


def test_outcome_rates_reach_zero_and_hundred(spark):
    df = spark.createDataFrame(
        [(1, "x"), (1, "x"), (0, "y"), (None, "y"), (1, None)], "TARGET int, c string"
    )
    got = {(r.value, r.outcome): r.percent for r in summaries.outcome_rate_by_category(df, ["c"]).collect()}
    assert got == {("x", "paid"): 0.0, ("x", "default"): 100.0, ("y", "paid"): 100.0, ("y", "default"): 0.0}
    assert rows(summaries.class_balance(df)) == [(3, 1, 0.75, 0.25)]


def test_share_counts_gaps_in_the_total(gaps):
    assert rows(summaries.share_of_total(gaps, "c")) == [("a", 2, 50.0), ("b", 1, 25.0)]


def test_histogram_keeps_empty_bins_and_closes_the_last(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,), (None,), (NAN,)], "x double")
    assert [r["count"] for r in distributions.histogram(df, "x", 5).orderBy("bin").collect()] == [2, 0, 0, 0, 1]
    same = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    found = distributions.histogram(same, "x", 2).orderBy("bin").collect()
    assert [(r.lower, r.upper, r["count"]) for r in found] == [(3.5, 4.0, 0), (4.0, 4.5, 2)]


def test_density_integrates_to_one(app):
    for bandwidth in (None, 30000.0):
        curve = distributions.density(app, "AMT_CREDIT", 200, bandwidth).orderBy("point").collect()
        step = curve[1].x - curve[0].x
        assert abs(sum(r.density for r in curve) * step - 1) < 0.01


def test_correlation_pairwise_and_complete(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0), (4.0, None, 5.0), (5.0, -100.0, None)],
        "a double, b double, k double",
    )
    complete = {(r.feature_a, r.feature_b): r["corr"] for r in distributions.correlation(df, ["a", "b"], missing="complete").collect()}
    pairs = {(r.feature_a, r.feature_b): r["corr"] for r in distributions.correlation(df, ["a", "b", "k"]).collect()}
    assert abs(complete["a", "b"] - pairs["a", "b"]) < 1e-12 and pairs["a", "b"] < 0
    assert pairs["a", "k"] is None or math.isnan(pairs["a", "k"])
    ranks = {(r.feature_a, r.feature_b): r["corr"] for r in distributions.correlation(df, ["a", "b"], "spearman").collect()}
    assert abs(ranks["a", "b"] - -0.2) < 1e-12


def test_semi_join_with_hot_keys(spark):
    # Key 1 holds a third of the rows and matches, key 2 as many copies of one row and
    # does not; null keys never match.
    data = [(1, i) for i in range(400)] + [(2, 5)] * 400 + [(k, k) for k in range(3, 400)] + [(None, 1000)]
    df = spark.createDataFrame(data, "k int, v int")
    wanted = {k for k, v in data if k is not None and v > 390}
    expected = sorted(((k, v) for k, v in data if k in wanted), key=str)
    assert rows(joins.semi_join_where(df, "k", "v > 390")) == expected


def test_attach_and_union(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(2, 5), (3, 6)], "k int, b int")
    assert rows(joins.attach_by_key(a, b, "k")) == [(2, "y", 5)]
    assert rows(joins.union_rows(a, a.select("a", "k"), ("p", "q"))) == [
        (1, "x", "p"), (1, "x", "q"), (2, "y", "p"), (2, "y", "q"),
    ]


def test_top_k_and_ties(spark):
    df = spark.createDataFrame([(3,), (None,), (5,), (5,), (1,)], "x int")
    assert [r.x for r in ordering.top_k(df, "x", 3).collect()] == [5, 5, 3]
    assert [r.x for r in ordering.top_k_distinct(df, "x", 3).collect()] == [5, 3, 1]


def curve(df, **options):
    return windows.running_class_counts(df, "s", "y", **options)


def test_scores_all_equal_and_ties(spark):
    equal = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 0)], "s double, y int")
    assert rows(evaluate.roc_auc(curve(equal))) == [(0.5,)]
    tied = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0), (None, 1), (0.3, None)], "s double, y int")
    counts = curve(tied)
    assert rows(evaluate.roc_auc(counts)) == [(0.875,)]
    assert rows(evaluate.best_threshold(counts)) == [(0.5, 0.8)]
    assert [(r.fpr, r.tpr) for r in evaluate.roc_curve(counts).orderBy("tpr", "fpr").collect()] == [
        (0.0, 0.0), (0.0, 0.5), (0.5, 1.0), (1.0, 1.0),
    ]


def test_one_class_has_no_area(spark):
    only = spark.createDataFrame([(0.5, 1), (0.7, 1)], "s double, y int")
    assert rows(evaluate.roc_auc(curve(only))) == [(None,)]
    zeros = spark.createDataFrame([(0.5, 0)], "s double, y int")
    assert rows(evaluate.recall_by_threshold(curve(zeros))) == [(0.5, None)]


def test_confusion_matrix_fills_empty_cells(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (0, 1.0)], "y int, p double")
    assert rows(evaluate.confusion_matrix(df, "y", "p")) == [(0, 0, 1), (1, 0, 2)]


def test_woe_cells_without_a_class(spark):
    df = spark.createDataFrame(
        [(1, "only_ones"), (0, "only_zeros"), (1, None), (0, None), (1, "m"), (0, "m"), (0, "m"), (None, "m")],
        "y int, c string",
    )
    got = {r.bin: (r.rows, r.events, r.non_events, r.woe, r.iv) for r in woe.woe_table(df, ["c"], "y").collect()}
    assert got["only_ones"] == (1, 1, 0, 0.0, 0.0) and got["only_zeros"] == (1, 0, 1, 0.0, 0.0)
    assert got[None][:3] == (2, 1, 1)
    assert abs(got[None][3] - math.log((1 / 3) / (1 / 4))) < 1e-12
    assert abs(got["m"][4] - (1 / 3 - 2 / 4) * math.log((1 / 3) / (2 / 4))) < 1e-12


def test_a_category_called_na_is_no_gap(spark):
    df = spark.createDataFrame([(1, "NA"), (0, "NA"), (1, None), (0, None), (0, None)], "y int, c string")
    assert {r.bin: r.rows for r in woe.woe_table(df, ["c"], "y").collect()} == {"NA": 2, None: 3}


def test_bins_of_whole_numbers_match_whatever_the_type(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (1, 2), (1, 2), (0, 2), (0, None)], "y int, c int")
    table = woe.woe_table(df, ["c"], "y")
    as_int = rows(woe.apply_woe(df, table, ["c"]).select("c_woe"))
    wide = df.withColumn("c", F.coalesce(F.col("c").cast("double"), F.lit(float("nan"))))
    assert rows(woe.apply_woe(wide, table, ["c"]).select("c_woe")) == as_int
    assert any(w for (w,) in as_int)


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_apply_woe_by_broadcast_and_shuffle(spark, limit):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        check_apply_woe(spark)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def check_apply_woe(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 1), (3, "new", None)], "id int, c string, n int")
    table = spark.createDataFrame(
        [("c", "a", 0.5), ("c", None, -0.5), ("c", "a", 0.5), ("n", "0", 1.0), ("n", "1", 2.0)],
        "feature string, bin string, woe double",
    )
    bins = spark.createDataFrame(
        [("n", 0, float("-inf"), 3.0), ("n", 1, 3.0, float("inf"))],
        "feature string, bin int, lower double, upper double",
    )
    got = woe.apply_woe(df, table, ["c", "n"], bins)
    assert rows(got.select("id", "c", "n", "c_woe", "n_woe")) == [
        (1, "a", 5, 0.5, 2.0), (2, None, 1, -0.5, 1.0), (3, "new", None, 0.0, 0.0),
    ]


def test_zscore_of_a_constant_column(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "a double, b double")
    assert rows(prep.zscore(df, ["a", "b"]).select("norm_a", "norm_b")) == [(0.0, -1.0), (0.0, 1.0)]


def test_fitted_moments_scale_other_frames(spark):
    nan = float("nan")
    train = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0), (nan, 9.0)], "a double, b double")
    moments = prep.fit_zscore(train, ["a"])
    assert moments == {"a": (2.0, 1.0)}
    test = spark.createDataFrame([(1002.0,), (nan,)], "a double")
    assert rows(prep.zscore(test, ["a"], moments=moments).select("norm_a")) == [(1000.0,), (None,)]
    far = train.na.drop().withColumn("a", F.col("a") + 1000)
    fitted = components.fit_pca(train.na.drop(), ["a", "b"], 2)
    moved = components.pca(far, ["a", "b"], 2, fitted).agg(F.avg("principal_component_1")).first()[0]
    assert abs(moved) > 100


def test_nan_is_missing_in_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", 3.0)], "k string, v double")
    assert rows(summaries.group_mean(df, ["k"], ["v"])) == [("a", 1.0), ("b", 3.0)]
    (found,) = summaries.describe_cols(df, ["v"]).collect()
    assert (found["count"], found["mean"], found["max"]) == (2, 2.0, 3.0)
    both = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (float("nan"), 6.0)], "y double, x double")
    assert rows(impute.impute_by(both, "y", "x"))[-1] == (3.0, 6.0)


def test_split_follows_the_share(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    train, test = prep.split(df, "k", 0.999)
    assert train.count() + test.count() == 20_000 and 5 <= test.count() <= 45


def test_settings_without_counterpart_are_errors(spark):
    df = spark.createDataFrame([(0, 1)], "TARGET int, features int")
    for grid in ({"max_depht": [2]}, {"lambda": [1]}, {"max_depth": [5, 50]}):
        with pytest.raises(ValueError):
            models.grid_search_boosted(df, grid, ["f"], 2)
    with pytest.raises(ValueError):
        models.boosted_estimator(max_depth=31)


def test_one_hot_keeps_all_on_request(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "c string")
    kept = prep.one_hot(df, ["c"], drop_last=False)
    wide = prep.vector_columns(kept, "cclassVec", ["b", "a"]).select("c", "b", "a")
    assert rows(wide) == [("a", 0.0, 1.0), ("b", 1.0, 0.0), ("b", 1.0, 0.0)]


def test_impute_leaves_empty_columns_and_single_columns(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 3.0, None)], "k int, a double, e double")
    got = impute.impute_chained(df, ["a", "e"])
    assert rows(got) == [(1, 1.0, None), (2, 2.0, None), (3, 3.0, None)]


def test_sample_is_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    first = rows(sample_rows(df, 10, "k", seed=3))
    assert first == rows(sample_rows(df.repartition(17), 10, "k", seed=3)) and len(first) == 10
    assert first != rows(sample_rows(df, 10, "k", seed=4))


def test_grid_without_neutral_settings():
    from loanlens import settings

    def size(grid):
        return math.prod(len(values) for values in grid.values())

    assert size(settings.LOGISTIC_GRID) == 486 and size(models.distinct_grid(settings.LOGISTIC_GRID)) == 54
    assert size(settings.FOREST_GRID) == 216


def test_shared_folder_is_required_off_one_machine():
    from types import SimpleNamespace

    from loanlens.session import work_dir

    def session(master, named=None, set_dir=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: set_dir)
        conf = SimpleNamespace(get=lambda key, default: named)
        return SimpleNamespace(sparkContext=context, conf=conf)

    assert work_dir(session("yarn", named="hdfs:///shared")) == "hdfs:///shared"
    assert work_dir(session("yarn", set_dir="hdfs:///set")) == "hdfs:///set"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(session("yarn"))


def test_missing_category_is_not_dropped(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, None, 0)], "id int, c string, y int")
    ready = prep.prep_pipeline(["c"], ["id"], "y").fit(df).transform(df)
    assert [list(r.features.toArray()) for r in ready.orderBy("id").collect()] == [[1.0, 1.0], [0.0, 2.0]]
    two = df.union(spark.createDataFrame([(3, "b", 1)], df.schema))
    with pytest.raises(Exception, match="(?i)null"):
        prep.one_hot(two, ["c"]).collect()


def test_carry_fill_keeps_rows_when_order_keys_repeat(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (2, None)], "k int, w string")
    assert windows.carry_fill(df, ["w"], "k", buckets=3).count() == 4
