"""Preparation stages: saved and loaded ones do what fitted ones do."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from loanlens.operators import prep, stages, windows


def test_saved_chain_gives_equal_rows(app, tmp_path):
    df = app.withColumn("AMT_GOODS_PRICE", F.when(F.col("SK_ID_CURR") % 3 > 0, F.col("AMT_GOODS_PRICE")))
    train, test = prep.split(df, "SK_ID_CURR")
    chain = Pipeline(
        stages=[
            stages.CreditFeatures(),
            stages.CarryFill.of(["OCCUPATION_TYPE"], "SK_ID_CURR"),
            stages.ChainedImputer.of(["AMT_GOODS_PRICE", "AMT_CREDIT", "CNT_CHILDREN"], rounds=3),
            stages.CastColumns.of(["AMT_GOODS_PRICE"], "int"),
            stages.ZScore.of(["AMT_CREDIT"]),
            stages.WeightOfEvidence.of(["AMT_GOODS_PRICE", "OCCUPATION_TYPE", "CODE_GENDER"], "TARGET"),
        ]
    )
    chain.save(str(tmp_path / "chain"))
    fitted = Pipeline.load(str(tmp_path / "chain")).fit(train)
    fitted.save(str(tmp_path / "fitted"))
    again = PipelineModel.load(str(tmp_path / "fitted"))
    a, b = (m.transform(test).orderBy("SK_ID_CURR").collect() for m in (fitted, again))
    assert a == b and len(a) == test.count()
    assert all(r.AMT_GOODS_PRICE is not None and r.OCCUPATION_TYPE is not None and r.AMT_GOODS_PRICE_woe is not None for r in a)
    assert {"norm_AMT_CREDIT", "CODE_GENDER_woe", "YEARS_OLD"} <= set(a[0].asDict())


def test_index_of_very_many_categories(spark):
    """A hundred thousand values, nearly all of them equally frequent."""
    rows = spark.range(100_000).select(F.concat(F.lit("v"), F.col("id")).alias("c"), F.lit("same").alias("d"))
    rows = rows.unionByName(spark.createDataFrame([("v7", "same"), ("v7", None), ("v500", "other"), (None, None)], "c string, d string"))
    fitted = prep.fit_index(rows, ["c", "d"])
    got = prep.index_labels(rows, ["c", "d"], fitted=fitted)
    assert got.columns == ["c", "d", "cIndex", "dIndex"] and got.count() == 100_004
    at = {r.c: r.cIndex for r in got.where("c IN ('v7', 'v500', 'v0', 'v1', 'v99999') OR c IS NULL").collect()}
    assert at == {"v7": 0.0, "v500": 1.0, "v0": 2.0, "v1": 3.0, "v99999": 99_999.0, None: 100_000.0}
    assert got.select("cIndex").distinct().count() == 100_001
    assert {(r.d, r.dIndex) for r in got.select("d", "dIndex").distinct().collect()} == {("same", 0.0), ("other", 1.0), (None, 2.0)}
    assert prep.index_labels(rows.limit(0), ["c"]).count() == 0


def test_rows_without_an_order_key_are_filled_without_a_window(spark):
    df = spark.createDataFrame([(None, None), (None, "x"), (None, None), (2, "b"), (1, None), (3, None)], "k int, w string")
    got = sorted(((r.k or 0, r.w) for r in windows.carry_fill(df, ["w"], "k", buckets=2).collect()))
    assert got == [(0, "b"), (0, "b"), (0, "x"), (1, "b"), (2, "b"), (3, "b")]
