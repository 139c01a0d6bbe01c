"""Bins and weights of many columns are looked up batch by batch, in one call."""

from bisect import bisect_left, bisect_right
from math import copysign, inf, isnan, nan

from loanlens.operators import trees, woe

CUTS = [-1.0, 0.0, 2.5]
VALUES = [None, nan, -inf, -1.5, -1.0, -0.5, -0.0, 0.0, 1.0, 2.5, 3.0, inf]
COLUMNS = [f"c{i}" for i in range(12)]


def frame(spark):
    return spark.createDataFrame([(float(i), *[v] * 12) for i, v in enumerate(VALUES)], ", ".join(f"{n} double" for n in ["k", *COLUMNS]))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_weights_of_many_numeric_columns(spark):
    lowers = [-inf, *CUTS]
    bins = spark.createDataFrame([(n, low) for n in COLUMNS for low in lowers], "feature string, lower double")
    # The last interval has no weight.
    table = [(n, b, float(w)) for n in COLUMNS for b, w in ((None, 9), ("0", 1), ("1", 2), ("2", 3))]
    table = spark.createDataFrame(table, "feature string, bin string, woe double")
    found = woe.apply_woe(frame(spark), table, COLUMNS, bins)
    assert "UDF(" not in plan(found) and plan(found).count("ArrowEvalPython") == 1

    def weight(v):
        if v is None or isnan(v):
            return 9.0
        # -0.0 comes before 0.0, as in the fitted bins.
        below = v == 0 and copysign(1, v) < 0
        return [1.0, 2.0, 3.0, 0.0][bisect_left(CUTS, v) if below else bisect_right(CUTS, v)]

    for row in found.collect():
        assert [row[f"{n}_woe"] for n in COLUMNS] == [weight(VALUES[int(row["k"])])] * 12
    fitted = {r["k"]: r["c0"] for r in woe.assign_bins(frame(spark), bins).collect()}
    for row in found.collect():
        assert row["c0_woe"] == {None: 9.0, 0: 1.0, 1: 2.0, 2: 3.0, 3: 0.0}[fitted[row["k"]]]


def test_bin_numbers_of_many_columns(spark):
    none = (None,)
    df = frame(spark).selectExpr("*", "CASE WHEN k = 1 THEN 'a' WHEN k = 2 THEN 'b' WHEN k = 3 THEN 'new' END AS s")
    bins = trees.Bins((*COLUMNS, "one", "s"), (*[tuple(CUTS)] * 12, (), None), (*none * 13, ("a", "b")))
    found = trees.binned(df.withColumn("one", df["c0"]), [bins], "k", keep=["k"])
    assert "UDF(" not in plan(found) and plan(found).count("ArrowEvalPython") == 1
    for row in found.collect():
        v = VALUES[int(row["k"])]
        gap = v is None or isnan(v)
        assert row["x0"] == [0 if gap else bisect_left(CUTS, v) + 1] * 12 + [0 if gap else 1] + [{1: 1, 2: 2}.get(row["k"], 0)]
