"""Results must not depend on how rows are spread, nor on the number of buckets."""

import pytest
from pyspark.sql import functions as F

from loanlens.operators import prep, windows

SPREADS = [(1, 1), (4, 3), (17, 29)]


def brute_fill(values):
    filled, last = [], None
    for value in values:
        last = value if value is not None else last
        filled.append(last)
    first = next((v for v in values if v is not None), None)
    return [first if v is None else v for v in filled]


@pytest.mark.parametrize("parts, buckets", SPREADS)
def test_carry_fill(spark, parts, buckets):
    # Long gaps at both ends and across several buckets; one column is empty.
    words = [None if i < 40 or i > 460 or 100 < i < 260 or i % 3 else f"w{i}" for i in range(500)]
    df = spark.createDataFrame(
        [(i * 7, word, None) for i, word in enumerate(words)], "k bigint, w string, e string"
    ).repartition(parts)
    got = windows.carry_fill(df, ["w", "e"], "k", buckets=buckets).orderBy("k").collect()
    assert [r.w for r in got] == brute_fill(words)
    assert {r.e for r in got} == {None} and [r.k for r in got] == [i * 7 for i in range(500)]


@pytest.mark.parametrize("parts, buckets", SPREADS)
def test_running_class_counts(spark, parts, buckets):
    # A third of the rows share one score.
    data = [(0.5 if i % 3 == 0 else (i * 37 % 101) / 101, int(i * 13 % 7 == 0)) for i in range(900)]
    df = spark.createDataFrame(data, "s double, y int").repartition(parts)
    got = windows.running_class_counts(df, "s", "y", buckets=buckets).collect()
    for row in got:
        above = [y for s, y in data if s >= row.threshold]
        assert (row.ones_above, row.rows_above) == (sum(above), len(above))
        assert (row.total_ones, row.total_rows) == (sum(y for _, y in data), len(data))
    assert len(got) == len({s for s, _ in data})


@pytest.mark.parametrize("parts, buckets", SPREADS)
def test_running_totals_by_key(spark, parts, buckets):
    df = spark.range(300).select((F.col("id") * 3).alias("k"), (F.col("id") % 5).alias("v"))
    got = windows.running_totals(df.repartition(parts), "k", ["v"], buckets=buckets)
    expected, total = {}, 0
    for i in range(300):
        total += i % 5
        expected[i * 3] = total
    assert {r.k: r.running_v for r in got.collect()} == expected


@pytest.mark.parametrize("parts, buckets", SPREADS)
def test_split_and_folds(app, parts, buckets):
    df = app.select("SK_ID_CURR", "TARGET")
    train, test = prep.split(df, "SK_ID_CURR")
    spread, _ = prep.split(df.repartition(parts), "SK_ID_CURR")
    assert sorted(train.collect()) == sorted(spread.collect())
    assert train.count() + test.count() == df.count()

    one = prep.stratified_folds(df, "TARGET", "SK_ID_CURR", k=10, repeats=2, buckets=1)
    more = prep.stratified_folds(df.repartition(parts), "TARGET", "SK_ID_CURR", k=10, repeats=2, buckets=buckets)
    assert sorted(one.collect()) == sorted(more.select(one.columns).collect())
    for fold in ("fold_1", "fold_2"):
        for label in (0, 1):
            sizes = [r["count"] for r in more.where(F.col("TARGET") == label).groupBy(fold).count().collect()]
            assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1


def test_scratch_tables_go_with_their_block(spark):
    import os

    from loanlens.session import new_path, scratch, settle

    with scratch(spark):
        path = new_path(spark, "mine")
        spark.range(5).write.parquet(path)
        kept = settle(spark.range(3))
        folder = path.removeprefix("file:")
        assert kept.count() == 3 and os.path.exists(folder)
    assert not os.path.exists(folder)
