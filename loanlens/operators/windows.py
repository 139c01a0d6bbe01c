"""Values that run along one global order.

A window without partitions would put the whole table into one task. Here the
order is cut into buckets at its quantiles; each bucket is reduced to one row,
those rows (one per bucket) are run through the order and broadcast back, and
the window proper works inside the buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.session import settle


def _cut_points(df: DataFrame, order: str, buckets: int | None) -> list[float]:
    """Quantiles of the order column, as many as the session has shuffle partitions."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(F.col(order).cast("double").alias("v"))
    cuts = values.approxQuantile("v", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    return sorted(set(cuts))


def _with_bucket(df: DataFrame, order: str, cuts: Sequence[float]) -> DataFrame:
    """Number the buckets along the order; a null sorts first, so it gets bucket -1."""
    if not cuts:
        return df.withColumn("_bucket", F.lit(0))
    split = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")],
        inputCol="_order",
        outputCol="_place",
        handleInvalid="keep",
    )
    placed = split.transform(df.withColumn("_order", F.col(order).cast("double")))
    bucket = F.when(F.col(order).isNull(), F.lit(-1)).otherwise(F.col("_place").cast("int"))
    return placed.withColumn("_bucket", bucket).drop("_order", "_place")


def carry_fill(
    df: DataFrame, cols: Sequence[str], order_key: str, buckets: int | None = None
) -> DataFrame:
    """Fill gaps with the last value before them; leading gaps with the first value.

    ``order_key`` is a unique number, date or timestamp; rows without one come before all
    others and get the first value. Per bucket and column only
    the order key of the last filled row is aggregated (fixed width, so by hash and
    without a sort); the few rows to carry from are then looked up by key.
    """
    placed = _with_bucket(df, order_key, _cut_points(df, order_key, buckets))
    filled = {name: F.when(F.col(name).isNotNull(), F.col(order_key)) for name in cols}
    ends = placed.groupBy("_bucket").agg(
        *[F.max(filled[name]).alias(f"_last_{name}") for name in cols],
        *[F.min(filled[name]).alias(f"_first_{name}") for name in cols],
    )
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = settle(
        ends.select(
            "_bucket",
            *[
                F.coalesce(
                    F.last(f"_last_{name}", ignorenulls=True).over(before),
                    F.min(f"_first_{name}").over(whole),
                ).alias(f"_from_{name}")
                for name in cols
            ],
        )
    )
    # At most one row per bucket and column.
    wanted = sources.select(
        F.explode(F.array_distinct(F.array(*[f"_from_{name}" for name in cols]))).alias("_key")
    ).distinct()
    rows = settle(
        df.select(F.col(order_key).alias("_key"), *cols)
        .join(F.broadcast(wanted), "_key", "left_semi")
        .groupBy("_key")
        .agg(*[F.max(name).alias(name) for name in cols])
    )
    carried = sources
    for name in cols:
        lookup = rows.select(F.col("_key").alias(f"_from_{name}"), F.col(name).alias(f"_carry_{name}"))
        carried = carried.join(F.broadcast(lookup), f"_from_{name}", "left").drop(f"_from_{name}")

    inside = (
        Window.partitionBy("_bucket").orderBy(order_key).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = placed.join(F.broadcast(carried), "_bucket")
    # Rows without an order key have nothing before them, so they need no window.
    keyed = joined.where("_bucket >= 0").withColumns(
        {
            name: F.coalesce(F.last(name, ignorenulls=True).over(inside), F.col(f"_carry_{name}"))
            for name in cols
        }
    )
    unkeyed = joined.where("_bucket < 0").withColumns({name: F.coalesce(name, f"_carry_{name}") for name in cols})
    return keyed.unionByName(unkeyed).select(*df.columns)


def running_totals(
    df: DataFrame,
    order: str,
    values: Sequence[str],
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``running_<value>``: the sum of value up to and including this order value.

    ``order`` holds a different number in every row, so the quantile buckets are
    even. The frame is read three times (cuts, bucket sums, result); settle it
    first if it is costly.
    """
    def direct(name: str) -> Column:
        return F.desc(name) if descending else F.asc(name)

    placed = _with_bucket(df, order, _cut_points(df, order, buckets))
    sums = placed.groupBy("_bucket").agg(*[F.sum(name).alias(f"_sum_{name}") for name in values])
    before = Window.orderBy(direct("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_bucket", *[F.sum(f"_sum_{name}").over(before).alias(f"_before_{name}") for name in values]
    )
    inside = (
        Window.partitionBy("_bucket")
        .orderBy(direct(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = placed.join(F.broadcast(offsets), "_bucket").withColumns(
        {
            f"running_{name}": F.sum(name).over(inside) + F.coalesce(f"_before_{name}", F.lit(0))
            for name in values
        }
    )
    return running.select(*df.columns, *[f"running_{name}" for name in values])


def running_totals_by(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], descending: bool = False, buckets: int | None = None
) -> DataFrame:
    """``running_totals`` within each of the few groups that the keys make, all at once.

    ``order`` holds a different number in every row of a group. Each group is cut at its
    own quantiles, so one shuffle by group and bucket is even however large a group is.
    The frame is read three times; settle it first if it is costly.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)] or [0.5]
    edges = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(order, shares, 10 * n)).alias("_edges"))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    edges = settle(edges)
    bucket = F.expr(f"size(filter(_edges, e -> e < `{order}`))")
    placed = df.join(F.broadcast(edges), same(df, edges), "left").select(*[df[c] for c in df.columns], bucket.alias("_bucket"))
    sums = placed.groupBy(*keys, "_bucket").agg(*[F.sum(name).alias(f"_sum_{name}") for name in values])
    direct = F.desc if descending else F.asc
    before = Window.partitionBy(*keys).orderBy(direct("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_before_{v}") for v in values])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(direct(order)).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *[F.sum(v).over(inside).alias(f"_in_{v}") for v in values])
    joined = summed.join(F.broadcast(offsets), [*same(summed, offsets), summed["_bucket"] == offsets["_bucket"]])
    return joined.select(*[summed[c] for c in df.columns], *[(F.col(f"_in_{v}") + F.col(f"_before_{v}")).alias(f"running_{v}") for v in values])


def cumulative_share(df: DataFrame, order: str, value: str) -> DataFrame:
    """Running sum of a value's share of its total, along the order."""
    total = df.agg(F.sum(value).cast("double")).scalar()
    shares = df.select(order, F.try_divide(F.col(value), total).alias("share"))
    return running_totals(shares, order, ["share"]).withColumnRenamed(
        "running_share", "cumulative_share"
    )


def running_class_counts(
    df: DataFrame, score: str, label: str, buckets: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Ones and rows with at least each score; every curve derives from this table.

    Equal scores are one row, collapsed map-side, so a score that a third of the
    rows share weighs no more than any other. That table is written once: the
    scoring behind it is not repeated by the later passes. With ``by``, as a model
    and a part of the data, the counts of all its groups are made in one shuffle.
    """
    per_score = settle(
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("threshold"))
        .agg(F.count_if(F.col(label) == 1).alias("ones"), F.count(F.lit(1)).alias("rows"))
    )
    totals = (F.sum("ones").alias("ones"), F.sum("rows").alias("rows"))
    if by:
        running = running_totals_by(per_score, by, "threshold", ["ones", "rows"], True, buckets)
        all_ = per_score.groupBy(*by).agg(*[t.alias(f"total_{n}") for t, n in zip(totals, ("ones", "rows"))])
        running = running.join(F.broadcast(all_), [running[k].eqNullSafe(all_[k]) for k in by]).select(
            *[running[c] for c in running.columns], "total_ones", "total_rows"
        )
        all_ones, all_rows = F.col("total_ones"), F.col("total_rows")
    else:
        running = running_totals(per_score, "threshold", ["ones", "rows"], descending=True, buckets=buckets)
        found = per_score.agg(F.struct(*totals).alias("totals")).scalar()
        all_ones, all_rows = found["ones"], found["rows"]
    return running.select(
        *by,
        "threshold",
        "ones",
        "rows",
        F.col("running_ones").alias("ones_above"),
        F.col("running_rows").alias("rows_above"),
        all_ones.alias("total_ones"),
        all_rows.alias("total_rows"),
    )
