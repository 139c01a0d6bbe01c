"""Histograms, densities and correlations, always as tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.functions import nan_to_null
from loanlens.operators.features import log_feature
from loanlens.operators.grams import pairwise_sums
from loanlens.operators.windows import running_totals_by
from loanlens.session import settle, small_frame


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width counts between minimum and maximum, empty bins included.

    The last bin is closed on the right. Two column-pruned passes: one for the
    limits, one that shuffles at most ``bins`` partial counts per task.
    """
    value = nan_to_null(F.col(col).cast("double"))
    lo, hi = F.min(value), F.max(value)
    # A column with a single value gets an interval of width one around it.
    limits = df.agg(
        F.struct(
            F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"),
            F.when(lo == hi, hi + 0.5).otherwise(hi).alias("hi"),
        ).alias("limits")
    ).scalar()
    width = (limits["hi"] - limits["lo"]) / bins
    position = F.least(F.floor((value - limits["lo"]) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(value.isNotNull()).groupBy(position.alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    # The counts hold at most one row per bin, so broadcasting them is bounded by ``bins``.
    return all_bins.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (limits["lo"] + F.col("bin") * width).alias("lower"),
        (limits["lo"] + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def log_distribution(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Histogram of the natural logarithm; values of zero and below have none."""
    return histogram(log_feature(df, col, "_log"), "_log", bins)


def density(
    df: DataFrame, col: str, grid: int = 100, bandwidth: float | None = None, bins: int = 1000
) -> DataFrame:
    """Gaussian kernel density on an even grid.

    Rows are counted into ``bins`` first and each bin's middle weighted by its
    count, so the kernel work is bins times grid points and does not grow with
    the rows. Without a bandwidth Scott's rule gives it. The grid reaches three
    bandwidths past both ends.
    """
    value = nan_to_null(F.col(col).cast("double"))
    spread = F.stddev_samp(value) * F.pow(F.count(value).cast("double"), F.lit(-0.2))
    stats = df.agg(
        F.struct(
            F.min(value).alias("lo"),
            F.max(value).alias("hi"),
            F.count(value).alias("n"),
            (F.lit(float(bandwidth)) if bandwidth is not None else spread).alias("h"),
        ).alias("stats")
    ).scalar()
    h = stats["h"]
    start = stats["lo"] - 3 * h
    step = (stats["hi"] - stats["lo"] + 6 * h) / (grid - 1)
    points = (
        histogram(df, col, bins)
        .where(F.col("count") > 0)
        .select(
            ((F.col("lower") + F.col("upper")) / 2).alias("middle"),
            "count",
            F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"),
        )
        .withColumn("x", start + F.col("point") * step)
    )
    kernel = F.exp(-0.5 * F.pow((F.col("x") - F.col("middle")) / h, F.lit(2.0)))
    return (
        points.groupBy("point")
        .agg(F.max("x").alias("x"), F.sum(F.col("count") * kernel).alias("_sum"))
        .select(
            "point",
            "x",
            F.try_divide(F.col("_sum"), stats["n"] * h * math.sqrt(2 * math.pi)).alias("density"),
        )
    )


def _long(spark: SparkSession, cols: Sequence[str], matrix: np.ndarray) -> DataFrame:
    rows = [
        (a, b, None if np.isnan(matrix[i, j]) else float(matrix[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)
    ]
    return small_frame(spark, rows, "feature_a string, feature_b string, corr double")


def _pearson(sums: tuple[np.ndarray, ...]) -> np.ndarray:
    """Correlations from pairwise sums; NaN for a pair in which a column is constant."""
    n, first, second, product = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = second - first**2 / n
        spread = np.where(spread > 1e-12 * np.maximum(second, 1e-300), spread, np.nan)
        return (product - first * first.T / n) / np.sqrt(spread * spread.T)


def _standard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The columns as an array, less their means and by their deviations, which keeps sums
    of products exact; gaps and NaN are null."""
    values = [nan_to_null(F.col(name).cast("double")) for name in cols]
    facts = df.agg(
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(values)]
    ).head()
    return df.select(
        F.array(*[(v - F.lit(facts[f"m{i}"])) / F.lit(facts[f"s{i}"] or 1.0) for i, v in enumerate(values)]).alias("x")
    )


def _ranked(df: DataFrame) -> DataFrame:
    """Rows of an array column ``x`` with each element replaced by its average rank.

    All columns are ranked together, by (column, value): ties collapse map-side, and a value
    that very many rows share is one row of the lookup, whose join adaptive execution splits.
    """
    rows = settle(df.select(F.monotonically_increasing_id().alias("_row"), "x"))
    value = (F.col("col") + F.lit(0.0)).alias("value")  # one zero
    long = rows.select("_row", F.posexplode("x")).select("_row", F.col("pos").alias("i"), value)
    counts = settle(long.groupBy("i", "value").agg(F.count(F.lit(1)).alias("n")))
    ranks = running_totals_by(counts, ["i"], "value", ["n"])
    ranks = ranks.select("i", "value", (F.col("running_n") - (F.col("n") - 1) / 2).alias("rank"))
    listed = F.sort_array(F.collect_list(F.struct("i", "rank")))
    return long.join(ranks, ["i", "value"]).groupBy("_row").agg(listed["rank"].alias("x")).select("x")


def correlation(
    df: DataFrame, cols: Sequence[str], method: str = "pearson", missing: str = "pairwise"
) -> DataFrame:
    """Correlation matrix in long form (feature_a, feature_b, corr); null where a column is
    constant.

    ``missing="pairwise"`` leaves out a row only for the pairs it has a gap in,
    ``"complete"`` for all. Spearman is Pearson on the ranks of the rows without gaps.
    Batches add up the products of all pairs at once, so the number of passes and shuffles
    does not depend on that of columns; only sums reach the driver.
    """
    if method == "spearman" or missing == "complete":
        df = df.select([F.col(name).cast("double") for name in cols]).na.drop()
    if method == "spearman":
        ranks = settle(_ranked(df.select(F.array(*cols).alias("x"))))
        names = [f"r{i}" for i in range(len(cols))]
        df = ranks.select(*[F.col("x")[i].alias(n) for i, n in enumerate(names)])
        return _long(df.sparkSession, cols, _matrix(df, names))
    return _long(df.sparkSession, cols, _matrix(df, cols))


def _matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    sums = pairwise_sums(_standard(df, cols))
    return _pearson(sums) if sums[0].size else np.full((len(cols), len(cols)), np.nan)
