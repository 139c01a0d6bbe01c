"""Grouped and whole-table summaries.

Each is one pass with a map-side partial aggregate, so what is shuffled grows
with the number of groups and tasks, not with the rows, and a value that holds
a third of all rows costs no more than a rare one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.functions import is_missing, known


def _rows(structs: list[Column]) -> Column:
    return F.inline(F.array(*structs))


def _predicate(predicate: Column | str) -> Column:
    return F.expr(predicate) if isinstance(predicate, str) else predicate


def group_mean(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean of each column per group. Gaps and NaN do not count."""
    return df.groupBy(*keys).agg(*[F.avg(known(df, name)).alias(f"avg_{name}") for name in cols])


def describe_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum of what is known, one row per column."""
    one_row = df.agg(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.count(known(df, name)).alias("count"),
                F.avg(known(df, name)).alias("mean"),
                F.stddev_samp(known(df, name)).alias("stddev"),
                F.min(known(df, name)).cast("double").alias("min"),
                F.max(known(df, name)).cast("double").alias("max"),
            ).alias(f"s{position}")
            for position, name in enumerate(cols)
        ]
    )
    return one_row.select(_rows([F.col(f"s{position}") for position in range(len(cols))]))


def crosstab(df: DataFrame, a: str, b: str, values: Sequence | None = None) -> DataFrame:
    """Counts of each pair of values; 0 for an empty cell. Give the values of b to
    spare the job that looks for them."""
    return df.groupBy(a).pivot(b, list(values) if values is not None else None).count().na.fill(0)


def pivot_mean(
    df: DataFrame, key: str, col: str, value: str, values: Sequence | None = None
) -> DataFrame:
    """Mean of value per key, one column per category, or per listed category."""
    wide = df.groupBy(key).pivot(col, list(values) if values is not None else None)
    return wide.agg(F.avg(known(df, value)))


def count_where(df: DataFrame, predicate: Column | str) -> DataFrame:
    return df.agg(F.count_if(_predicate(predicate)).alias("count"))


def group_count(df: DataFrame, key: str, label: str = "TARGET") -> DataFrame:
    """Defaults, non-defaults and all applicants per value of the key, in one pass."""
    return (
        df.groupBy(key)
        .agg(
            F.count_if(F.col(label) == 1).alias("defaults"),
            F.count_if(F.col(label) == 0).alias("non_defaults"),
            F.count(F.lit(1)).alias("applicants"),
        )
        .orderBy(key)
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each value, most frequent first; nulls are left out."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), col)
    )


def share_of_total(
    df: DataFrame, col: str, top: int | None = None, digits: int = 0
) -> DataFrame:
    """Percent of all rows per value, optionally of the first values only."""
    total = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    counts = value_counts(df, col)
    counts = counts.limit(top) if top is not None else counts
    return counts.select(
        col, "count", F.round(F.try_divide(100.0 * F.col("count"), total), digits).alias("percent")
    )


def outcome_rate_by_category(
    df: DataFrame, dims: Sequence[str], label: str = "TARGET", digits: int = 1
) -> DataFrame:
    """Percent paid and percent default for each value of each dimension.

    All dimensions are turned into (dimension, value) rows, so the table is
    scanned and shuffled once however many dimensions there are.
    """
    long = (
        df.select(label, *[F.col(name).cast("string").alias(name) for name in dims])
        .unpivot([label], list(dims), "dimension", "value")
        .where(F.col("value").isNotNull() & F.col(label).isNotNull())
    )
    counts = long.groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("applicants"),
        F.count_if(F.col(label) == 1).alias("ones"),
        F.count_if(F.col(label) == 0).alias("zeros"),
    )

    def outcome(name: str, n: str) -> Column:
        percent = F.round(100.0 * F.col(n) / F.col("applicants"), digits)
        return F.struct(F.lit(name).alias("outcome"), percent.alias("percent"))

    return counts.select(
        "dimension",
        "value",
        "applicants",
        _rows([outcome("paid", "zeros"), outcome("default", "ones")]),
    )


def class_balance(df: DataFrame, label: str = "TARGET") -> DataFrame:
    """Counts and shares of ones and zeros; rows without a label are left out."""
    return df.agg(
        F.count_if(F.col(label) == 1).alias("ones"),
        F.count_if(F.col(label) == 0).alias("zeros"),
    ).select(
        "ones",
        "zeros",
        F.try_divide(F.col("ones").cast("double"), F.col("ones") + F.col("zeros")).alias("share_ones"),
        F.try_divide(F.col("zeros").cast("double"), F.col("ones") + F.col("zeros")).alias("share_zeros"),
    )


def missing_profile(df: DataFrame, exclude: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """Gaps and percent of gaps per column, most gaps first, in one pass over all columns."""
    fields = [field for field in df.schema.fields if field.name not in exclude]
    floating = (T.DoubleType, T.FloatType)
    one_row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.count_if(is_missing(field.name, isinstance(field.dataType, floating))).alias(f"g{position}")
            for position, field in enumerate(fields)
        ],
    )
    gaps = one_row.select(
        "n",
        _rows(
            [
                F.struct(F.lit(field.name).alias("column"), F.col(f"g{position}").alias("missing"))
                for position, field in enumerate(fields)
            ]
        ),
    )
    profile = gaps.select(
        "column",
        "missing",
        F.round(F.try_divide(100.0 * F.col("missing"), F.col("n")), 3).alias("percent"),
    ).orderBy(F.desc("missing"), "column")
    return profile.limit(top) if top is not None else profile


def distinct_missing_rates(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    return missing_profile(df, exclude).select("percent").distinct().orderBy(F.desc("percent"))
