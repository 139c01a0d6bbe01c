"""Projections, filters and derived columns. None of them shuffles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens import functions as C
from loanlens.settings import EMPLOYMENT_SENTINEL


def select_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def drop_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns; names the frame lacks are ignored."""
    return df.drop(*cols)


def cast_cols(df: DataFrame, cols: Sequence[str], type_: str) -> DataFrame:
    """Cast a list of columns; a value that does not fit the type becomes null."""
    return df.withColumns({name: F.col(name).try_cast(type_) for name in cols})


def rename_cols(
    df: DataFrame, mapping: Mapping[str, str] | None = None, prefix: str | None = None
) -> DataFrame:
    """Rename by mapping, or put a prefix before every name."""
    if prefix is not None:
        mapping = {name: prefix + name for name in (mapping or df.columns)}
    return df.withColumnsRenamed(dict(mapping or {}))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating-point column, so aggregates skip it."""
    floating = [
        field.name
        for field in df.schema.fields
        if isinstance(field.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({name: C.nan_to_null(name) for name in floating})


def sentinel_to_null(df: DataFrame, col: str, value) -> DataFrame:
    return df.withColumn(col, C.sentinel_to_null(col, value))


def years_from_days(df: DataFrame, col: str, out: str, digits: int = 1) -> DataFrame:
    return df.withColumn(out, C.years_from_days(col, digits))


def ratio(df: DataFrame, num: str, den: str, out: str, digits: int = 0) -> DataFrame:
    return df.withColumn(out, C.ratio(num, den, digits))


def log_feature(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.withColumn(out, C.log_or_null(col))


def add_credit_features(df: DataFrame) -> DataFrame:
    """Ages, durations, ratios and logarithms of an application.

    Two steps of independent columns; the optimiser merges them with the scan's
    own projection.
    """
    days_employed = C.sentinel_to_null("DAYS_EMPLOYED", EMPLOYMENT_SENTINEL)
    return df.withColumns(
        {
            "DAYS_EMPLOYED": days_employed,
            "YEARS_OLD": C.years_from_days("DAYS_BIRTH"),
            "YEARS_EMPLOYED": C.years_from_days(days_employed),
            "ANNUITY_INCOME_PERCENTAGE": C.ratio("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
            "CREDIT_INCOME_PERCENTAGE": C.ratio("AMT_CREDIT", "AMT_INCOME_TOTAL"),
            "CREDIT_DURATION": C.ratio("AMT_CREDIT", "AMT_ANNUITY"),
            "LOG_INCOME_TOTAL": C.log_or_null("AMT_INCOME_TOTAL"),
            "LOG_ANNUITY": C.log_or_null("AMT_ANNUITY"),
            "LOG_CREDIT": C.log_or_null("AMT_CREDIT"),
        }
    ).withColumns(
        {
            "EMP_AGE_PERCENTAGE": C.ratio("YEARS_EMPLOYED", "YEARS_OLD"),
            "LOG_YEARS_EMPLOYED": C.log_or_null("YEARS_EMPLOYED"),
        }
    )


def filter_rows(df: DataFrame, predicate: Column | str) -> DataFrame:
    return df.where(predicate)


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the rows that have a value (neither null nor NaN) in all of the columns."""
    return df.na.drop(subset=list(cols))


def fill_missing(df: DataFrame, value, cols: Sequence[str]) -> DataFrame:
    return df.na.fill(value, subset=list(cols))


def apply_threshold(df: DataFrame, score: str, cut: float, out: str = "prediction") -> DataFrame:
    return df.withColumn(out, C.threshold_flag(score, cut))


def range_filter(df: DataFrame, col: str, lo, hi) -> DataFrame:
    return df.where(F.col(col).between(lo, hi))
