"""Sorting and first-k reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_rows(df: DataFrame, cols: Sequence[str | Column]) -> DataFrame:
    return df.orderBy(*cols)


def top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k largest values. Each task keeps k rows; there is no full sort."""
    return df.select(col).orderBy(F.desc_nulls_last(col)).limit(k)


def top_k_distinct(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k largest different values; duplicates collapse before the shuffle."""
    return df.select(col).distinct().orderBy(F.desc_nulls_last(col)).limit(k)


def head(df: DataFrame, k: int) -> DataFrame:
    """First k rows of a sorted frame."""
    return df.limit(k)
