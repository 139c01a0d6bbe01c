"""Joins and row unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.operators.summaries import _predicate


def semi_join_where(df: DataFrame, key: str, predicate: Column | str) -> DataFrame:
    """Rows whose key is among the keys of the rows that meet the predicate.

    The predicate filters at the scan and its keys are reduced to one row each before
    they are shuffled. Rows of a key that holds many rows are split by adaptive
    execution, as the other side has one row for it.
    """
    keys = df.where(_predicate(predicate)).where(F.col(key).isNotNull()).select(key).distinct()
    return df.join(keys, key, "left_semi").select(*df.columns)


def attach_by_key(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Put two frames side by side by their unique key.

    Both sides have one row per key, so the shuffle is even. Columns of one
    frame need no join: keep them in that frame.
    """
    return left.join(right, key, how)


def union_rows(a: DataFrame, b: DataFrame, tags: tuple[str, str], tag: str = "tag") -> DataFrame:
    """Stack two frames by column name and say which one each row came from."""
    return a.withColumn(tag, F.lit(tags[0])).unionByName(b.withColumn(tag, F.lit(tags[1])))
