"""Packing into optimal length buckets.

A document of more than ``max_len`` tokens is cut into pieces of at most ``max_len``;
nothing is dropped. The histogram of piece lengths has at most ``max_len + 1`` bins
whatever the size of the corpus, so it alone goes to the driver, where dynamic
programming chooses the bucket boundaries with the least padding. Inside a bucket
the pieces stand in hash order and are cut into batches whose padded size is at
most the token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.common import hash_slice
from loanlens.session import settle

#: Pieces that one task numbers; the number of slices follows the data.
SLICE_ROWS = 20_000


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bucket boundaries that minimise padding.

    ``lengths`` are the distinct lengths in ascending order and ``counts`` their rows.
    Of equally good choices the one with the smallest boundaries from the right wins.
    """
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    size = len(lengths)
    if not size:
        return []
    buckets = min(buckets, size)
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(lengths * counts)])
    worst = np.iinfo(np.int64).max // 4
    best = np.full(size + 1, worst)
    best[0] = 0
    came_from = []
    for _ in range(buckets):
        now, origin = np.full(size + 1, worst), np.zeros(size + 1, dtype=np.int64)
        for end in range(1, size + 1):
            padding = lengths[end - 1] * (rows[end] - rows[:end]) - (tokens[end] - tokens[:end])
            total = best[:end] + padding
            origin[end] = total.argmin()
            now[end] = total[origin[end]]
        best = now
        came_from.append(origin)
    found, end = [], size
    for origin in reversed(came_from):
        found.append(int(lengths[end - 1]))
        end = int(origin[end])
    return found[::-1]


def pieces(df: DataFrame, key: str, length: Column, max_len: int) -> DataFrame:
    """One row per piece: key, piece, start_token, n_tokens.

    A document without tokens, or with a null length, is one piece of length 0.
    """
    length = F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("bigint")
    last = F.greatest(F.floor((F.col("length") - 1) / F.lit(max_len)), F.lit(0)).cast("bigint")
    start = F.col("piece") * max_len
    return (
        df.select(F.col(key).alias(key), length.alias("length"))
        .select(key, "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
        .select(
            key,
            "piece",
            start.alias("start_token"),
            F.least(F.lit(max_len), F.col("length") - start).cast("bigint").alias("n_tokens"),
        )
    )


def pack_buckets(
    df: DataFrame, key: str, length: Column, *, max_len: int = 2048, buckets: int = 8, budget: int = 65_536
) -> DataFrame:
    """Pieces with their bucket, batch and place.

    Returns key, piece, start_token, n_tokens, bucket, bucket_tokens (the padded
    length), batch (gapless from 0 in its bucket) and slot (gapless from 0 in its
    batch). Repeated rows are packed as often as they occur; a null key sorts as an
    empty text. Other columns of ``df``, whatever their names, are not read. An empty
    table gives no rows.
    """
    if max_len < 1 or buckets < 1 or budget < max_len:
        raise ValueError("max_len and buckets must be positive and the budget hold one piece")
    cut = settle(pieces(df, key, length, max_len))  # texts are read once
    histogram = sorted(cut.groupBy("n_tokens").count().collect())
    bounds = optimal_boundaries(
        np.array([r[0] for r in histogram]), np.array([r[1] for r in histogram]), buckets
    )
    slices = max(1, -(-sum(r[1] for r in histogram) // SLICE_ROWS))

    # The number of boundaries below a length is its bucket.
    ends = F.array(*[F.lit(b).cast("bigint") for b in bounds or [max_len]])
    bucket = F.size(F.filter(ends, lambda b: b < F.col("n_tokens")))
    placed = (
        cut.withColumn("bucket", bucket)
        .withColumn("bucket_tokens", F.element_at(ends, F.col("bucket") + 1))
        .withColumn("slice", hash_slice(F.col(key), slices))
    )
    # One row per bucket and slice: a narrow table with a bound of its own.
    counts = placed.groupBy("bucket", "slice").count()
    before = F.sum("count").over(Window.partitionBy("bucket").orderBy("slice")) - F.col("count")
    offsets = counts.select(
        F.col("bucket").alias("_bucket"), F.col("slice").alias("_slice"), before.alias("offset")
    )
    inside = Window.partitionBy("bucket", "slice").orderBy(key, "piece", "n_tokens")
    numbered = placed.withColumn("row", F.row_number().over(inside) - 1).join(
        offsets, (F.col("bucket") == F.col("_bucket")) & (F.col("slice") == F.col("_slice"))
    )
    place = F.col("offset") + F.col("row")
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_tokens", F.lit(1)))).cast("bigint")
    return numbered.select(
        key,
        "piece",
        "start_token",
        "n_tokens",
        F.col("bucket").cast("int").alias("bucket"),
        "bucket_tokens",
        F.floor(place / per_batch).cast("bigint").alias("batch"),
        (place % per_batch).cast("bigint").alias("slot"),
    )
