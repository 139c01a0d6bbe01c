"""Sharding along a Hilbert curve.

Several metadata columns are quantised by rank, each cell gets its place on the Hilbert
curve through their space, rows are put in the order of that place, and the order
is cut into runs of equal counts. Rows near in all columns then share a shard, so
that the column ranges of a shard (``shard_ranges``) let a reader skip files.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.session import settle

def text_cuts(values: DataFrame, levels: int) -> list[str]:
    """The largest text of each level but the last, levels having about equally many rows;
    with no more texts than levels, each text has a level of its own.

    ``values`` has one column. Its texts are counted and sorted by range; the rows before a
    text are those of the tasks before and of the texts before it in its own task. At most
    ``levels`` texts reach the driver.
    """
    (name,) = values.columns
    counts = values.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    sorted_ = settle(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    sizes = sorted_.groupBy("part").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("texts")).collect()
    total, texts = (sum(r[c] for r in sizes) for c in ("size", "texts"))
    if texts <= levels:
        return sorted(r["value"] for r in sorted_.select("value").collect())[:-1]
    before, at = [], 0
    for r in sorted(sizes):
        before.append((r["part"], at))
        at += r["size"]
    starts = values.sparkSession.createDataFrame(before, "_part int, offset bigint")
    inside = Window.partitionBy("part").orderBy("value")
    upto = F.sum("n").over(inside) + F.col("offset")
    placed = sorted_.join(F.broadcast(starts), F.col("part") == F.col("_part")).withColumn("upto", upto)  # a row per partition
    level = lambda rows: F.floor(rows * levels / F.lit(total))
    ends = placed.where((level(F.col("upto")) > level(F.col("upto") - F.col("n"))) & (F.col("upto") < total))
    return sorted(r["value"] for r in ends.select("value").collect())


def quantised(df: DataFrame, dims: dict[str, Column], bits: int) -> DataFrame:
    """Adds level columns _x0, _x1 ...; level 0 is for nulls and NaN. The others are cut at
    quantiles, numbers at approximate ones, texts at those of the counted texts."""
    kinds = dict(df.select(*[c.alias(n) for n, c in dims.items()]).dtypes)
    levels = (1 << bits) - 1
    shares = [i / levels for i in range(1, levels)]
    numbers = {n: c.cast("double") for n, c in dims.items() if kinds[n] != "string"}
    known = {n: F.when(~F.isnan(c), c) for n, c in numbers.items()}
    found = {}
    if numbers:
        row = df.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"q{i}") for i, c in enumerate(known.values())]).first()
        found = {n: sorted(set(row[i] or [])) for i, n in enumerate(numbers)}
    out = {}
    for i, (n, c) in enumerate(dims.items()):
        value = known.get(n, c)
        cuts = found[n] if n in numbers else text_cuts(df.select(c.alias("value")), levels)
        kind = "array<double>" if n in numbers else "array<string>"
        below = F.size(F.filter(F.lit(cuts).cast(kind) if cuts else F.expr(f"CAST(array() AS {kind})"), lambda cut: cut < value))
        out[f"_x{i}"] = F.when(value.isNull(), 0).otherwise(below + 1)
    return df.withColumns(out)


def curve_places(levels: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each column of ``levels`` (axes times rows):
    Skilling's transform to the transposed index, whose bits are then interleaved."""
    x = levels.astype(np.int64)
    axes = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in range(axes):
            flip = (x[axis] >> bit & 1).astype(bool)
            change = np.where(flip, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(flip, low, change)
            if axis:
                x[axis] ^= change
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    mask = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        mask ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= mask
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in range(axes):
            place = place << 1 | (x[axis] >> bit & 1)
    return place


def hilbert_index(levels: list[Column], bits: int) -> Column:
    @F.pandas_udf("bigint")
    def place(levels: pd.DataFrame) -> pd.Series:
        return pd.Series(curve_places(levels.to_numpy().T, bits))

    return place(F.struct(*levels))


def hilbert_shards(
    df: DataFrame, dims: dict[str, Column], keep: list[Column], *, order: list[str], shards: int, bits: int = 5
) -> DataFrame:
    """Rows of ``keep`` with curve, shard and slot, in ``shards`` runs of the curve.

    ``dims`` names the quantised expressions; ``order`` are kept columns that settle
    the order inside a cell (nulls first), so that a cell with a third of all rows is
    cut anywhere. Counts of shards differ by one at most; slots are gapless from 0.
    Rows equal in all of ``order`` may change places with one another. Texts are not
    shuffled: only ``keep`` and the curve are. Nulls and NaN have a level of their own,
    an empty table gives no rows, other columns play no part.
    """
    levels = quantised(df, dims, bits)
    curve = hilbert_index([F.col(f"_x{i}") for i in range(len(dims))], bits)
    light = levels.select(*keep, curve.alias("curve"))
    # A range partition may cut a cell, as the order columns belong to its key. It is
    # written once, so the numbers below rest on rows that do not move any more.
    parted = settle(
        light.repartitionByRange("curve", *order).withColumn("part", F.spark_partition_id())
    )
    sizes = sorted((r["part"], r["count"]) for r in parted.groupBy("part").count().collect())
    total, offsets, at = sum(n for _, n in sizes), [], 0
    for part, n in sizes:
        offsets.append((part, at))
        at += n
    spark = df.sparkSession
    starts = spark.createDataFrame(offsets or [(0, 0)], "_part int, offset bigint")
    inside = Window.partitionBy("part").orderBy("curve", *order)
    ranked = (
        parted.withColumn("row", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), F.col("part") == F.col("_part"))  # a row per partition
        .withColumn("rank", F.col("offset") + F.col("row"))
    )
    size = max(total, 1)
    shard = F.floor(F.col("rank") * shards / F.lit(size)).cast("int")
    # The first rank of a shard: the smallest with rank * shards >= shard * size.
    first = F.floor((F.col("shard").cast("bigint") * size + shards - 1) / F.lit(shards)).cast("bigint")
    return (
        ranked.withColumn("shard", shard)
        .withColumn("slot", (F.col("rank") - first).cast("bigint"))
        .drop("part", "_part", "offset", "row", "rank")
    )


def shard_ranges(df: DataFrame, columns: list[str], shard: str = "shard") -> DataFrame:
    """One row per shard with the smallest and largest value of each column, by which
    a reader prunes shards."""
    ends = [f(c).alias(f"{tag}_{c}") for c in columns for tag, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(shard).agg(F.count(F.lit(1)).alias("rows"), *ends)
