"""Exact order statistics of many columns, without sorting the table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions import known
from loanlens.session import settle, small_frame

#: Buckets per column in which the order is refined.
BUCKETS = 64
#: Values at which a column's order is cut before ranks are looked up in it.
POINTS = 1024
#: Numbers that a task holds while it puts them in order.
HELD = 2_000_000


def counted_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value, n): how often each column has each number. All columns are counted in
    one shuffle; gaps and NaN are left out. Written, as it is read several times."""
    numbers = df.select(*[known(df, name).cast("double").alias(name) for name in cols])
    long = numbers.unpivot([], list(cols), "feature", "value").where("value IS NOT NULL")
    # -0.0 and 0.0 are one value.
    return settle(long.groupBy("feature", (F.col("value") + F.lit(0.0)).alias("value")).agg(F.count(F.lit(1)).alias("n")))


def order_statistics(counts: DataFrame, parts: Sequence[int]) -> DataFrame:
    """(feature, parts, i, value): for each number of parts m and i = 1 to m - 1 the smallest
    value that at least i/m of the column's rows do not exceed.

    Approximate quantiles cut the order into buckets. Their totals, a few rows per column,
    tell which buckets hold a wanted rank, and only the values of those are put in order.
    """
    spark = counts.sparkSession
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    edges = counts.groupBy("feature").agg(
        F.percentile_approx("value", shares, 10 * BUCKETS).alias("edges"), F.sum("n").alias("total")
    )
    edges = settle(edges)
    number = F.expr("size(filter(edges, e -> e < value))")
    placed = counts.join(F.broadcast(edges), "feature").select("feature", "value", "n", number.alias("bucket"))
    totals = placed.groupBy("feature", "bucket").agg(F.sum("n").alias("size"))
    before = Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("below", F.coalesce(F.sum("size").over(before), F.lit(0)))
    ranks = small_frame(spark, [(m, i) for m in parts for i in range(1, m)], "parts int, i int")
    rank = F.greatest(F.lit(1), F.expr("(i * total + parts - 1) div parts"))
    wanted = edges.select("feature", "total", F.explode(F.lit(list(parts))).alias("parts")).join(ranks, "parts")
    wanted = wanted.select("feature", "parts", "i", rank.alias("rank"))
    found = totals.join(wanted, "feature").where("rank > below AND rank <= below + size")
    found = settle(found.select("feature", "bucket", "below", "parts", "i", "rank"))
    buckets = found.select("feature", "bucket", "below").distinct()
    inside = Window.partitionBy("feature", "bucket").orderBy("value")
    running = (
        placed.join(F.broadcast(buckets), ["feature", "bucket"])
        .withColumn("upto", F.sum("n").over(inside) + F.col("below"))
        .select("feature", "bucket", "value", "upto", (F.col("upto") - F.col("n")).alias("from"))
    )
    at = running.join(F.broadcast(found.drop("below")), ["feature", "bucket"])
    return at.where("rank > from AND rank <= upto").select("feature", "parts", "i", "value")


def cut_points(counts: DataFrame, parts: Sequence[int], lower: bool = False) -> dict[int, dict[str, list[float]]]:
    """For each number of parts, per column the inner cuts of its intervals: all values where
    there are no more than that many, else the quantiles. Cuts c belong to the interval
    below, (c, next c], or with ``lower`` to the one above, [c, next c)."""
    facts = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("values"), F.min("value").alias("least"), F.max("value").alias("most")).collect()
    ends = {r["feature"]: r["least"] if lower else r["most"] for r in facts}
    few = {r["feature"]: r["values"] for r in facts if r["values"] <= max(parts)}
    listed: dict[str, list[float]] = {name: [] for name in few}
    if few:
        for r in counts.where(F.col("feature").isin(list(few))).select("feature", "value").collect():
            listed[r["feature"]].append(r["value"])
    cuts: dict[int, dict[str, list[float]]] = {m: {name: [] for name in ends} for m in parts}
    for r in order_statistics(counts, parts).collect():
        cuts[r["parts"]][r["feature"]].append(r["value"])
    for m, found in cuts.items():
        for name in found:
            values = listed[name] if few.get(name, m + 1) <= m else found[name]
            found[name] = sorted({v for v in values if (v > ends[name] if lower else v < ends[name])})
    return cuts


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """Column by column the numbers of many rows, gaps as NaN and -0.0 as 0.0."""
    held: list[np.ndarray] = []

    def joined() -> np.ndarray:
        return np.ascontiguousarray(np.concatenate(held).T) + 0.0

    for batch in batches:
        if batch.num_rows:
            held.append(batch["x"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width))
        if sum(map(len, held)) * width >= HELD:
            yield joined()
            held = []
    if held:
        yield joined()


def _thinned(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most ``POINTS`` of the sorted values, each with the weight of those up to it."""
    if len(values) <= POINTS:
        return values, weights
    upto = np.cumsum(weights)
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, POINTS + 1) / POINTS * (1 - 1e-12)))
    return values[at], np.diff(upto[at], prepend=0.0)


def _ordered(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the sum of the weights of each."""
    found, place = np.unique(values, return_inverse=True)
    return found, np.bincount(place, weights, len(found))


def places(x: pa.Array, cuts: Sequence[np.ndarray | None], lower: bool = False) -> np.ndarray:
    """For rows of numbers the number, from 1, of each one's interval between its column's cuts,
    0 for a gap or NaN. Cuts belong to the interval below, or with ``lower`` to the one above,
    where -0.0 comes before 0.0. A column without a list of cuts holds its numbers itself."""
    columns = np.ascontiguousarray(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).T)
    found = np.empty((len(x), len(cuts)), np.int16)
    for j, (values, inner) in enumerate(zip(columns, cuts)):
        gap = np.isnan(values)
        if inner is None:
            found[:, j] = np.where(gap, 0, values)
            continue
        if lower and 0.0 in inner:
            values = np.where((values == 0) & np.signbit(values), -5e-324, values)
        found[:, j] = np.where(gap, 0, np.searchsorted(inner, values, "right" if lower else "left") + 1)
    return found


def as_lists(values: np.ndarray) -> pa.Array:
    """A matrix as one list per row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def column_cuts(df: DataFrame, cols: Sequence[str], parts: Sequence[int], lower: bool = False) -> dict[int, dict[str, list[float]]]:
    """``cut_points`` of a table's columns, of which only the values around the cuts are shuffled.

    A first pass finds values that cut each column into about even buckets, a second counts
    the buckets, and a third puts those in order that hold a wanted rank. The cuts are exact,
    whatever the buckets are.
    """
    width, most = len(cols), max(parts)
    rows = df.select(F.array(*[known(df, name).cast("double") for name in cols]).alias("x"))
    kind = "feature int, few boolean, least double, most double, points array<double>, weights array<double>"

    def table(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.bool_(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        names = ("feature", "few", "least", "most", "points", "weights")
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=list(names))

    def one(feature: int, few: bool, ends: Sequence[float], points: np.ndarray, weights: np.ndarray) -> tuple:
        # Few values are all kept, so that they are known to be all.
        few = few and len(points) <= most
        return (feature, few, min(ends), max(ends), *((points, weights) if few else _thinned(points, weights)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple] = {}
        for x in _matrices(batches, width):
            for j, column in enumerate(x):
                values = np.sort(column[~np.isnan(column)])
                if not len(values):
                    continue
                first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
                values, counts = values[first], np.diff(first, append=len(values)).astype(float)
                few, ends = len(values) <= most, [values[0], values[-1]]
                values, counts = (values, counts) if few else _thinned(values, counts)
                if j in total:
                    _, before, least, greatest, points, weights = total[j]
                    few, ends = few and before, [*ends, least, greatest]
                    values, counts = _ordered(np.append(values, points), np.append(counts, weights))
                total[j] = one(j, few, ends, values, counts)
        yield table(list(total.values()))

    def merged(part: pa.Table) -> pa.Table:
        points, weights = (part[n].combine_chunks().flatten().to_numpy() for n in ("points", "weights"))
        ends = [*part["least"].to_pylist(), *part["most"].to_pylist()]
        return pa.Table.from_batches([table([one(part["feature"][0].as_py(), all(part["few"].to_pylist()), ends, *_ordered(points, weights))])])

    known_ = {r["feature"]: r for r in rows.mapInArrow(sketch, kind).groupBy("feature").applyInArrow(merged, kind).collect()}
    edges = {j: np.array(r["points"]) for j, r in known_.items()}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {j: np.zeros(len(e) + 1, np.int64) for j, e in edges.items()}
        for x in _matrices(batches, width):
            for j, e in edges.items():
                total[j] += np.bincount(np.searchsorted(e, x[j][~np.isnan(x[j])]), minlength=len(e) + 1)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(list(total), pa.int32()), "sizes": pa.array(list(total.values()), pa.list_(pa.int64()))})

    def added(part: pa.Table) -> pa.Table:
        return pa.table({"feature": part["feature"].slice(0, 1), "sizes": pa.array([np.stack(part["sizes"].to_numpy()).sum(0)], pa.list_(pa.int64()))})

    by_feature = "feature int, sizes array<bigint>"
    sizes = {r["feature"]: np.array(r["sizes"]) for r in rows.mapInArrow(counted, by_feature).groupBy("feature").applyInArrow(added, by_feature).collect()}
    # By (feature, bucket): the wanted ranks within the bucket.
    wanted: dict[tuple[int, int], set[int]] = {}
    place: dict[tuple[int, int, int], tuple[int, int, int]] = {}
    values: dict[tuple[int, int, int], float] = {}
    for j, size in sizes.items():
        upto = np.cumsum(size)
        for m in parts:
            for i in range(1, m):
                rank = max(1, (i * int(upto[-1]) + m - 1) // m)
                b = int(np.searchsorted(upto, rank))
                place[j, m, i] = (j, b, rank - int(upto[b] - size[b]))
                if known_[j]["few"]:
                    values[place[j, m, i]] = float(edges[j][b])
                else:
                    wanted.setdefault((j, b), set()).add(place[j, m, i][2])
    sought = {j: np.isin(np.arange(len(e) + 1), [b for f, b in wanted if f == j]) for j, e in edges.items() if any(f == j for f, _ in wanted)}
    inside = "feature int, bucket int, points array<double>, weights array<double>"
    listed = (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _matrices(batches, width):
            found = []
            for j, wants in sought.items():
                column = x[j][~np.isnan(x[j])]
                column = column[wants[np.searchsorted(edges[j], column)]]
                if not len(column):
                    continue
                points, weights = _ordered(column, np.ones(len(column)))
                bucket = np.searchsorted(edges[j], points)
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                found += [(j, bucket[k], p, w) for k, p, w in zip(first, np.split(points, first[1:]), np.split(weights, first[1:]))]
            names = ["feature", "bucket", "points", "weights"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(listed)], names=names)

    def ranked(part: pa.Table) -> pa.Table:
        key = (part["feature"][0].as_py(), part["bucket"][0].as_py())
        points, weights = _ordered(*(part[n].combine_chunks().flatten().to_numpy() for n in ("points", "weights")))
        ranks = sorted(wanted[key])
        at = np.searchsorted(np.cumsum(weights), ranks)
        return pa.table({"feature": pa.array([key[0]] * len(ranks), pa.int32()), "bucket": pa.array([key[1]] * len(ranks), pa.int32()), "place": pa.array(ranks, pa.int64()), "value": points[at]})

    if wanted:
        found = rows.mapInArrow(picked, inside).groupBy("feature", "bucket").applyInArrow(ranked, "feature int, bucket int, place bigint, value double")
        values |= {(r["feature"], r["bucket"], r["place"]): r["value"] for r in found.collect()}
    cuts: dict[int, dict[str, list[float]]] = {m: {} for m in parts}
    for j, r in sorted(known_.items()):
        for m in parts:
            every = r["points"] if r["few"] and len(r["points"]) <= m else [values[place[j, m, i]] for i in range(1, m)]
            cuts[m][cols[j]] = sorted({v for v in every if (v > r["least"] if lower else v < r["most"])})
    return cuts
