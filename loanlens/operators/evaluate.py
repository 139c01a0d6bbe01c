"""Measures of a score, from the table of ``running_class_counts``.

Pass that one table to all of them: it costs the shuffle, the measures are
projections and small aggregates of it. Where it was made for several scores at once,
name its groups in ``by``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores that a task holds while it puts them in order.
HELD = 4_000_000
#: Rows that are scored at a time.
SCORED = 200_000
#: Scores of a model and group that are put in order together, and rows whose scores say where to cut.
TOGETHER = 250_000
LOOKED_AT = 20_000


def _recall():
    return F.try_divide(F.col("ones_above").cast("double"), F.col("total_ones"))


def _precision():
    return F.try_divide(F.col("ones_above").cast("double"), F.col("rows_above"))


def _f_measure():
    return F.try_divide(2.0 * F.col("ones_above"), F.col("total_ones") + F.col("rows_above"))


def roc_auc(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve: the chance that a one outscores a zero, ties half.

    Twice the favourable pairs are summed as whole decimals, so the result does
    not depend on the order of the rows. Null when a class is missing.
    """
    zeros = F.col("rows") - F.col("ones")
    total_zeros = F.col("total_rows") - F.col("total_ones")
    zeros_below = total_zeros - (F.col("rows_above") - F.col("ones_above"))
    pairs = F.col("ones").cast("decimal(18,0)") * (2 * zeros_below + zeros).cast("decimal(19,0)")
    sums = counts.groupBy(*by).agg(
        F.sum(pairs).cast("double").alias("twice"),
        F.max("total_ones").cast("double").alias("p"),
        F.max(total_zeros).cast("double").alias("n"),
    )
    return sums.select(*by, F.try_divide(F.col("twice"), 2.0 * F.col("p") * F.col("n")).alias("auc"))


class Area(NamedTuple):
    model: int
    group: int
    auc: float | None


#: Makes labels, groups and scores (row, model) of a batch.
Scores = Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _class_counts(values: np.ndarray, ones: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores in order, NaN last, with their ones and rows."""
    order = np.argsort(values)
    values, ones, rows = values[order], ones[order], rows[order]
    with np.errstate(invalid="ignore"):
        same = (values[1:] == values[:-1]) | (np.isnan(values[1:]) & np.isnan(values[:-1]))
    first = np.flatnonzero(np.append(True, ~same))
    return (values, ones, rows) if len(first) == len(values) else (values[first], np.add.reduceat(ones, first), np.add.reduceat(rows, first))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of several batches, as models are made ready to score once for each part."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.extend([batch] if batch.num_rows else [])
        if sum(b.num_rows for b in held) >= SCORED:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def areas(table: DataFrame, scores: Scores, most: int | None = None) -> list[Area]:
    """Exact area under the ROC curve of many models within groups, as ``roc_auc`` of the scores.

    Scores are put in order where they are made and travel as arrays, cut into ranges that
    are the same for all rows of a model. Each range counts its favourable pairs, and those
    between ranges follow from their numbers of ones and zeros. The ranges are cut at the
    scores of some rows; wherever they are cut, the area is the same.
    """
    count, most = table.count(), TOGETHER if most is None else most
    edges: list[np.ndarray] = []
    if count > most:

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found = scores(pa.Table.from_batches([batch]))[2]
                    yield pa.RecordBatch.from_pydict({"s": pa.array(list(found), pa.list_(pa.float64()))})

        found = table.sample(min(1.0, LOOKED_AT / count), 1).mapInArrow(some, "s array<double>").toArrow()["s"].combine_chunks()
        seen = found.flatten().to_numpy(zero_copy_only=False).reshape(len(found), -1) if len(found) else np.zeros((0, 0))
        shares = np.arange(1, -(-count // most)) / -(-count // most)
        for column in np.sort(seen, axis=0).T:
            edges.append(np.unique(column[(shares * (len(column) - 1)).astype(int)]))
    kind = "model int, kin int, range int, values binary, ones binary, rows binary"
    names = ["model", "kin", "range", "values", "ones", "rows"]
    kinds = [*[pa.int32()] * 3, *[pa.binary()] * 3]

    def ordered(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        y, group, s = (np.concatenate([h[i] for h in held]) for i in range(3))
        found = []
        for k in np.unique(group):
            inside = group == k
            ones = (y[inside] == 1).astype(np.int64)
            for m, column in enumerate(s[inside].T):
                # 0.0 and -0.0 are one score.
                parts = _class_counts(column + 0.0, ones, np.ones(len(ones), np.int64))
                cuts = np.searchsorted(parts[0], edges[m], side="right") if m < len(edges) else []
                for r, part in enumerate(zip(*(np.split(v, cuts) for v in parts))):
                    if len(part[0]):
                        found.append((m, k, r, *(v.tobytes() for v in part)))
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names=names)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for part in _parts(batches):
            held.append(scores(part))
            if sum(h[2].size for h in held) >= HELD:
                yield ordered(held)
                held = []
        if held:
            yield ordered(held)

    def pairs(part: pa.Table) -> pa.Table:
        joined = lambda name, of: np.concatenate([np.frombuffer(v, of) for v in part[name].to_pylist()])
        _, ones, rows = _class_counts(joined("values", np.float64), joined("ones", np.int64), joined("rows", np.int64))
        zeros = rows - ones
        twice = int((ones * (2 * (np.cumsum(zeros) - zeros) + zeros)).sum())
        first = {n: part[n].slice(0, 1) for n in names[:3]}
        return pa.table(first | {"ones": pa.array([ones.sum()]), "zeros": pa.array([zeros.sum()]), "twice": pa.array([twice])})

    counted = table.mapInArrow(sent, kind).groupBy(*names[:3]).applyInArrow(pairs, "model int, kin int, range int, ones bigint, zeros bigint, twice bigint")
    by: dict[tuple[int, int], list] = {}
    for r in sorted(counted.collect(), key=lambda r: r["range"]):
        by.setdefault((r["model"], r["kin"]), []).append(r)
    found = []
    for (model, group), ranges in sorted(by.items()):
        ones = zeros = twice = 0
        for r in ranges:
            twice += r["twice"] + 2 * r["ones"] * zeros
            ones, zeros = ones + r["ones"], zeros + r["zeros"]
        found.append(Area(model, group, float(twice) / (2.0 * ones * zeros) if ones and zeros else None))
    return found


def recall_by_threshold(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return counts.select(*by, "threshold", _recall().alias("recall"))


def precision_by_threshold(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return counts.select(*by, "threshold", _precision().alias("precision"))


def precision_recall_curve(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return counts.select(*by, "threshold", _recall().alias("recall"), _precision().alias("precision"))


def f_measure_by_threshold(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return counts.select(*by, "threshold", _f_measure().alias("f_measure"))


def best_threshold(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Score with the highest F measure; of equals the higher score."""
    measured = f_measure_by_threshold(counts, by)
    if by:
        # Numbers only, so that no group is sorted.
        most = measured.groupBy(*by).agg(F.max("f_measure").alias("_most"))
        same = [measured[k].eqNullSafe(most[k]) for k in by] + [measured["f_measure"] == most["_most"]]
        top = measured.join(F.broadcast(most), same, "left_semi")
        return top.groupBy(*by).agg(F.max("threshold").alias("threshold"), F.max("f_measure").alias("f_measure"))
    best = measured.agg(F.max(F.struct("f_measure", "threshold")).alias("best"))
    return best.select("best.threshold", "best.f_measure")


def roc_curve(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """False- and true-positive rate per score, with the start point (0, 0), whose
    threshold is null: above every score."""
    zeros_above = (F.col("rows_above") - F.col("ones_above")).cast("double")
    points = counts.select(
        *by,
        "threshold",
        F.try_divide(zeros_above, F.col("total_rows") - F.col("total_ones")).alias("fpr"),
        _recall().alias("tpr"),
    )
    groups = counts.select(*by).distinct() if by else counts.sparkSession.range(1)
    start = groups.select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return start.unionByName(points)


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Actual by predicted counts of a binary decision, zero for an empty cell."""
    decided = df.select(F.col(label).cast("int").alias("actual"), F.col(pred).cast("int").alias("p"))
    return (
        decided.where(F.col("actual").isNotNull())
        .groupBy("actual")
        .agg(
            F.count_if(F.col("p") == 0).alias("predicted_0"),
            F.count_if(F.col("p") == 1).alias("predicted_1"),
        )
    )
