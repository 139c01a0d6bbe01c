"""Binning, weight of evidence, information value and feature voting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate
from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.operators import logit, trees
from loanlens.operators.grams import gram_matrix
from loanlens.operators.prep import assemble
from loanlens.operators.quantiles import as_lists, column_cuts, places
from loanlens.session import settle, small_frame


def bin_text(df: DataFrame, name: str) -> Column:
    """A value as the text of its bin: the same for whole numbers of any type; null for a
    gap or NaN, which no text can be confused with."""
    if isinstance(df.schema[name].dataType, (T.FractionalType,)):
        value = F.col(name).cast("double")
        value = F.when(~F.isnan(value), value)
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    return F.col(name).cast("string")


def woe_table(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Events, non-events, weight of evidence and information value per feature and bin.

    Each value is a bin; give numeric columns their bins first (``assign_bins``).
    A gap is a bin of its own, a null. The weight is ln(share of ones / share of zeros);
    a bin that lacks either class has weight and information value 0. All
    features are counted in one pass.
    """
    labelled = df.where(F.col(label).isNotNull())
    totals = labelled.agg(
        F.struct(
            F.count_if(F.col(label) == 1).cast("double").alias("events"),
            F.count_if(F.col(label) == 0).cast("double").alias("non_events"),
        ).alias("totals")
    ).scalar()
    counts = (
        labelled.select(
            label,
            *[bin_text(df, n).alias(n) for n in cols],
        )
        .unpivot([label], list(cols), "feature", "bin")
        .groupBy("feature", "bin")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(label) == 1).alias("events"),
            F.count_if(F.col(label) == 0).alias("non_events"),
        )
    )
    ones, zeros = F.col("events") / totals["events"], F.col("non_events") / totals["non_events"]
    both = (F.col("events") > 0) & (F.col("non_events") > 0)
    weighted = counts.withColumn("woe", F.when(both, F.ln(ones / zeros)).otherwise(0.0))
    return weighted.withColumn("iv", F.when(both, (ones - zeros) * F.col("woe")).otherwise(0.0))


def _iv(rows: int, events: int, all_rows: int, all_events: int) -> float:
    """Information value of one bin; 0 where it lacks a class."""
    if not 0 < events < rows:
        return 0.0
    ones, zeros = events / all_events, (rows - events) / (all_rows - all_events)
    return (ones - zeros) * log(ones / zeros)


def best_monotone(bins: Sequence[tuple[int, int]]) -> list[int]:
    """Where to begin new bins, so that event rates rise or fall throughout and the information
    value is greatest; of equals fewer bins, then later beginnings.

    ``bins`` are (rows, events) of neighbours. Dynamic programming over the last bin: the
    best way to bin what lies before it whose own last bin has a lower (or higher) rate.
    """
    m = len(bins)
    rows, events = (list(accumulate((b[i] for b in bins), initial=0)) for i in (0, 1))
    best = (-1.0, 0, [])
    for sign in (1, -1):
        ways: dict[tuple[int, int], tuple[float, int, list[int]]] = {}
        for j in range(1, m + 1):
            for i in range(j):
                n, e = rows[j] - rows[i], events[j] - events[i]
                gain = _iv(n, e, rows[m], events[m])
                # (value, fewer bins, beginnings) of all ways to end with this bin.
                found = [(gain, -1, [0])] if i == 0 else []
                for h in range(i):
                    if (h, i) in ways and sign * (e * (rows[i] - rows[h]) - (events[i] - events[h]) * n) > 0:
                        value, count, begins = ways[h, i]
                        found.append((value + gain, count - 1, [*begins, i]))
                if found:
                    ways[i, j] = max(found)
        best = max([best, *(way for (_, j), way in ways.items() if j == m)])
    return best[2]


def monotone_bins(
    df: DataFrame, cols: Sequence[str], label: str, max_bins: int = 20
) -> DataFrame:
    """Numeric intervals [lower, upper) whose event rate rises or falls throughout, with the
    greatest information value that neighbours of at most ``max_bins`` parts allow.

    The parts are cut at exact quantiles (each value is one where there are no more), counted
    for all columns in one pass, and joined by dynamic programming on the driver, where
    only these counts come.
    """
    labelled = df.where(F.col(label).isNotNull()).select(
        F.col(label), *[F.col(name).cast("double").alias(name) for name in cols]
    )
    cuts = column_cuts(labelled, cols, [max_bins], lower=True)[max_bins]
    cuts = {name: cuts.get(name, []) for name in cols}
    counted = (
        _numbered(labelled, cuts)
        .unpivot([label], list(cols), "feature", "bin")
        .where(F.col("bin").isNotNull())
        .groupBy("feature", "bin")
        .agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 1).alias("events")
        )
    )
    found: dict[str, list] = {name: [] for name in cols}
    for row in counted.orderBy("feature", "bin").collect():
        lowers = [float("-inf"), *cuts[row["feature"]]]
        found[row["feature"]].append((lowers[row["bin"]], row["rows"], row["events"]))
    rows = []
    for name in cols:
        parts = found[name]
        begins = best_monotone([part[1:] for part in parts])
        for number, (begin, end) in enumerate(zip(begins, [*begins[1:], len(parts)])):
            lower = parts[begin][0] if begin else float("-inf")
            upper = parts[end][0] if end < len(parts) else float("inf")
            n, events = (sum(part[i] for part in parts[begin:end]) for i in (1, 2))
            rows.append((name, number, lower, upper, n, events, events / n))
    return small_frame(
        df.sparkSession,
        rows,
        "feature string, bin int, lower double, upper double, rows bigint, events bigint, "
        "event_rate double",
    )


def _numbered(df: DataFrame, cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """Replace each column by the number of its interval; gaps stay null."""
    value = {name: F.col(name).cast("double") for name in cuts}
    gap = {name: value[name].isNull() | F.isnan(value[name]) for name in cuts}
    several = [name for name, inner in cuts.items() if inner]
    one = {name: F.when(~gap[name], F.lit(0)) for name, inner in cuts.items() if not inner}
    if not several:
        return df.withColumns(one)
    inputs, places = [f"_value_{n}" for n in several], [f"_place_{n}" for n in several]
    split = Bucketizer(
        splitsArray=[[float("-inf"), *cuts[name], float("inf")] for name in several],
        inputCols=inputs,
        outputCols=places,
        handleInvalid="keep",
    )
    placed = split.transform(df.withColumns({i: value[n] for i, n in zip(inputs, several)}))
    numbers = {n: F.when(~gap[n], F.col(p).cast("int")) for n, p in zip(several, places)}
    return placed.withColumns({**one, **numbers}).drop(*inputs, *places)


def _cuts(bins: DataFrame) -> dict[str, list[float]]:
    """By feature the lower ends of its fitted bins, but for the first."""
    cuts: dict[str, list[float]] = {}
    for row in bins.select("feature", "lower").distinct().orderBy("feature", "lower").collect():
        inner = cuts.setdefault(row["feature"], [])
        if row["lower"] > float("-inf"):
            inner.append(row["lower"])
    return cuts


def assign_bins(df: DataFrame, bins: DataFrame) -> DataFrame:
    """Replace the columns that have fitted bins by the number of their bin."""
    return _numbered(df, {name: inner for name, inner in _cuts(bins).items() if name in df.columns})


def _worth(cuts: Mapping[str, Sequence[float]], weights: Sequence[np.ndarray]) -> Column:
    """An array of what the columns' intervals weigh, each column's gap first. All columns are
    looked up batch by batch in one call: as expressions of their own they make code too
    long to be compiled."""
    edges = [np.array(inner, float) for inner in cuts.values()]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def worth(x: pa.Array) -> pa.Array:
        return as_lists(np.column_stack([w.take(at) for w, at in zip(weights, places(x, edges, lower=True).T)]))

    return worth(F.array(*[F.col(name).cast("double") for name in cuts]))


#: Bins of a feature up to which weights are looked up in the row's own expression.
LISTED = 250


def apply_woe(
    df: DataFrame,
    woe: DataFrame,
    cols: Sequence[str],
    bins: DataFrame | None = None,
    suffix: str = "_woe",
) -> DataFrame:
    """Add ``<column>_woe``, the weight of the row's bin; a bin never seen weighs 0.

    The fitted bins and weights are reused as they are, on any frame, a gap for the null
    bin. A feature's weights are part of the projection; only features of more than
    ``LISTED`` bins are joined by value, where Spark's size limit decides whether they are
    broadcast, and adaptive execution splits hot values. Of a bin that is listed twice the
    least weight counts.
    """
    woe = settle(
        woe.where(F.col("feature").isin(list(cols))).groupBy("feature", "bin").agg(F.min("woe").alias("woe"))
    )
    sizes = {r["feature"]: r["n"] for r in woe.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    listed: dict[str, dict[str | None, float]] = {n: {} for n in cols if sizes.get(n, 0) <= LISTED}
    for r in woe.where(F.col("feature").isin(list(listed))).collect():
        listed[r["feature"]][r["bin"]] = r["woe"]
    cuts = {n: inner for n, inner in _cuts(bins).items() if n in cols} if bins is not None else {}
    numbered = {n: inner for n, inner in cuts.items() if n in listed}
    # Columns of many bins are joined by the number of their bin.
    placed = {n: f"_bin_of_{n}" for n in cuts if n not in listed}
    weighted = df.withColumns({p: F.col(n) for n, p in placed.items()})
    weighted = _numbered(weighted, {p: cuts[n] for n, p in placed.items()}) if placed else weighted
    weighted = weighted.withColumns({f"_text_{n}": bin_text(weighted, placed.get(n, n)) for n in cols if n not in numbered})
    found = {}
    if numbered:
        worth = [
            np.array([listed[n].get(str(i) if i >= 0 else None, 0.0) for i in range(-1, len(inner) + 1)], float)
            for n, inner in numbered.items()
        ]
        weighted = weighted.withColumn("_weights", _worth(numbered, worth))
        found = {n + suffix: F.col("_weights")[i] for i, n in enumerate(numbered)}
    for name, weights in listed.items():
        if name in numbered:
            continue
        gap = F.lit(float(weights.get(None, 0.0)))
        entries = [c for b, w in weights.items() if b is not None for c in (F.lit(b), F.lit(float(w)))]
        value = F.try_element_at(F.create_map(*entries), F.col(f"_text_{name}")) if entries else F.lit(0.0)
        found[name + suffix] = F.when(F.col(f"_text_{name}").isNull(), gap).otherwise(F.coalesce(value, F.lit(0.0)))
    weighted = weighted.withColumns(found)
    for name in cols:
        if name not in listed:
            lookup = woe.where(F.col("feature") == name).select(F.col("bin").alias("_bin"), F.col("woe").alias("_woe"))
            joined = weighted.join(lookup, F.col(f"_text_{name}").eqNullSafe(F.col("_bin")), "left")
            weighted = joined.withColumn(name + suffix, F.coalesce("_woe", F.lit(0.0))).drop("_bin", "_woe")
    return weighted.select(*df.columns, *[name + suffix for name in cols])


class Evidence(NamedTuple):
    """Bins and weights of evidence of some columns, fitted once."""

    cols: list[str]
    bins: DataFrame | None
    table: DataFrame

    def apply(self, df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
        return apply_woe(df, self.table, self.cols if cols is None else cols, self.bins)


def fit_evidence(df: DataFrame, cols: Sequence[str], label: str) -> Evidence:
    """Monotone bins of the numeric columns and weights of all."""
    numeric = numeric_columns(df, cols)
    bins = settle(monotone_bins(df, numeric, label)) if numeric else None
    binned = assign_bins(df, bins) if bins is not None else df
    return Evidence(list(cols), bins, settle(woe_table(binned, cols, label)))


def rank_by_iv(woe: DataFrame, top: int = 20) -> DataFrame:
    """Features by information value, highest first."""
    return (
        woe.groupBy("feature")
        .agg(F.sum("iv").alias("information_value"))
        .orderBy(F.desc("information_value"), "feature")
        .limit(top)
    )


def numeric_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [name for name in cols if isinstance(df.schema[name].dataType, T.NumericType)]


def count_strengths(table: DataFrame) -> DataFrame:
    """(feature, selector, strength) of the selectors that need the counts of a table of
    evidence only: the information value, and how unlikely the chi-square statistic is."""
    n, by = F.col("events") + F.col("non_events"), Window.partitionBy("feature")
    expected = F.col("n") * F.col("ones") / F.col("all")
    square = F.pow(F.col("events") - expected, F.lit(2))
    sums = (
        table.withColumn("n", n)
        .withColumn("ones", F.sum("events").over(by))
        .withColumn("all", F.sum("n").over(by))
        .groupBy("feature")
        .agg(
            F.sum("iv").alias("information_value"),
            (F.count(F.lit(1)) - 1).alias("free"),
            F.coalesce(F.sum(F.try_divide(square, expected) + F.try_divide(square, F.col("n") - expected)), F.lit(0.0)).alias("statistic"),
        )
    )
    # The normal deviate of a chi-square statistic (Wilson and Hilferty). It rises as the
    # p-value falls, and does not run into zero as that does.
    spread = F.lit(2.0) / (9 * F.col("free"))
    deviate = (F.pow(F.col("statistic") / F.col("free"), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
    sums = sums.withColumn("chi_square", F.when(F.col("free") > 0, deviate).otherwise(F.lit(float("-inf"))))
    return sums.unpivot(["feature"], ["information_value", "chi_square"], "selector", "strength")


def ballots(strengths: DataFrame, each: int) -> DataFrame:
    """Each selector's ``each`` strongest features; equal ones by name."""
    place = F.row_number().over(Window.partitionBy("selector").orderBy(F.desc("strength"), "feature"))
    return strengths.withColumn("place", place).where(F.col("place") <= each)


def counted_votes(cast: DataFrame, keep: int) -> DataFrame:
    votes = cast.groupBy("feature").agg(
        F.count(F.lit(1)).alias("votes"), F.sort_array(F.collect_list("selector")).alias("selectors")
    )
    return votes.orderBy(F.desc("votes"), "feature").limit(keep)


def eliminated(gram: np.ndarray, ridge: float = 1e-6) -> list[int]:
    """Columns in the order in which recursive elimination drops them: the one with the least
    coefficient per deviation goes, and the rest are fitted again.

    ``gram`` has the sums of products of the constant, the columns and the label. Every fit
    follows from it, so that no further pass over the rows is needed.
    """
    n, last = gram[0, 0], len(gram) - 1
    centred = gram - np.outer(gram[0], gram[0]) / max(n, 1.0)
    size = np.sqrt(np.maximum(np.diag(centred), 1e-300))
    corr = centred / np.outer(size, size)
    left, gone = [i for i in range(1, last) if centred[i, i] > 1e-12 * max(gram[i, i], 1e-300)], []
    gone += [i for i in range(1, last) if i not in left]
    while left:
        weights = np.linalg.solve(corr[np.ix_(left, left)] + ridge * np.eye(len(left)), corr[left, last])
        gone.append(left.pop(int(np.argmin(np.abs(weights)))))
    return [i - 1 for i in gone]


def vote_features(
    df: DataFrame,
    cols: Sequence[str],
    label: str,
    keep: int = 25,
    each: int | None = None,
    seed: int = 1,
    evidence: Evidence | None = None,
) -> DataFrame:
    """Features by the votes of six selectors: information value, chi-square, the gain in a
    forest and in a forest of random splits, L1-logistic weight and recursive elimination.

    The last two read weights of evidence (``evidence``, or fitted here). A selector votes
    for its ``each`` best features (``keep`` unless given). One number per feature and
    selector reaches the driver, and the sums of products of the features.
    """
    labelled = settle(df.where(F.col(label).isNotNull()).select(label, *cols), evenly=True)
    evidence = evidence or fit_evidence(labelled, cols, label)
    weighted = evidence.apply(labelled, cols)
    vectors = assemble(weighted, [f"{name}_woe" for name in cols]).select(F.col(label).alias("y"), "features")
    rows = logit.rows_of(vectors, "y")
    lasso = logit.fit_setting(rows, {"regParam": 0.001, "elasticNetParam": 1.0, "fitIntercept": True, "maxIter": 50})
    gram = gram_matrix(rows.select(F.concat(F.array(F.lit(1.0)), "x", F.array("y")).alias("x")))
    spread = np.sqrt(np.maximum(np.diag(gram)[1:-1] - gram[0, 1:-1] ** 2 / max(gram[0, 0], 1.0), 0.0))
    place = {i: number for number, i in enumerate(eliminated(gram))}
    strength = {
        # Per standard deviation: a weight on a nearly constant feature means little.
        "l1_logistic": [abs(float(x)) for x in lasso.coefficients * spread],
        "elimination": [float(place[i]) for i in range(len(cols))],
    }
    numeric = numeric_columns(labelled, cols)
    few = [n for n in cols if n not in numeric and evidence.table.where(F.col("feature") == n).count() <= trees.MOST_CATEGORIES]
    # Wide categories take part by their weights.
    wide = {n: f"{n}_woe" for n in cols if n not in numeric and n not in few}
    named = [wide.get(n, n) for n in cols]
    frame = weighted.withColumn("_row", F.xxhash64(*cols))
    bins = trees.fit_bins(frame, [*numeric, *wide.values()], few)
    table = settle(trees.binned(frame, bins, "_row", label), evenly=True)
    some = float(np.ceil(len(cols) ** 0.5) / len(cols))
    kinds = {"forest": {"replace": True}, "random_splits": {"random_cuts": True}}
    for name, how in kinds.items():
        params = trees.Params(kind="gini", trees=30, depth=5, columns_by_node=some, child=0.0, seed=seed, **how)
        model = trees.fit(table, bins[0], params)
        gains = {r["feature"]: r["total_gain"] for r in trees.importance(trees.node_table(model, df.sparkSession)).collect()}
        strength[name] = [gains.get(n, 0.0) for n in named]
    listed = [(c, s, float(v)) for s, values in strength.items() for c, v in zip(cols, values)]
    more = small_frame(df.sparkSession, listed, "feature string, selector string, strength double")
    return counted_votes(ballots(count_strengths(evidence.table).unionByName(more), each or keep), keep)
