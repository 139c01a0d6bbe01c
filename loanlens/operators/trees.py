"""Forests and second-order boosted trees, grown from histograms as node tables.

Every column is cut into bins once (``fit_bins``), and rows are written with their bin
numbers (``binned``). One pass over them adds up, for all trees that grow and all their open
nodes at once, two sums per (node, column, bin): gradient and Hessian for boosting, weight of
ones and weight for forests. The sums are merged as a tree of groups, the best split of each
node is found where its sums meet, and only that reaches the driver. A level of any number
of trees costs one pass and one shuffle whose size the rows do not decide.

A fitted model is a table of nodes. It scores at any depth and any number of its trees, so
one deep fit serves all shallower settings of a search.

What is random hangs on the row's key, the tree and the node, never on the partitioning.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loanlens.functions import hash_bits, hash_uniform, known
from loanlens.operators import packed
from loanlens.operators.quantiles import as_lists, column_cuts, places
from loanlens.session import new_path, remove, small_frame

#: Categories that a column may have.
MOST_CATEGORIES = 250
#: Cells of histograms that a pass holds; trees beyond that are grown in further passes.
CELLS = 8_000_000
#: Cells of the histograms of a tree whose rows are in memory, at a time.
HERE = 1_000_000
#: Tasks whose sums are merged first.
BRANCHES = 64
LEAST_GAIN = 1e-6


class Bins(NamedTuple):
    """How columns are cut: bin 0 is a gap or an unseen category, bins 1 and up are intervals
    (c, next c] of numbers or single categories."""

    columns: tuple[str, ...]
    cuts: tuple[tuple[float, ...] | None, ...]
    categories: tuple[tuple[str, ...] | None, ...]

    @property
    def width(self) -> int:
        sizes = [len(c) + 1 if c is not None else len(k) for c, k in zip(self.cuts, self.categories)]
        return 1 + max(sizes)

    @property
    def ordered(self) -> np.ndarray:
        return np.array([c is not None for c in self.cuts])

    @property
    def sizes(self) -> list[int]:
        """Bins of each column, that of gaps among them."""
        return [len(c) + 2 if c is not None else len(k) + 1 for c, k in zip(self.cuts, self.categories)]


def fit_bins(df: DataFrame, numeric: Sequence[str], categories: Sequence[str] = (), sizes: Sequence[int] = (20,)) -> list[Bins]:
    """Bins of at most each of the sizes, cut at exact quantiles; columns with fewer values
    have a bin for each. A category column keeps all its values at any size."""
    cuts = column_cuts(df, numeric, sizes) if numeric else {m: {} for m in sizes}
    values = {}
    for name in categories:
        found = df.select(F.col(name).cast("string").alias("v")).where("v IS NOT NULL").distinct().limit(MOST_CATEGORIES + 1).collect()
        if len(found) > MOST_CATEGORIES:
            raise ValueError(f"{name} has more than {MOST_CATEGORIES} categories; give it weights of evidence")
        values[name] = tuple(sorted(r["v"] for r in found))
    columns = (*numeric, *categories)
    none = (None,)
    return [
        Bins(columns, (*(tuple(cuts[m].get(n, ())) for n in numeric), *none * len(categories)), (*none * len(numeric), *(values[n] for n in categories)))
        for m in sizes
    ]


def _numbered(df: DataFrame, bins: Bins, out: str) -> DataFrame:
    """Add an array of bin numbers, those of all columns looked up batch by batch in one call."""
    values = [
        known(df, name) if listed is None else F.array_position(F.lit(list(listed)).cast("array<string>"), F.col(name).cast("string"))
        for name, listed in zip(bins.columns, bins.categories)
    ]
    cuts = [None if c is None else np.array(c, float) for c in bins.cuts]

    @F.arrow_udf(T.ArrayType(T.ShortType()))
    def numbers(x: pa.Array) -> pa.Array:
        return as_lists(places(x, cuts))

    return df.withColumn(out, numbers(F.array(*[v.cast("double") for v in values])))


def binned(df: DataFrame, bins: Sequence[Bins], key: str, label: str | None = None, weight: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Kept columns, hash of the key, label and weight as numbers and one array of bin numbers
    per entry of bins (x0, x1, ...). Rows without a label are left out where one is named."""
    rows = df if label is None else df.where(F.col(label).isNotNull())
    for i, entry in enumerate(bins):
        rows = _numbered(rows, entry, f"_x{i}")
    y = F.lit(0.0) if label is None else F.col(label).cast("double")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    xs = [F.col(f"_x{i}").alias(f"x{i}") for i in range(len(bins))]
    return rows.select(*keep, F.xxhash64(F.col(key).cast("string")).alias("h"), y.alias("y"), w.alias("w"), *xs)


@dataclass(frozen=True)
class Params:
    """Settings of a fit. ``kind`` is boost, gini or entropy.

    ``fold`` (name of a column of numbers and one of them) leaves those rows out.
    """

    kind: str = "boost"
    x: int = 0
    fold: tuple[str, int] | None = None
    trees: int = 1  # per round
    rounds: int = 1
    depth: int = 6
    leaves: int = 0  # no limit
    by_gain: bool = False  # the leaf of greatest gain is split next
    rate: float = 1.0  # share of rows per tree
    replace: bool = False
    columns_by_tree: float = 1.0
    columns_by_node: float = 1.0
    random_cuts: bool = False  # one random cut per column
    child: float = 1.0  # least Hessian or weight of a child
    gain: float = 0.0
    l2: float = 1.0
    l1: float = 0.0
    step: float = 0.3
    ones: float = 1.0  # weight of a one
    seed: int = 0


@dataclass
class Tree:
    """Nodes by number, the root first and parents before children; no child is -1."""

    number: int
    feature: list[int] = field(default_factory=list)
    route: list[np.ndarray] = field(default_factory=list)  # bins that go left
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    sums: list[tuple[float, float]] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, depth: int, sums: tuple[float, float], width: int) -> int:
        for values, value in (
            (self.feature, -1), (self.route, np.zeros(width, bool)), (self.left, -1), (self.right, -1),
            (self.depth, depth), (self.sums, sums), (self.gain, 0.0),
        ):
            values.append(value)
        return len(self.left) - 1

    def __getstate__(self) -> dict:
        """Arrays in place of a list of small ones, as trees travel with every pass."""
        packed = {n: np.array(getattr(self, n), np.int32) for n in ("feature", "left", "right", "depth")}
        return packed | {"number": self.number, "route": np.array(self.route, bool), "sums": np.array(self.sums, float), "gain": np.array(self.gain, float)}

    def __setstate__(self, packed: dict) -> None:
        self.__dict__.update({n: v.tolist() if n not in ("number", "route") else v for n, v in packed.items()})
        self.route, self.sums = list(self.route), [tuple(s) for s in self.sums]

    def steps(self, leaf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """What ``place`` walks by: each node's column, and the next node by node and bin; where
        a row ends it stays."""
        feature, left, right = (np.array(v, np.intp) for v in (self.feature, self.left, self.right))
        inner = left >= 0 if leaf is None else (left >= 0) & ~leaf
        step = np.where(np.array(self.route), left[:, None], right[:, None])
        return np.maximum(feature, 0), np.where(inner[:, None], step, np.arange(len(left))[:, None])

    def place(
        self, x: np.ndarray, depth: int | None = None, leaf: np.ndarray | None = None, at: np.ndarray | None = None,
        steps: tuple[np.ndarray, np.ndarray] | None = None,
    ) -> np.ndarray:
        """Node of each row, at most ``depth`` steps down from the root or from where it is;
        nodes marked in ``leaf`` go no further."""
        feature, step = self.steps(leaf) if steps is None else steps
        width, step, ends = step.shape[1], step.ravel(), (step == np.arange(len(step))[:, None]).all(1)
        flat, count = np.ascontiguousarray(x).reshape(-1), len(x)
        first, found = np.arange(min(count, 8192)) * x.shape[1], np.zeros(count, np.intp) if at is None else np.array(at, np.intp)
        walked = max(self.depth) if depth is None else depth
        # A few thousand rows at a time, which stay in the cache.
        for begin in range(0, 0 if ends.all() else count, 8192):
            here = found[begin : begin + 8192]
            part = flat[begin * x.shape[1] :]
            for taken in range(walked):
                if taken % 4 == 3 and ends.take(here).all():
                    break
                here = step.take(here * width + part.take(first[: len(here)] + feature.take(here)))
            found[begin : begin + len(here)] = here
        return found

    def alike(self, depth: int) -> np.ndarray:
        """Nodes under which, cut at a depth, all leaves decide for the same class."""
        decided = [2 * a > b for a, b in self.sums]
        same = np.zeros(len(self.left), bool)
        for i in reversed(range(len(self.left))):
            l, r = self.left[i], self.right[i]
            ends = l < 0 or self.depth[i] >= depth
            same[i] = ends or bool(same[l] and same[r] and decided[l] == decided[r])
            if not ends and same[i]:
                decided[i] = decided[l]
        return same


# ---- what a row, a node and a split weigh ----


def times_drawn(h: np.ndarray, p: Params, tree: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The rows in a tree's sample, in order, and how often each is; None for all once each."""
    if p.rate >= 1 and not p.replace:
        return None
    bits = hash_bits(h, p.seed, tree)
    below = lambda chance: np.uint64(min(np.ceil(chance * 2.0**53), 2.0**53))
    if not p.replace:
        chosen = np.flatnonzero(bits < below(p.rate))
        return chosen, np.ones(len(chosen))
    chance = at_most = np.exp(-p.rate)
    chosen = np.flatnonzero(bits >= below(at_most))
    bits, at, times = bits.take(chosen), np.arange(len(chosen)), np.ones(len(chosen))
    for k in range(1, 29):
        chance *= p.rate / k
        at_most += chance
        more = np.flatnonzero(bits >= below(at_most))
        if not len(more):
            break
        bits, at = bits.take(more), at.take(more)
        times[at] = k + 1
    return chosen, times


def columns_of(p: Params, tree: int, nodes: np.ndarray, count: int) -> np.ndarray:
    """The columns that each node may be split by, in order: those of the smallest numbers
    drawn, as many for each node."""
    drawn = lambda n, salt: hash_uniform((n[:, None] * count + np.arange(count)).ravel(), p.seed, tree, salt).reshape(len(n), count)
    left = max(1, int(p.columns_by_tree * count + 1e-9)) if p.columns_by_tree < 1 else count
    out = np.argsort(drawn(np.array([0]), 1)[0])[left:]
    k = max(1, int(np.ceil(p.columns_by_node * left - 1e-9))) if p.columns_by_node < 1 else left
    if k == left:
        return np.broadcast_to(np.setdiff1d(np.arange(count), out), (len(nodes), left))
    by_node = drawn(nodes, 2)
    by_node[:, out] = 2.0
    return np.sort(np.argsort(by_node, axis=1)[:, :k], axis=1)


def _worth(kind: str, a: np.ndarray, b: np.ndarray, p: Params) -> np.ndarray:
    """Worth of a node with sums a and b; a split gains what its sides are worth more."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if kind == "boost":
            g = np.sign(a) * np.maximum(np.abs(a) - p.l1, 0.0)
            return np.where(b + p.l2 > 0, g * g / (b + p.l2), 0.0)
        if kind == "gini":
            return np.where(b > 0, -2 * a * (b - a) / b, 0.0)
        ones = np.where(a > 0, a * np.log2(a / b), 0.0)
        return ones + np.where(b - a > 0, (b - a) * np.log2((b - a) / b), 0.0)


class Split(NamedTuple):
    """Column, bins that go left and the sums of both sides; without a split the column is -1
    and all is on the left."""

    gain: float
    feature: int
    route: np.ndarray
    left: tuple[float, float]
    right: tuple[float, float]


class Splits(NamedTuple):
    """Those of several nodes, in order."""

    gain: np.ndarray
    feature: np.ndarray
    route: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def each(self) -> list[Split]:
        sides = (zip(*s.T.tolist()) for s in (self.left, self.right))
        return [Split(*v) for v in zip(self.gain.tolist(), self.feature.tolist(), self.route, *sides)]


def splits_of(hist: np.ndarray, p: Params, ordered: np.ndarray, columns: np.ndarray, tree: int, nodes: np.ndarray) -> Splits:
    """The best split of each node from its sums by (node, column, bin), for the columns listed
    by node; of equals the first.

    Numbers are cut between two bins, with gaps on the side where they gain more. The
    categories, a gap among them, are put in the order of their ratio of the sums, in
    which a best subset is a beginning.
    """
    n, count, width, _ = hist.shape
    number = ordered[columns]
    total = hist[:, 0].sum(1)
    ta, tb = total[:, 0, None, None, None], total[:, 1, None, None, None]
    place, sums = None, hist
    if not number.all():
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = hist[..., 0] / (hist[..., 1] + (p.l2 if p.kind == "boost" else 0.0))
        ratio = np.where(hist[..., 1] > 0, ratio, np.inf)
        place = np.broadcast_to(np.arange(width), (n, count, width)).copy()
        place[~number] = np.argsort(ratio[~number], axis=1, kind="stable")
        sums = np.take_along_axis(hist, place[..., None], axis=2)
    # Gaps go to the right: what lies up to each bin without bin 0. To the left: with it.
    upto = np.cumsum(sums, axis=2)
    gaps = hist[:, :, :1] * number[..., None, None]
    sides = np.stack([upto - gaps, upto], axis=3) if gaps.any() else upto[:, :, :, None]
    a, b = sides[..., 0], sides[..., 1]  # node, column, bin, side of the gaps
    gains = _worth(p.kind, a, b, p) + _worth(p.kind, ta - a, tb - b, p) - _worth(p.kind, ta, tb, p)
    least = max(p.child, 1e-12) - 1e-9 * (p.child > 1e-6)
    valid = (b >= least) & (tb - b >= least)
    if p.random_cuts:
        may = valid.any(3)
        every = hash_uniform(np.arange((int(nodes.max()) + 1) * len(ordered)), p.seed, tree, 3).reshape(-1, len(ordered))
        drawn = np.take_along_axis(every[nodes], columns, axis=1)[..., None]
        valid &= ((np.cumsum(may, axis=2) - 1 == np.floor(drawn * may.sum(2, keepdims=True))) & may)[..., None]
    gains = np.where(valid, gains, -np.inf).reshape(n, -1)
    best = np.argmax(gains, axis=1)
    least_gain = max(p.gain, LEAST_GAIN) if p.kind == "boost" else max(p.gain, 1e-9) * np.maximum(total[:, 1], 1e-12)
    enough = gains[np.arange(n), best] > least_gain
    j, cut, side = np.unravel_index(best, sides.shape[1:4])
    node, bins = np.arange(n), np.arange(width)
    route = (bins >= 1) & (bins <= cut[:, None])
    route[:, 0] = side == 1
    if place is not None:
        # Categories go by their place in the order of the ratios.
        going = np.zeros((n, width), bool)
        np.put_along_axis(going, place[node, j], bins <= cut[:, None], axis=1)
        route = np.where(number[node, j][:, None], route, going)
    left = np.where(enough[:, None], sides[node, j, cut, side], total)
    gain = np.where(enough, gains[node, best], 0.0)
    return Splits(gain, np.where(enough, columns[node, j], -1), route & enough[:, None], left, np.where(enough[:, None], total - left, 0.0))


def best_splits(hist: np.ndarray, p: Params, ordered: np.ndarray, columns: np.ndarray, tree: int, nodes: np.ndarray) -> list[Split]:
    return splits_of(hist, p, ordered, columns, tree, nodes).each()


#: Cells of the joint counts of columns that are added up together.
JOINT = 4500


class Joint(NamedTuple):
    """Columns that are added up together: places among those of the nodes, numbers of bins,
    and each row's cell among their combinations."""

    places: list[int]
    sizes: list[int]
    cell: np.ndarray


def joint_cells(x: np.ndarray, columns: np.ndarray, sizes: Sequence[int]) -> list[Joint]:
    """Groups of columns with few combinations of bins. The sums by combination give those of
    each column, so a group costs the rows one sum in place of one per column."""
    groups: list[tuple[list[int], int]] = []
    for j in sorted(range(len(columns)), key=lambda j: sizes[columns[j]]):
        size = sizes[columns[j]]
        if groups and groups[-1][1] * size <= JOINT:
            groups[-1] = ([*groups[-1][0], j], groups[-1][1] * size)
        else:
            groups.append(([j], size))
    found = []
    for places, _ in groups:
        of = [sizes[columns[j]] for j in places]
        cell = np.zeros(len(x), np.int32)
        for j, size in zip(places, of):
            cell *= size
            cell += x[:, columns[j]]
        found.append(Joint(places, of, cell))
    return found


def histogram(
    x: np.ndarray, node: np.ndarray, stats: tuple[np.ndarray, np.ndarray], columns: np.ndarray, width: int, joint: Sequence[Joint] = ()
) -> np.ndarray:
    """Sums by (node, column, bin) over the columns listed by node; rows with a negative node
    do not count."""
    nodes, count = columns.shape
    a, b = stats
    hist = np.zeros((nodes, count, width, 2))
    if joint and nodes * JOINT <= len(x):
        if node.min() < 0:
            inside = np.flatnonzero(node >= 0)
            node, a, b, joint = node[inside], a[inside], b[inside], [j._replace(cell=j.cell[inside]) for j in joint]
        for places, sizes, cell in joint:
            together = node * int(np.prod(sizes)) + cell
            for s, weights in enumerate((a, b)):
                sums = np.bincount(together, weights, nodes * int(np.prod(sizes))).reshape(nodes, *sizes)
                for k, (j, size) in enumerate(zip(places, sizes)):
                    hist[:, j, :size, s] = sums.sum(tuple(i + 1 for i in range(len(sizes)) if i != k))
        return hist
    first = np.arange(0, x.size, x.shape[1])
    if len(node) and node.min() < 0:
        inside = np.flatnonzero(node >= 0)
        first, node, a, b = first[inside], node[inside], a[inside], b[inside]
    same = bool((columns == columns[0]).all())
    # Where the first sum is the second one of some rows, one pass adds up both.
    part = a != 0
    shares = bool((a[:100] == b[:100] * part[:100]).all() and (a == b * part).all())
    begin = node * (2 * width) + part if shares else node * width
    flat = x.reshape(-1)
    for j in range(count):
        bins = flat.take(first + (columns[0, j] if same else columns[:, j].take(node)))
        if shares:
            sums = np.bincount(begin + 2 * bins, b, 2 * nodes * width).reshape(nodes, width, 2)
            hist[:, j, :, 0] = sums[..., 1]
            hist[:, j, :, 1] = sums[..., 0] + sums[..., 1]
            continue
        cell = begin + bins
        for s, weights in enumerate((a, b)):
            hist[:, j, :, s] = np.bincount(cell, weights, nodes * width).reshape(nodes, width)
    return hist


class Rows(NamedTuple):
    """A batch of binned rows."""

    x: dict[int, np.ndarray]
    h: np.ndarray
    y: np.ndarray
    w: np.ndarray
    folds: dict[str, np.ndarray]

    def taken(self, p: Params) -> np.ndarray:
        return np.ones(len(self.y), bool) if p.fold is None else self.folds[p.fold[0]] != p.fold[1]


def _stats(rows: Rows, p: Params, margin: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    w = rows.w * np.where(rows.y == 1, p.ones, 1.0)
    if p.kind != "boost":
        return w * rows.y, w
    chance = 1 / (1 + np.exp(-margin)) if margin is not None else np.full(len(w), 0.5)
    return w * (chance - rows.y), w * np.maximum(chance * (1 - chance), 1e-16)


def leaf_value(a: float, b: float, p: Params) -> float:
    """Step of a boosted leaf, share of ones of a forest's."""
    if p.kind != "boost":
        return a / b if b > 0 else 0.0
    g = np.sign(a) * max(abs(a) - p.l1, 0.0)
    return float(-p.step / p.trees * g / (b + p.l2)) if b + p.l2 > 0 else 0.0


def values_of(tree: Tree, p: Params) -> np.ndarray:
    if p.kind == "boost":
        return np.array([leaf_value(a, b, p) for a, b in tree.sums])
    a, b = np.array(tree.sums, float).reshape(-1, 2).T
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def margin_of(trees: Sequence[Tree], p: Params, x: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Sum of the trees' steps, added to ``before`` where it is given."""
    total = np.zeros(len(x)) if before is None else np.array(before)
    for tree in trees:
        total += values_of(tree, p)[tree.place(x)]
    return total


# ---- growth ----


@dataclass
class Job:
    """A tree that grows: its nodes still to be measured, and splits not yet made."""

    p: Params
    tree: Tree
    before: list[Tree]
    open: list[int]
    found: dict[int, Split] = field(default_factory=dict)
    held: tuple | None = None  # rows of the tree, where they are in memory

    def learn(self, splits: dict[int, Split] | Splits, width: int) -> None:
        """Take the splits of the open nodes and open the children of those that are made."""
        tree, p = self.tree, self.p
        if isinstance(splits, Splits):
            if not (p.leaves or p.by_gain):
                self.learn_level(splits, width)
                return
            splits = dict(zip(self.open, splits.each()))
        if self.open == [0]:
            root = splits[0]
            tree.sums[0] = (root.left[0] + root.right[0], root.left[1] + root.right[1])
        self.found |= {n: s for n, s in splits.items() if s.feature >= 0}
        self.open = []
        order = sorted(self.found, key=lambda n: (self.found[n].gain if p.by_gain else 0.0, -n))
        while self.found:
            if p.leaves and (len(tree.left) + 1) // 2 >= p.leaves:
                self.found = {}
                break
            node = order.pop()
            split = self.found.pop(node)
            tree.feature[node], tree.route[node], tree.gain[node] = split.feature, split.route, split.gain
            tree.left[node], tree.right[node] = (tree.add(tree.depth[node] + 1, s, width) for s in (split.left, split.right))
            if tree.depth[node] + 1 < p.depth:
                self.open += [tree.left[node], tree.right[node]]
                if p.leaves and p.by_gain:
                    # A child may gain more than what is known so far.
                    break


    def learn_level(self, splits: Splits, width: int) -> None:
        """The same for a whole level, whose nodes are the last ones of the tree."""
        tree, first = self.tree, self.open[0]
        if self.open == [0]:
            tree.sums[0] = tuple((splits.left[0] + splits.right[0]).tolist())
        made = splits.feature >= 0
        count, depth = int(made.sum()), tree.depth[first] + 1
        left = np.full(len(made), -1)
        left[made] = first + len(made) + 2 * np.arange(count)
        tree.feature[first:], tree.gain[first:] = splits.feature.tolist(), splits.gain.tolist()
        tree.route[first:] = list(splits.route)
        tree.left[first:], tree.right[first:] = left.tolist(), np.where(made, left + 1, -1).tolist()
        sums = np.stack([splits.left[made], splits.right[made]], axis=1).reshape(-1, 2)
        self.open = list(range(first + len(made), first + len(made) + 2 * count)) if depth < self.p.depth else []
        for values, value in ((tree.feature, -1), (tree.left, -1), (tree.right, -1), (tree.depth, depth), (tree.gain, 0.0)):
            values.extend([value] * (2 * count))
        tree.route.extend([np.zeros(width, bool)] * (2 * count))
        tree.sums.extend(zip(*sums.T.tolist()))


#: Gives the best splits of the open nodes of trees, by node or in their order.
Measure = Callable[[list[Job]], list[dict[int, Split] | Splits]]


def _positions(job: Job, at: np.ndarray) -> np.ndarray:
    """Position of each row's node among the open ones, -1 for rows elsewhere."""
    position = np.full(len(job.tree.left), -1)
    position[job.open] = np.arange(len(job.open))
    return position[at]


def _sample(job: Job, rows: Rows, stats: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, bin numbers and sums of the rows that a tree is grown from."""
    drawn = times_drawn(rows.h, job.p, job.tree.number)
    chosen, times = (np.arange(len(rows.h)), None) if drawn is None else drawn
    if job.p.fold is not None:
        inside = rows.taken(job.p)[chosen]
        chosen, times = chosen[inside], None if times is None else times[inside]
    x, a, b = rows.x[job.p.x].take(chosen, axis=0), *(s.take(chosen) for s in stats)
    return (chosen, x, a * times, b * times) if job.p.replace else (chosen, x, a, b)


def _joint(job: Job, x: np.ndarray, bins: Sequence[Bins]) -> list[Joint]:
    """Joint cells of the tree's columns where all nodes have the same and the rows are many."""
    if job.p.columns_by_node < 1 or job.p.kind != "boost" or len(x) < JOINT:
        return []
    return joint_cells(x, _columns(job, [0], bins)[0], bins[job.p.x].sizes)


def _columns(job: Job, nodes: Sequence[int], bins: Sequence[Bins]) -> np.ndarray:
    return columns_of(job.p, job.tree.number, np.array(nodes), len(bins[job.p.x].columns))


def _splits(hist: np.ndarray, job: Job, nodes: Sequence[int], bins: Sequence[Bins], columns: np.ndarray | None = None) -> list[Split]:
    columns = _columns(job, nodes, bins) if columns is None else columns
    return best_splits(hist, job.p, bins[job.p.x].ordered, columns, job.tree.number, np.array(nodes))


def measure_here(rows: Rows, bins: Sequence[Bins]) -> Measure:
    """Best splits from rows that are in memory."""
    width = [b.width for b in bins]
    margins: dict[int, tuple[int, np.ndarray]] = {}  # by model: of how many trees, and the sums

    def gradients(job: Job) -> tuple[np.ndarray, np.ndarray]:
        margin = None
        if job.p.kind == "boost":
            done, margin = margins.pop(id(job.p), (0, None))
            margin = margin_of(job.before[done:], job.p, rows.x[job.p.x], margin)
            margins[id(job.p)] = (len(job.before), margin)
        return _stats(rows, job.p, margin)

    def measure(jobs: list[Job]) -> list[dict[int, Split]]:
        found, shared = [], (None, None)
        for job in jobs:
            if job.held is None:
                # Trees of a round have the same gradients.
                if shared[0] is not job.before:
                    shared = (job.before, gradients(job))
                _, x, a, b = _sample(job, rows, shared[1])
                job.held = (x, a, b, np.zeros(len(x), np.intp), _joint(job, x, bins))
            x, a, b, at, joint = job.held
            if job.open != [0]:
                at = job.tree.place(x, 1, at=at)
                going = np.flatnonzero(_positions(job, at) >= 0)
                if len(going) < 0.7 * len(at) and not job.found:
                    # The others are in leaves, as no split waits to be made.
                    x, a, b, at = (v[going] for v in (x, a, b, at))
                    joint = [j._replace(cell=j.cell[going]) for j in joint]
                job.held = (x, a, b, at, joint)
            splits, columns = {}, _columns(job, job.open, bins)
            together = max(64, HERE // (columns.shape[1] * width[job.p.x]))
            for begin in range(0, len(job.open), together):
                part = job.open[begin : begin + together]
                position = np.full(len(job.tree.left), -1)
                position[part] = np.arange(len(part))
                hist = histogram(x, position[at], (a, b), columns[begin : begin + together], width[job.p.x], joint)
                # A few nodes at a time, as their gains take many times the room of their sums.
                for k in range(0, len(part), 64):
                    splits |= zip(part[k : k + 64], _splits(hist[k : k + 64], job, part[k : k + 64], bins, columns[begin + k : begin + min(k + 64, together)]))
            found.append(splits)
        return found

    return measure


def _rows_of(batch: pa.RecordBatch | pa.Table, bins: Sequence[Bins], used: Sequence[int], folds: Sequence[str]) -> Rows:
    whole = lambda name: v.combine_chunks() if isinstance(v := batch.column(name), pa.ChunkedArray) else v
    column = lambda name: whole(name).to_numpy(zero_copy_only=False)
    array = lambda i: whole(f"x{i}").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(bins[i].columns))
    return Rows({i: array(i) for i in used}, column("h"), column("y"), column("w"), {name: column(name) for name in folds})


#: Rows that a pass adds up at a time; a histogram may be larger than a batch.
CHUNK = 200_000
FOREST_CHUNK = 30_000
#: Trees by which margins may lag behind before they are written beside the rows.
LAG = 8
#: Models whose margins are written.
MODELS = 40


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _with_margins(table: DataFrame, jobs: Sequence[Job], bins: Sequence[Bins], done: dict[int, tuple[int, int]]) -> DataFrame:
    """What passes read, with the sum of the trees so far of each job's model. ``done`` has the
    place and the number of trees of those that the table has already."""
    used, folds = sorted({j.p.x for j in jobs}), sorted({j.p.fold[0] for j in jobs if j.p.fold})
    models = [(j.p, used.index(j.p.x), j.before, *done.get(id(j.p), (-1, 0))) for j in jobs]
    widths = [len(bins[i].columns) for i in used]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def margins(*arrays: pa.Array) -> pa.Array:
        x = [v.flatten().to_numpy(zero_copy_only=False).reshape(-1, w) for v, w in zip(arrays, widths)]
        n = len(arrays[0])
        old = arrays[-1].flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if len(arrays) > len(used) else None
        found = np.empty((n, len(models)))
        for k, (p, i, trees, place, count) in enumerate(models):
            found[:, k] = margin_of(trees[count:], p, x[i], old[:, place] if place >= 0 else None)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(models), pa.int32()), pa.array(found.ravel()))

    read = [f"x{i}" for i in used] + (["margins"] if "margins" in table.columns else [])
    return table.select("h", "y", "w", *[f"x{i}" for i in used], *folds, margins(*read).alias("margins"))


#: Cells of the histograms that travel together.
BLOCK = 50_000
_SUMS = "job int, block int, branch int, sums binary"
_SPLITS = "job int, node int, gain double, feature int, route binary, sums array<double>"


def measure_on_spark(table: DataFrame, bins: Sequence[Bins]) -> Measure:
    """Best splits from passes over the written table. The margins of boosted models are
    written beside the rows as their trees become many, so that a pass walks few of them."""
    read, done, written = table, {}, []
    parts = table.rdd.getNumPartitions()

    def advance(jobs: list[Job]) -> None:
        nonlocal read, done, parts
        latest = list({id(j.p): j for j in jobs if j.p.kind == "boost"}.values())
        # Margins of many models would take more room than the rows.
        if not latest or len(latest) > MODELS or max(len(j.before) - done.get(id(j.p), (0, 0))[1] for j in latest) < LAG:
            return
        path = new_path(table.sparkSession, "margins")
        found = _with_margins(read, latest, bins, done)
        found.write.parquet(path)
        read = table.sparkSession.read.schema(found.schema).parquet(path)
        parts = read.rdd.getNumPartitions()
        done = {id(j.p): (k, len(j.before)) for k, j in enumerate(latest)}
        if written:
            remove(table.sparkSession, written.pop())
        written.append(path)

    forests = _measure_forests(table, bins)

    def measure(jobs: list[Job]) -> list[dict[int, Split] | Splits]:
        counted = [i for i, job in enumerate(jobs) if job.p.kind != "boost"]
        if counted:
            found = dict(zip(counted, forests([jobs[i] for i in counted])))
            others = [i for i in range(len(jobs)) if i not in found]
            found |= zip(others, boosts([jobs[i] for i in others]) if others else [])
            return [found[i] for i in range(len(jobs))]
        return boosts(jobs)

    def boosts(jobs: list[Job]) -> list[dict[int, Split]]:
        found: list[dict[int, Split]] = []
        block: list[Job] = []
        held = 0
        if any(job.open == [0] for job in jobs):
            advance(jobs)
        for job in jobs:
            # As many columns for each node.
            cells = _columns(job, [0], bins).size * len(job.open) * bins[job.p.x].width
            if block and held + cells > CELLS:
                found += one_pass(block)
                block, held = [], 0
            block.append(job)
            held += cells
        return found + one_pass(block)

    def one_pass(jobs: list[Job]) -> list[dict[int, Split]]:
        folds, used = sorted({j.p.fold[0] for j in jobs if j.p.fold}), sorted({j.p.x for j in jobs})
        saved = [done.get(id(j.p), (-1, 0)) for j in jobs]
        lists = ["margins"] if any(k >= 0 for k, _ in saved) else []
        narrow = read.select("h", "y", "w", *[f"x{i}" for i in used], *folds, *lists)
        columns = [_columns(j, j.open, bins) for j in jobs]
        shape = [(c.shape[1], bins[j.p.x].width, 2) for c, j in zip(columns, jobs)]
        together = [max(1, BLOCK // (of[0] * of[1])) for of in shape]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((len(j.open), *of)) for j, of in zip(jobs, shape)]
            steps = [j.tree.steps() for j in jobs]
            # Rows that stay in the cache, where all trees read them.
            size = FOREST_CHUNK if all(j.p.kind != "boost" for j in jobs) else CHUNK
            for chunk in _chunks(batches, size):
                rows, shared = _rows_of(chunk, bins, used, folds), (None, None)
                # Joint cells are read off whole columns.
                by_column = {k: np.asfortranarray(x) for k, x in rows.x.items()}
                old = chunk["margins"].combine_chunks().flatten().to_numpy().reshape(len(rows.y), -1) if lists else None
                for i, job in enumerate(jobs):
                    k, count = saved[i]
                    if shared[0] is not job.before:
                        margin = margin_of(job.before[count:], job.p, rows.x[job.p.x], old[:, k] if k >= 0 else None) if job.before else None
                        shared = (job.before, _stats(rows, job.p, margin))
                    chosen, x, a, b = _sample(job, rows, shared[1])
                    node = _positions(job, job.tree.place(x, steps=steps[i]))
                    joint = [j._replace(cell=j.cell.take(chosen)) for j in _joint(job, by_column[job.p.x], bins)]
                    total[i] += histogram(x, node, (a, b), columns[i], bins[job.p.x].width, joint)
            branch = TaskContext.get().partitionId() % BRANCHES
            out = [(i, k, branch, t[k * n : (k + 1) * n].tobytes()) for i, (t, n) in enumerate(zip(total, together)) for k in range(-(-len(t) // n))]
            numbers = [pa.array(v, pa.int32()) for v in list(zip(*out))[:3]]
            yield pa.RecordBatch.from_arrays([*numbers, pa.array([r[3] for r in out], pa.binary())], names=["job", "block", "branch", "sums"])

        def added(part: pa.Table) -> np.ndarray:
            return sum(np.frombuffer(v.as_buffer()) for chunk in part["sums"].chunks for v in chunk)

        def merged(part: pa.Table) -> pa.Table:
            first = part.select(["job", "block", "branch"]).slice(0, 1)
            return first.append_column("sums", pa.array([added(part).tobytes()], pa.binary()))

        def split(part: pa.Table) -> pa.Table:
            i, k = part["job"][0].as_py(), part["block"][0].as_py()
            nodes = jobs[i].open[k * together[i] : (k + 1) * together[i]]
            rows = [
                (i, node, best.gain, best.feature, best.route.tobytes(), [*best.left, *best.right])
                for node, best in zip(nodes, _splits(added(part).reshape(-1, *shape[i]), jobs[i], nodes, bins))
            ]
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.binary(), pa.list_(pa.float64()))
            names = ("job", "node", "gain", "feature", "route", "sums")
            return pa.table([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)

        by_branch = narrow.mapInArrow(sums, _SUMS)
        if parts > BRANCHES:
            by_branch = by_branch.groupBy("job", "block", "branch").applyInArrow(merged, _SUMS)
        found: list[dict[int, Split]] = [{} for _ in jobs]
        splits = by_branch.groupBy("job", "block").applyInArrow(split, _SPLITS).toArrow()
        four = splits["sums"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 4).tolist()
        for job, node, gain, feature, route, s in zip(*(splits[n].to_pylist() for n in ("job", "node", "gain", "feature", "route")), four):
            found[job][node] = Split(gain, feature, np.frombuffer(route, bool), (s[0], s[1]), (s[2], s[3]))
        return found

    return measure


class Ahead(NamedTuple):
    """What a pass needs to know of a tree: its splits, the open nodes and their columns."""

    p: Params
    number: int
    levels: int
    feature: np.ndarray
    route: np.ndarray  # bits
    left: np.ndarray
    open: np.ndarray
    columns: np.ndarray

    def draw(self) -> tuple:
        """What decides which rows the tree is grown from, but for the number of a fold."""
        return (self.number, self.p.seed, self.p.rate, self.p.replace, self.p.x, self.p.fold[0] if self.p.fold else "")

    def looks(self) -> tuple:
        """Equal for trees that are the same so far."""
        return (self.p.ones, *(v.tobytes() for v in (self.feature, self.left, self.route, self.open, self.columns)))

    def whole(self, width: int) -> packed.Tree:
        goes_left = np.unpackbits(self.route, axis=1, count=width).view(bool)
        left = self.left.astype(np.intp)[:, None]
        step = np.where(left >= 0, np.where(goes_left, left, left + 1), np.arange(len(left))[:, None])
        position = np.full(len(left), len(self.open))
        position[self.open] = np.arange(len(self.open))
        return packed.Tree(np.maximum(self.feature, 0).astype(np.intp), self.left, step, position, self.levels, len(self.open))


def _ahead(job: Job, bins: Sequence[Bins]) -> Ahead:
    tree, columns = job.tree, _columns(job, job.open, bins)
    arrays = np.array(tree.feature, np.int16), np.packbits(np.array(tree.route, bool), axis=1), np.array(tree.left, np.int32)
    return Ahead(job.p, tree.number, max(tree.depth[n] for n in job.open), *arrays, np.array(job.open, np.int32), columns.astype(np.int16))


#: Rows whose blocks a task holds, and cells that it counts in a pass.
HELD_ROWS = 1_000_000
FOREST_CELLS = 12_000_000
_BLOCKS = "job int, block int, branch int, cells int, sums binary"
_FOUND = "job int, block int, gain binary, feature binary, route binary, sides binary"


def _add_up(held: Sequence[packed.Block], jobs: Sequence[Ahead], sizes: Sequence[np.ndarray], total: Sequence[np.ndarray]) -> None:
    """Add the rows of some blocks to the sums by cell of each tree. What trees have in common,
    the rows drawn and the order of their folds, is made once."""
    few: dict[tuple[int, int], packed.Combined] = {}
    for draw, group in groupby(sorted(range(len(jobs)), key=lambda i: jobs[i].draw()), key=lambda i: jobs[i].draw()):
        numbers, samples = list(group), []
        first = jobs[numbers[0]]
        p, of = first.p, sizes[first.p.x]
        for k, block in enumerate(held):
            drawn = times_drawn(block.h, p, first.number)
            chosen, weight = (np.arange(len(block.h)), None) if drawn is None else drawn
            if drawn is not None and not p.replace:
                weight = None
            fold = block.folds[p.fold[0]].take(chosen) if p.fold else None
            if fold is not None:
                order = np.argsort(fold.astype(np.int16) if abs(fold).max(initial=0) < 2**15 else fold, kind="stable")
                chosen, fold = chosen.take(order), fold.take(order)
                weight = None if weight is None else weight.take(order)
            if (k, p.x) not in few:
                few[k, p.x] = packed.combined(block.x[p.x], of)
            common = few[k, p.x]
            x, y, w = block.x[p.x].take(chosen, axis=1), block.y.take(chosen), block.w.take(chosen)
            weight = weight if (w == 1).all() else w if weight is None else w * weight
            code = common.code.take(chosen)
            add = lambda ones, mine: samples.append((packed.sample(x, of, common, code, ones, mine), fold, y))  # noqa: B023, E731
            if ((y == 0) | (y == 1)).all():
                add(y == 1, weight)
            else:
                # A row counts in part among the zeros and among the ones.
                add(np.zeros(len(y), bool), 1 - y if weight is None else weight * (1 - y))
                add(np.ones(len(y), bool), y if weight is None else weight * y)
        alike: dict[tuple, list[int]] = {}
        for i in numbers:
            alike.setdefault(jobs[i].looks(), []).append(i)
        for same in alike.values():
            job, layouts = jobs[same[0]], {}
            out = sorted({jobs[i].p.fold[1] for i in same if jobs[i].p.fold})
            tree = job.whole(int(of.max()))
            passed = packed.masks(tree)
            for sample, fold, y in samples:
                columns = tuple(sample.few.columns)
                if columns not in layouts:
                    layouts[columns] = packed.layout(job.columns, of, sample.few)
                if job.p.ones != 1.0:
                    ones = np.where(y == 1, job.p.ones, 1.0)
                    sample = sample._replace(weight=ones if sample.weight is None else sample.weight * ones)
                counted = lambda ranges: packed.count(sample, tree, passed, layouts[columns], of, ranges)  # noqa: B023, E731
                held_out = [(int(np.searchsorted(fold, k)), int(np.searchsorted(fold, k, "right"))) for k in out]
                ends = [0, *(end for pair in held_out for end in pair), len(y)]
                rest = counted([pair for pair in zip(ends[::2], ends[1::2]) if pair[0] < pair[1]])
                # Trees that are the same so far, whatever fold they leave out, are counted fold by fold.
                by_fold = {k: counted([pair]) for k, pair in zip(out, held_out)} if len(out) > 1 else {}
                for i in same:
                    total[i] += sum((found for k, found in by_fold.items() if k != jobs[i].p.fold[1]), rest)


def _measure_forests(table: DataFrame, bins: Sequence[Bins]) -> Callable[[list[Job]], list[Splits]]:
    """Best splits of trees of ones and weights, from passes over the rows in blocks."""
    sizes = [np.array(b.sizes) for b in bins]
    blocks: dict[tuple[str, ...], DataFrame] = {}

    def measure(jobs: list[Job]) -> list[Splits]:
        found: list[Splits] = []
        ahead = [_ahead(job, bins) for job in jobs]
        # Trees that are grown from the same rows come to the same pass.
        order, part, held = sorted(range(len(jobs)), key=lambda i: ahead[i].draw()), [], 0
        for job in (ahead[i] for i in order):
            cells = int(sizes[job.p.x][job.columns].sum())
            if part and held + cells > FOREST_CELLS:
                found += one_pass(part)
                part, held = [], 0
            part.append(job)
            held += cells
        in_order = dict(zip(order, found + one_pass(part)))
        return [in_order[i] for i in range(len(jobs))]

    def one_pass(jobs: list[Ahead]) -> list[Splits]:
        folds = tuple(sorted({j.p.fold[0] for j in jobs if j.p.fold}))
        known_ = next((names for names in blocks if set(folds) <= set(names)), None)
        if known_ is None:
            blocks[folds] = packed.pack(table, sizes, folds)
            known_ = folds
        used = {i: sizes[i] for i in sorted({j.p.x for j in jobs})}
        rows = blocks[known_].select("h", "y", "w", *folds, *[f"x{i}" for i in used])
        parts = rows.rdd.getNumPartitions()
        # Nodes whose sums travel together.
        together = [max(1, BLOCK * len(j.open) // max(1, int(sizes[j.p.x][j.columns].sum()))) for j in jobs]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begins = [packed.cells_before(j.columns, sizes[j.p.x])[:: j.columns.shape[1]] for j in jobs]
            total = [np.zeros((begin[-1], 2)) for begin in begins]
            held: list[packed.Block] = []
            for block in packed.unpacked(batches, used, folds):
                held.append(block)
                if sum(len(b.h) for b in held) >= HELD_ROWS:
                    _add_up(held, jobs, sizes, total)
                    held = []
            if held:
                _add_up(held, jobs, sizes, total)
            branch, out = TaskContext.get().partitionId() % BRANCHES, []
            for i, (job, begin) in enumerate(zip(jobs, begins)):
                for k, start in enumerate(range(0, len(job.open), together[i])):
                    mine = total[i][begin[start] : begin[min(start + together[i], len(job.open))]]
                    out.append((i, k, branch, mine.size, packed.narrow(mine).tobytes()))
                total[i] = None
            numbers = [pa.array(v, pa.int32()) for v in list(zip(*out))[:4]]
            yield pa.RecordBatch.from_arrays([*numbers, pa.array([r[4] for r in out], pa.binary())], names=["job", "block", "branch", "cells", "sums"])

        def added(part: pa.Table) -> np.ndarray:
            return sum(packed.widened(v, part["cells"][0].as_py()) for chunk in part["sums"].chunks for v in chunk)

        def merged(part: pa.Table) -> pa.Table:
            first = part.select(["job", "block", "branch", "cells"]).slice(0, 1)
            return first.append_column("sums", pa.array([packed.narrow(added(part)).tobytes()], pa.binary()))

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                numbers = (batch[name].to_pylist() for name in ("job", "block", "cells"))
                for i, k, cells, sums in zip(*numbers, batch["sums"]):
                    found = packed.widened(sums, cells)
                    whole[i, k] = whole[i, k] + found if (i, k) in whole else found
            out = [(i, k, *best(i, k, found.reshape(-1, 2))) for (i, k), found in whole.items()]
            kinds = [*[pa.int32()] * 2, *[pa.binary()] * 4]
            columns = [pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["job", "block", "gain", "feature", "route", "sides"])

        def best(i: int, k: int, counts: np.ndarray) -> list[bytes]:
            job, ours = jobs[i], slice(k * together[i], (k + 1) * together[i])
            nodes, columns = job.open[ours], job.columns[ours].astype(np.intp)
            of, found = sizes[job.p.x], []
            begin = packed.cells_before(columns, of)[:: columns.shape[1]]
            # A few nodes at a time, as their gains take many times the room of their sums.
            for b in range(0, len(nodes), 64):
                some = columns[b : b + 64]
                hist = np.zeros((*some.shape, int(of.max()), 2))
                here = np.arange(hist.shape[2]) < of[some][..., None]
                mine = counts[begin[b] : begin[min(b + 64, len(nodes))]]
                hist[here, 0], hist[here, 1] = mine[:, 1], mine.sum(1)
                found.append(splits_of(hist, job.p, bins[job.p.x].ordered, some, job.number, nodes[b : b + 64]))
            whole = Splits(*(np.concatenate(v) for v in zip(*found)))
            sides = np.concatenate([whole.left, whole.right], axis=1)
            # Routes are as wide as the widest column, whatever the columns here.
            route = np.zeros((len(nodes), bins[job.p.x].width), bool)
            route[:, : whole.route.shape[1]] = whole.route
            return [v.tobytes() for v in (whole.gain, whole.feature.astype(np.int32), np.packbits(route, axis=1), np.ascontiguousarray(sides))]

        by_branch = rows.mapInArrow(sums, _BLOCKS)
        if parts > BRANCHES:
            by_branch = by_branch.groupBy("job", "block", "branch").applyInArrow(merged, _BLOCKS)
        tasks = min(sum(-(-len(j.open) // n) for j, n in zip(jobs, together)), table.sparkSession.sparkContext.defaultParallelism)
        got = by_branch.repartition(max(tasks, 1), "job", "block").mapInArrow(split, _FOUND).toArrow()
        by_job: list[list[tuple[int, Splits]]] = [[] for _ in jobs]
        for r in got.to_pylist():
            width = bins[jobs[r["job"]].p.x].width
            feature = np.frombuffer(r["feature"], np.int32).astype(int)
            route = np.unpackbits(np.frombuffer(r["route"], np.uint8).reshape(len(feature), -1), axis=1, count=width).view(bool)
            sides = np.frombuffer(r["sides"]).reshape(-1, 4)
            by_job[r["job"]].append((r["block"], Splits(np.frombuffer(r["gain"]), feature, route, sides[:, :2], sides[:, 2:])))
        return [Splits(*(np.concatenate(v) for v in zip(*(splits for _, splits in sorted(mine, key=lambda b: b[0]))))) for mine in by_job]

    return measure


class Model(NamedTuple):
    """Trees with their bins and settings."""

    p: Params
    bins: Bins
    trees: list[Tree]


def grow_trees(jobs: list[Job], bins: Sequence[Bins], measure: Measure) -> None:
    while jobs:
        for job, splits in zip(jobs, measure(jobs)):
            job.learn(splits, bins[job.p.x].width)
        for job in jobs:
            job.held = job.held if job.open else None
            if not job.open:
                # One matrix takes less room than its rows.
                job.tree.route = list(np.array(job.tree.route, bool))
        jobs = [job for job in jobs if job.open]


def grow(plans: Sequence[Params], bins: Sequence[Bins], measure: Measure) -> list[Model]:
    """One model per plan; all trees that do not wait for others grow together, and so do
    the rounds of different models."""
    models = [Model(p, bins[p.x], []) for p in plans]
    for done in range(max(p.rounds for p in plans)):
        jobs = []
        for model in models:
            if done < model.p.rounds:
                before = list(model.trees)
                for k in range(model.p.trees):
                    tree = Tree(done * model.p.trees + k)
                    tree.add(0, (0.0, 0.0), model.bins.width)
                    model.trees.append(tree)
                    jobs.append(Job(model.p, tree, before, [0]))
        grow_trees(jobs, bins, measure)
    return models


def differ_in_gain(plans: Sequence[Params]) -> list[list[int]]:
    """The plans' numbers, together where they differ in the least gain of a split only and a
    tree of the lesser, cut where a split gains too little, is the tree of the greater."""
    found: dict[object, list[int]] = {}
    for i, p in enumerate(plans):
        nested = p.kind == "boost" and not p.leaves and not p.by_gain and p.columns_by_node >= 1 and not p.random_cuts
        found.setdefault(replace(p, gain=0.0) if nested else i, []).append(i)
    return list(found.values())


def cut_by_gain(tree: Tree, gain: float) -> Tree:
    """The tree without splits that gain no more, numbered as if it had been grown so; the
    tree itself where there are none."""
    if all(l < 0 or g > gain for l, g in zip(tree.left, tree.gain)):
        return tree
    found = Tree(tree.number)
    found.add(0, tree.sums[0], len(tree.route[0]))
    pairs = [(0, 0)]
    for old, new in pairs:
        if tree.left[old] >= 0 and tree.gain[old] > gain:
            found.feature[new], found.route[new], found.gain[new] = tree.feature[old], tree.route[old], tree.gain[old]
            below = tree.left[old], tree.right[old]
            found.left[new], found.right[new] = (found.add(found.depth[new] + 1, tree.sums[n], len(tree.route[0])) for n in below)
            pairs += zip(below, (found.left[new], found.right[new]))
    return found


def grow_alike(plans: Sequence[Params], bins: Sequence[Bins], measure: Measure) -> list[Model]:
    """``grow`` for plans that differ in the least gain only: as long as their trees are the
    same they are grown once, with the least of their gains."""
    return grow_together([plans], bins, measure)[0]


def grow_together(families: Sequence[Sequence[Params]], bins: Sequence[Bins], measure: Measure) -> list[list[Model]]:
    """``grow_alike`` of several families of plans, whose trees of a round are measured in the
    same passes."""
    models = [[Model(p, bins[p.x], []) for p in plans] for plans in families]
    groups = [(f, sorted(range(len(plans)), key=lambda i: plans[i].gain)) for f, plans in enumerate(families)]
    for done in range(max(plans[0].rounds for plans in families)):
        groups = [(f, group) for f, group in groups if done < families[f][0].rounds]
        jobs, mine, found = [], [], []
        for f, group in groups:
            p, before = families[f][group[0]], list(models[f][group[0]].trees)
            mine.append([])
            for k in range(p.trees):
                tree = Tree(done * p.trees + k)
                tree.add(0, (0.0, 0.0), bins[p.x].width)
                mine[-1].append(Job(p, tree, before, [0]))
            jobs += mine[-1]
        grow_trees(list(jobs), bins, measure)
        for (f, group), own in zip(groups, mine):
            alike: dict[tuple, list[int]] = {}
            cut: dict[tuple, list[Tree]] = {}
            for i in group:
                trees = [cut_by_gain(job.tree, max(families[f][i].gain, LEAST_GAIN)) for job in own]
                # Of trees that are cut from the same, those of one size are the same.
                size = tuple(len(tree.left) for tree in trees)
                alike.setdefault(size, []).append(i)
                models[f][i].trees.extend(cut.setdefault(size, trees))
            found += [(f, group) for group in alike.values()]
        groups = found
    return models


# ---- rows that are few enough to be sent whole ----

#: Bytes of binned rows that are broadcast at most; larger tables are read in passes.
SENT = 128 << 20


def row_bytes(bins: Sequence[Bins], folds: Sequence[str] = ()) -> int:
    return sum(2 * len(b.columns) for b in bins) + 24 + 4 * len(folds)


def sent_rows(table: DataFrame, bins: Sequence[Bins], folds: Sequence[str] = (), most: int | None = None):
    """The rows as a broadcast value, or None where they are more than ``most`` bytes."""
    if table.count() * row_bytes(bins, folds) > (SENT if most is None else most):
        return None
    columns = ["h", "y", "w", *[f"x{i}" for i in range(len(bins))], *folds]
    batches = table.select(columns).toArrow().combine_chunks().to_batches()
    if not batches:
        return None
    rows = _rows_of(batches[0], bins, range(len(bins)), folds)
    rows = Rows({i: np.ascontiguousarray(x) for i, x in rows.x.items()}, *rows[1:])
    return table.sparkSession.sparkContext.broadcast(rows)


def in_tasks(spark: SparkSession, count: int, schema: str, work: Callable[[int], list[dict]]) -> DataFrame:
    """Rows that ``work`` makes of the numbers below count, each in a task of its own."""

    kind = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch["id"].to_pylist():
                yield pa.RecordBatch.from_pylist(work(i), kind)

    return spark.range(0, count, 1, max(count, 1)).mapInArrow(run, schema)


def fit(table: DataFrame, bins: Bins, p: Params, most: int | None = None) -> Model:
    """One model from the written table of ``binned``.

    The trees of a forest do not wait for each other, so each is grown in a task of its
    own where the rows are few enough to be sent; otherwise, and for boosting, by passes.
    """
    sent = sent_rows(table, [bins], [p.fold[0]] if p.fold else [], most) if p.rounds == 1 and p.trees > 1 else None
    if sent is None:
        return grow([p], [bins], measure_on_spark(table, [bins]))[0]

    def one(i: int) -> list[dict]:
        tree = Tree(i)
        tree.add(0, (0.0, 0.0), bins.width)
        grow_trees([Job(p, tree, [], [0])], [bins], measure_here(sent.value, [bins]))
        return [{"number": i, "tree": pickle.dumps(tree)}]

    found = in_tasks(table.sparkSession, p.trees, "number int, tree binary", one).collect()
    return Model(p, bins, [pickle.loads(r["tree"]) for r in sorted(found, key=lambda r: r["number"])])


# ---- scores ----


class Walk(NamedTuple):
    """How a tree is walked and what its nodes are worth, made once for many batches."""

    tree: Tree
    depth: int
    steps: tuple[np.ndarray, np.ndarray]
    values: np.ndarray


def walks(model: Model, depth: int | None = None, trees: int | None = None, merge: bool = False) -> list[Walk]:
    found = []
    for tree in model.trees[:trees]:
        at = depth if depth is not None else max(tree.depth)
        found.append(Walk(tree, at, tree.steps(tree.alike(at) if merge else None), values_of(tree, model.p)))
    return found


def raw_scores(
    model: Model, x: np.ndarray, depth: int | None = None, trees: int | None = None, merge: bool = False, made: Sequence[Walk] | None = None
) -> np.ndarray:
    """Margin of boosted trees or mean share of ones of a forest, at a depth and from the
    first trees. ``merge`` ends a forest's trees where all leaves below decide alike."""
    made = walks(model, depth, trees, merge) if made is None else made
    total = np.zeros(len(x))
    for walk in made:
        total += walk.values.take(walk.tree.place(x, walk.depth, steps=walk.steps))
    return total if model.p.kind == "boost" else total / max(len(made), 1)


def scores_at(model: Model, x: np.ndarray, readings: Sequence[tuple[int | None, int]]) -> list[np.ndarray]:
    """``raw_scores`` at several (depth, trees), walking each tree once."""
    deepest = lambda tree, depth: max(tree.depth) if depth is None else depth
    found: dict[tuple[int | None, int], np.ndarray] = {}
    totals = {depth: np.zeros(len(x)) for depth, _ in readings}
    wanted = {depth: {n for d, n in readings if d == depth} for depth in totals}
    for number, tree in enumerate(model.trees, 1):
        values, at, steps = values_of(tree, model.p), None, 0
        for depth in sorted(totals, key=lambda d: deepest(tree, d)):
            if number <= max(wanted[depth]):
                at, steps = tree.place(x, deepest(tree, depth) - steps, at=at), deepest(tree, depth)
                totals[depth] += values[at]
        for depth in totals:
            if number in wanted[depth] or number == len(model.trees):
                found |= {(depth, n): totals[depth].copy() for n in wanted[depth] if n >= number}
    none = np.zeros(len(x))
    share = lambda n: 1 if model.p.kind == "boost" else max(min(n, len(model.trees)), 1)
    return [found.get(r, none) / share(r[1]) for r in readings]


def score(model: Model, table: DataFrame, keep: Sequence[str] = (), depth: int | None = None, trees: int | None = None, merge: bool = False) -> DataFrame:
    """Kept columns with raw score, probability and decision (at one half)."""

    made: list[Walk] = []  # in the task, by its first batch

    @F.arrow_udf(T.DoubleType())
    def raw(x: pa.Array) -> pa.Array:
        made.extend([] if made else walks(model, depth, trees, merge))
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        return pa.array(raw_scores(model, rows, depth, trees, merge, made))

    chance = F.col("_raw") if model.p.kind != "boost" else 1 / (1 + F.exp(-F.col("_raw")))
    scored = table.select(*keep, raw(f"x{model.p.x}").alias("_raw"))
    return scored.select(*keep, F.col("_raw").alias("raw_score"), chance.alias("probability"), (chance > 0.5).cast("int").alias("prediction"))


def auc(y: np.ndarray, s: np.ndarray) -> float:
    """Exact area under the ROC curve, ties half."""
    _, place = np.unique(s, return_inverse=True)
    ones = np.bincount(place, y)
    zeros = np.bincount(place, 1 - y)
    below = np.cumsum(zeros) - zeros
    return float((ones * (2 * below + zeros)).sum() / (2 * ones.sum() * zeros.sum()))


# ---- reports ----


def _rule(bins: Bins, feature: int, route: np.ndarray) -> str:
    """What goes left, in words."""
    name, gap = bins.columns[feature], " or missing" if route[0] else ""
    if bins.categories[feature] is not None:
        inside = [c for c, goes in zip(bins.categories[feature], route[1:]) if goes]
        return f"{name} in ({', '.join(inside)}){gap}"
    upto = int(route[1:].sum())
    cuts = bins.cuts[feature]
    return f"{name} <= {cuts[upto - 1]}{gap}" if 0 < upto <= len(cuts) else f"{name} known{gap}" if upto else f"{name} missing"


def node_table(model: Model, spark) -> DataFrame:
    """One row per node: its place, its split and what it weighs. ``cover`` is the sum of
    Hessians or weights, ``value`` what a row gets that ends there."""
    rows = []
    for tree in model.trees:
        values = values_of(tree, model.p)
        for i in range(len(tree.left)):
            inner = tree.left[i] >= 0
            name = model.bins.columns[tree.feature[i]] if inner else None
            rule = _rule(model.bins, tree.feature[i], tree.route[i]) if inner else None
            ends = (tree.left[i], tree.right[i], tree.gain[i]) if inner else (None, None, None)
            rows.append((tree.number, i, tree.depth[i], name, rule, *ends, float(tree.sums[i][1]), float(values[i])))
    return small_frame(spark, rows, "tree int, node int, depth int, feature string, rule string, left int, right int, gain double, cover double, value double")


def importance(nodes: DataFrame) -> DataFrame:
    """How often each feature splits, and the gain and cover of its splits, in total and on
    average; most splits first."""
    found = nodes.where("feature IS NOT NULL").groupBy("feature").agg(
        F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("total_gain"), F.sum("cover").alias("total_cover")
    )
    means = {"mean_gain": F.col("total_gain") / F.col("splits"), "mean_cover": F.col("total_cover") / F.col("splits")}
    return found.withColumns(means).orderBy(F.desc("splits"), "feature")


# ---- the published ways to call them ----


def boosted(
    learning_rate: float = 0.3, max_depth: int = 6, subsample: float = 1.0, colsample_bytree: float = 1.0, min_child_weight: float = 1.0,
    gamma: float = 0.0, alpha: float = 0.0, lambda_: float = 1.0, scale_pos_weight: float = 1.0, num_parallel_tree: int = 1,
    grow_policy: str = "depthwise", max_leaves: int = 0, num_round: int = 10, seed: int = 0,
) -> Params:
    """Settings of second-order boosting by their usual names. A tree of a round has its share
    of the step, so that parallel trees are averaged. Without a limit of leaves both
    policies grow the same tree."""
    if grow_policy not in ("depthwise", "lossguide"):
        raise ValueError(f"unknown growth policy {grow_policy}")
    return Params(
        kind="boost", trees=num_parallel_tree, rounds=num_round, depth=max_depth, leaves=max_leaves, by_gain=grow_policy == "lossguide",
        rate=subsample, columns_by_tree=colsample_bytree, child=min_child_weight, gain=gamma, l1=alpha, l2=lambda_, step=learning_rate,
        ones=scale_pos_weight, seed=seed,
    )


def forest(
    columns: int, numTrees: int = 20, maxDepth: int = 5, impurity: str = "gini", subsamplingRate: float = 1.0, bootstrap: bool = True,
    every_column: bool = False, minInstancesPerNode: float = 1.0, minInfoGain: float = 0.0, seed: int = 1, x: int = 0,
) -> Params:
    """Settings of a forest by the names of Spark's: several trees see the square root of the
    columns at each node, one tree sees all. More than one instance per node is measured
    by weight."""
    if impurity not in ("gini", "entropy"):
        raise ValueError(f"unknown impurity {impurity}")
    share = 1.0 if every_column or numTrees == 1 else np.ceil(columns**0.5) / columns
    return Params(
        kind=impurity, x=x, trees=numTrees, depth=maxDepth, rate=subsamplingRate, replace=bootstrap and numTrees > 1,
        columns_by_node=float(share), child=minInstancesPerNode if minInstancesPerNode > 1 else 0.0, gain=minInfoGain, seed=seed,
    )
