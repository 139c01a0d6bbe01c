"""Binned rows in blocks, column by column, and the sums of forests counted over them.

A pass over a table of rows spends most of its time handing the rows over. In blocks they are
a few long values, read as they lie. The sums of a node are laid out without room for
bins that its columns do not have.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.session import settle

#: Rows of a block.
ROWS = 200_000
#: Rows that are walked and counted at a time, which stay in the cache.
STRIDE = 16_384
#: Columns of few bins are counted together by the combinations that occur, at most so many.
FEW = 8
COMBINED = 256
#: Combinations of columns by which rows are sent down a tree.
TOGETHER = 10_500
#: Levels of a tree that are passed at once: as many leaves as a number has bits.
AT_ONCE = 6


def kind_of(sizes: Sequence[int]) -> type:
    """Type that holds the numbers of bins."""
    return np.uint8 if max(sizes) <= 256 else np.int16


class Block(NamedTuple):
    h: np.ndarray
    y: np.ndarray
    w: np.ndarray
    folds: dict[str, np.ndarray]
    x: dict[int, np.ndarray]  # column by column


def pack(table: DataFrame, sizes: Sequence[Sequence[int]], folds: Sequence[str]) -> DataFrame:
    """The table of ``binned`` in blocks, as many rows for each core, written. ``sizes`` has
    the numbers of bins of the columns of x0, x1, ..."""
    numbers = [("h", np.int64), ("y", np.float64), ("w", np.float64), *((name, np.int32) for name in folds)]
    lists = [f"x{i}" for i in range(len(sizes))]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                yield block(pa.Table.from_batches(held).combine_chunks())
                held = []
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held).combine_chunks())

    def block(part: pa.Table) -> pa.RecordBatch:
        whole = {name: part[name].combine_chunks() for name in part.column_names}
        found = {name: whole[name].to_numpy(zero_copy_only=False).astype(kind).tobytes() for name, kind in numbers}
        for name, of in zip(lists, sizes):
            x = whole[name].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(of))
            found[name] = np.ascontiguousarray(x.T.astype(kind_of(of))).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in found.values()], names=list(found))

    columns = [*(name for name, _ in numbers), *lists]
    spread = F.xxhash64("h", "y", *lists)
    # Rows without a fold are in no fold that is left out.
    known = [F.coalesce(F.col(name), F.lit(-1)).alias(name) if name in folds else F.col(name) for name in columns]
    even = table.select(known).repartition(max(table.sparkSession.sparkContext.defaultParallelism, 1), spread)
    return settle(even.mapInArrow(blocks, ", ".join(f"{name} binary" for name in columns)))


def unpacked(batches: Iterator[pa.RecordBatch], sizes: dict[int, Sequence[int]], folds: Sequence[str]) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            read = lambda name, kind: np.frombuffer(batch[name][row].as_buffer(), kind)  # noqa: B023, E731
            x = {i: read(f"x{i}", kind_of(of)).reshape(len(of), -1) for i, of in sizes.items()}
            yield Block(read("h", np.int64), read("y", np.float64), read("w", np.float64), {name: read(name, np.int32) for name in folds}, x)


class Combined(NamedTuple):
    """Columns of few bins, and their combinations that occur."""

    columns: list[int]
    code: np.ndarray  # by row
    bins: np.ndarray  # by combination and column
    has: np.ndarray  # by combination and (column, bin)
    first: dict[int, int]  # of a column's bins in ``has``


def combined(x: np.ndarray, sizes: Sequence[int]) -> Combined:
    code, bins, chosen, count = np.zeros(x.shape[1], np.int64), np.zeros((1, 0), np.int64), [], 1
    for j in sorted(range(len(sizes)), key=lambda j: sizes[j]):
        if sizes[j] > FEW:
            break
        cell = code * sizes[j] + x[j]
        occurs = np.flatnonzero(np.bincount(cell, minlength=count * sizes[j]))
        if len(occurs) > COMBINED:
            break
        number = np.zeros(count * sizes[j], np.int64)
        number[occurs] = np.arange(len(occurs))
        code, count = number.take(cell), len(occurs)
        bins = np.column_stack([bins[occurs // sizes[j]], occurs % sizes[j]])
        chosen.append(j)
    first = dict(zip(chosen, np.cumsum([0, *(sizes[j] for j in chosen)]).tolist()))
    has = np.zeros((count, sum(sizes[j] for j in chosen)))
    for k, j in enumerate(chosen):
        has[np.arange(count), first[j] + bins[:, k]] = 1.0
    return Combined(chosen, code, bins, has, first)


def cells_before(columns: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the cells of each (node, column) begin, and the number of all."""
    return np.concatenate([[0], np.cumsum(sizes[columns].ravel())])


class Layout(NamedTuple):
    """Where the sums of the open nodes of a tree are: of columns of few bins together, and by
    column of those of many, the places among all sums counted and the cells they are for."""

    cells: int
    few: tuple[np.ndarray, np.ndarray]
    many: dict[int, tuple[np.ndarray, np.ndarray]]


def layout(columns: np.ndarray, sizes: np.ndarray, few: Combined) -> Layout:
    begin = cells_before(columns, sizes)
    at, width = begin[:-1].reshape(columns.shape), few.has.shape[1]
    small = np.full(len(sizes), -1)
    small[list(few.first)] = list(few.first.values())

    def places(node: np.ndarray, j: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = sizes[columns[node, j]]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(first, size) + within, np.repeat(at[node, j], size) + within

    node, j = np.nonzero(small[columns] >= 0)
    found = {}
    for c in np.flatnonzero(small < 0):
        n, k = np.nonzero(columns == c)
        if len(n):
            found[int(c)] = places(n, k, n * sizes.max())
    return Layout(int(begin[-1]), places(node, j, node * width + small[columns[node, j]]), found)


class Sample(NamedTuple):
    """The rows that trees of one draw are grown from."""

    x: np.ndarray  # column by column
    twice: dict[int, np.ndarray]  # of the columns of many bins two times the bin, and one for a one
    codes: list[tuple[list[int], np.ndarray]]  # columns, and their combination by row
    few: Combined
    code: np.ndarray
    code2: np.ndarray  # two times the combination of few bins, and one for a one
    weight: np.ndarray | None


def sample(x: np.ndarray, sizes: Sequence[int], few: Combined, code: np.ndarray, ones: np.ndarray, weight: np.ndarray | None) -> Sample:
    many = sorted(set(range(len(sizes))) - set(few.columns), key=lambda j: sizes[j])
    groups: list[list[int]] = []
    for j in many:
        if groups and np.prod([sizes[c] for c in groups[-1]]) * sizes[j] <= TOGETHER:
            groups[-1].append(j)
        else:
            groups.append([j])
    codes = []
    for group in groups:
        together = x[group[0]].astype(np.intp)
        for j in group[1:]:
            together = together * sizes[j] + x[j]
        codes.append((group, together))
    return Sample(x, {j: 2 * x[j].astype(np.int16) + ones for j in many}, codes, few, code, 2 * code + ones, weight)


class Tree(NamedTuple):
    """A tree by node: column, left child (the right one follows it), next node by bin, place
    among the open nodes. ``next`` has the node itself where a row ends."""

    feature: np.ndarray
    left: np.ndarray
    next: np.ndarray
    position: np.ndarray
    levels: int
    nodes: int  # open ones


class Masks(NamedTuple):
    """Down to a level, the nodes where rows are then, and by column and bin a bit for each of
    those that the column does not rule out."""

    levels: int
    nodes: np.ndarray
    by_column: dict[int, np.ndarray]


def masks(tree: Tree) -> Masks:
    ends, inner, level, levels = [], [], [0], min(tree.levels, AT_ONCE)
    for depth in range(levels + 1):
        here = [n for n in level if depth < levels and tree.left[n] >= 0]
        ends += [n for n in level if depth == levels or tree.left[n] < 0]
        inner += here
        level = [c for n in here for c in (int(tree.left[n]), int(tree.left[n]) + 1)]
    below = {n: 1 << i for i, n in enumerate(ends)}
    for n in reversed(inner):
        below[n] = below[int(tree.left[n])] | below[int(tree.left[n]) + 1]
    sides = [np.array([below[int(tree.left[n]) + k] for n in inner], np.uint64)[:, None] for k in (0, 1)]
    left = tree.left[inner].astype(np.intp)[:, None]
    out = ~np.where(tree.next[inner] == left, sides[1], sides[0]) & np.uint64((1 << len(ends)) - 1)
    feature = tree.feature[inner]
    by_column = {int(c): np.bitwise_and.reduce(out[feature == c], axis=0) for c in np.unique(feature)}
    return Masks(levels, np.array(ends), by_column)


def _tables(found: Masks, of: Sample, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bits by combination of columns, and each row's combination."""
    tables = []
    for group, code in of.codes:
        used = [found.by_column[c][: sizes[c]] if c in found.by_column else None for c in group]
        if all(u is None for u in used):
            continue
        if len(group) > 1 and sum(u is not None for u in used) == 1:
            c = next(c for c, u in zip(group, used) if u is not None)
            tables.append((found.by_column[c], of.x[c]))
            continue
        whole = np.array([2**64 - 1], np.uint64)
        for c, u in zip(group, used):
            whole = (whole[:, None] & (np.full(sizes[c], 2**64 - 1, np.uint64) if u is None else u)).ravel()
        tables.append((whole, code))
    mine = [(k, c) for k, c in enumerate(of.few.columns) if c in found.by_column]
    if mine:
        whole = np.full(len(of.few.bins), 2**64 - 1, np.uint64)
        for k, c in mine:
            whole &= found.by_column[c].take(of.few.bins[:, k])
        tables.append((whole, of.code))
    return tables


def count(of: Sample, tree: Tree, passed: Masks, at: Layout, sizes: np.ndarray, ranges: Sequence[tuple[int, int]]) -> np.ndarray:
    """Weight of zeros and of ones by cell, over the rows of some ranges."""
    levels = passed.levels
    tables, width, n = _tables(passed, of, sizes), tree.next.shape[1], of.x.shape[1]
    straight = tree.position[passed.nodes] if tree.levels == levels else passed.nodes
    flat, next_, first = of.x.reshape(-1), tree.next.reshape(-1), tree.feature * n
    placed = []
    for begin, end in ((b, min(b + STRIDE, upto)) for start, upto in ranges for b in range(start, upto, STRIDE)):
        bits = None
        for table, code in tables:
            found = table.take(code[begin:end])
            bits = found if bits is None else np.bitwise_and(bits, found, out=bits)
        if bits is None:
            here = np.full(end - begin, straight[0])
        else:
            bits -= np.uint64(1)
            here = straight.take(np.bitwise_count(bits))
        if tree.levels > levels:
            row = np.arange(begin, end)
            for _ in range(levels, tree.levels):
                cell = first.take(here)
                cell += row
                here = here * width
                here += flat.take(cell)
                here = next_.take(here)
            here = tree.position.take(here)
        placed.append(here)
    found = np.zeros((at.cells, 2))
    if not placed:
        return found
    place, width = np.concatenate(placed), 2 * int(sizes.max())
    weight = None if of.weight is None else np.concatenate([of.weight[b:e] for b, e in ranges])
    cell = np.empty_like(place)

    def by_cell(each: int, bins: np.ndarray) -> np.ndarray:
        done = 0
        for begin, end in ranges:
            here = slice(done, done + end - begin)
            np.add(place[here], bins[begin:end], out=cell[here])
            done += end - begin
        return np.bincount(cell, weight, (tree.nodes + 1) * each)

    if len(at.few[0]):
        combinations, own = len(of.few.has), place
        place = own * (2 * combinations)
        by = by_cell(2 * combinations, of.code2).reshape(tree.nodes + 1, combinations, 2)[: tree.nodes]
        for s in (0, 1):
            found[at.few[1], s] = (np.ascontiguousarray(by[:, :, s], float) @ of.few.has).reshape(-1).take(at.few[0])
        place = own
    place = place * width
    for c, (counted, cells) in at.many.items():
        found[cells] = by_cell(width, of.twice[c]).reshape(-1, 2).take(counted, axis=0)
    return found


def narrow(sums: np.ndarray) -> np.ndarray:
    """The same numbers in the least room: whole ones as such."""
    most = sums.max(initial=0.0)
    if sums.min(initial=0.0) < 0 or most >= 2**32:
        return sums
    found = sums.astype(np.uint8 if most < 2**8 else np.uint16 if most < 2**16 else np.uint32)
    return found if np.array_equal(found, sums) else sums


def widened(value: pa.Scalar, cells: int) -> np.ndarray:
    """Numbers of ``narrow``, of which there are so many."""
    buffer = value.as_buffer()
    return np.frombuffer(buffer, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.float64}[buffer.size // cells]).astype(float)
