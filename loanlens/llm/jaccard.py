"""Size-aware heavy-light similarity join of documents on word shingles.

Two sets link when 100 * intersection >= 80 * union. Equal sets are one class, known by
the smallest doc_id, and everything below works on classes.

- Light: a small set lists all subsets of the fixed sizes o(a, b) = ceil(4 (a + b) / 9)
  that a linked pair of sizes a and b must share. Sets of sizes a and b that share one are
  linked, so nothing has to be verified.
- Heavy: a larger set scans inverted lists. Rare shingles come first in one order for
  all sets, so linked sets share one of the first n - ceil(0.8 n) + 1, and only those
  are posted. A list falls into runs of sizes that may link. Most pairs of a run are
  refuted by parity sketches, a bound on the symmetric difference: those of a short run
  in a join, those of a longer one in a task of its own, which skips what hangs together
  already and returns a forest. What is on a list of more than ``FAMILY`` sets is not compared:
  all of it hangs on the list's name, without a task that holds the list.
- What hangs together by pairs that are left is a block. A block's sets meet in one task,
  which scans the full inverted lists of the block and counts intersections exactly: those
  of one set with all others, then those of the sets that are not joined with most of the
  block yet. A family of near copies is joined by a few of its members. A block above a size
  is cut in parts, each of which gets one common set; then only the sets outside the
  block's largest component meet the other parts.

Links decide the components and are not counted, as their number in a family is the square
of its size; ``links=True`` counts them, at that cost.

The boundary between light and heavy is the size with the least rows written and
shingles scanned, from the histogram of small sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.common import looked_up, small_batches
from loanlens.llm.components import components
from loanlens.llm.shingles import differing, folded, mixed, set_ids, shingle_sets, sketches
from loanlens.session import settle

#: Sizes among which the boundary may lie.
LIGHT = range(0, 21)
#: Shingles that are ordered by their frequency; the order of others is their hash.
#: Any order gives the same result, so this only bounds what is broadcast.
FREQUENT = 100_000
PER_BATCH = 2_000
#: Sets in a run of a list whose pairs are written; a longer run is a task of its own.
RUN = 16
#: Sets that a run or list has at most to be compared in one task.
FAMILY = 4_000
#: What rows of pairs say besides the number of a run: ends of a block, ends of a link.
TOGETHER, LINKED = -1, -2
_PAIRS = 500_000
#: Shingles among which the frequent ones are looked for at once.
_COUNTED = 500_000
#: Shingles of all sets in one task.
TASK = 1_000_000
_SEEN = 500_000


def overlap(a: int, b: int) -> int:
    """Smallest intersection with which sets of these sizes link."""
    return -(-4 * (a + b) // 9)


def partners(n: int) -> range:
    return range(-(-4 * n // 5), 5 * n // 4 + 1)


def prefix(n):
    return n - (4 * n + 4) // 5 + 1


def subset_sizes(n: int) -> list[tuple[int, int, int]]:
    """Smaller size, larger size, subset size for each partner of a set of size n."""
    return [(min(n, m), max(n, m), overlap(n, m)) for m in partners(n) if m]


def boundary(histogram: dict[int, int]) -> int:
    """Largest light size: the least rows that light sets list and heavy ones post, and shingles
    that heavy ones scan."""

    def cost(light: int) -> int:
        low = -(-4 * (light + 1) // 5)
        listed = sum(c * sum(comb(n, o) for _, _, o in subset_sizes(n)) for n, c in histogram.items() if 0 < n <= light)
        # A heavy set's prefix is posted, its shingles go into a sketch and are scanned in a block.
        return listed + sum(c * (prefix(n) + 2 * n) for n, c in histogram.items() if n >= low)

    return min(LIGHT, key=lambda light: (cost(light), light))


# ---- in tasks ----


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document; and the shingles most frequent in each batch."""
    for batch in batches:
        ids, text = batch.column(0), batch.column(1)
        sizes, names, parities, held, waiting = [], [], [], [], 0
        for _, hashes, size in shingle_sets(text):
            sizes.append(size)
            names.append(set_ids(hashes, size))
            parities += sketches(hashes, size)
            held.append(hashes)
            waiting += len(hashes)
            if waiting > _COUNTED:
                yield _most(held)
                held, waiting = [], 0
        if sizes:
            yield _rows(ids, np.concatenate(names).view(np.int64), np.concatenate(sizes), parities)
            yield _most(held)


def _most(hashes: list[np.ndarray]) -> pa.RecordBatch:
    values, counts = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]), return_counts=True)
    top = np.argsort(-counts, kind="stable")[:PER_BATCH]
    top = top[counts[top] > 2]
    return _rows(pa.nulls(len(top), pa.int64()), values[top].view(np.int64), counts[top], [None] * len(top))


def _rows(ids, key, n, sketch) -> pa.RecordBatch:
    columns = [ids.cast(pa.int64()), pa.array(key), pa.array(n, pa.int64()), pa.array(sketch, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n", "sketch"])


def _family(table: pa.Table) -> pa.Table:
    """A forest of the pairs of one long run that their sketches do not refute."""
    n = table["n"].to_numpy()
    order = np.argsort(n, kind="stable")
    n, name = n[order], table["name"].to_numpy()[order]
    data = table["sketch"].combine_chunks().take(pa.array(order)).to_pylist()
    width = np.array([len(x) // 8 for x in data])
    # Widths grow with the size, so those of one width are neighbours; the next width is
    # folded to it where both can link.
    own = {w: np.frombuffer(b"".join(data[i] for i in np.flatnonzero(width == w)), np.uint64).reshape(-1, w) for w in np.unique(width).tolist()}
    folded_to = {w // 2: x[:, : w // 2] ^ x[:, w // 2 :] for w, x in own.items() if w > 1}
    first = {w: int(np.searchsorted(width, w)) for w in [*own, *(2 * w for w in own)]}
    label, edges = np.arange(len(n)), []
    until = np.searchsorted(n, n * 5 // 4, side="right")
    for i in range(len(n)):
        w, end = int(width[i]), int(until[i])
        sketch = own[w][i - first[w]]
        for begin, stop, rows, base in (
            (i + 1, min(end, first[2 * w]), own[w], first[w]),
            (first[2 * w], end, folded_to.get(w), first[2 * w]),
        ):
            if begin >= stop:
                continue
            other = begin + np.flatnonzero(label[begin:stop] != label[i])
            unlike = np.bitwise_count(rows[other - base] ^ sketch).sum(1, dtype=np.int64)
            both = n[i] + n[other]
            near = other[unlike <= both - 2 * -(-4 * both // 9)]
            if len(near):
                _, one = np.unique(label[near], return_index=True)
                edges += [(name[i], name[j]) for j in near[one]]
                label[np.isin(label, label[near])] = label[i]
    a, b = (np.array(x, np.int64) for x in (zip(*edges) if edges else ([], [])))
    return pa.table({"a": a, "b": b})


def _posting(frequent: np.ndarray, rank: np.ndarray, light: int, hot: np.ndarray, proven: bool):
    """Signatures of light sets, and first shingles of heavy ones, as rows of key, name and n.

    n is the size of a heavy set; 0 on a hot list; for signatures, which prove a link, -2 for
    the smaller of the two sizes and -1 for the larger.
    """
    heavy_from = -(-4 * (light + 1) // 5)

    def signatures(own: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
        out, kinds = [], []
        for a, b, o in subset_sizes(len(own)):
            chosen = np.array(list(combinations(range(len(own)), o)))
            head = np.tile(np.array([a, b], dtype=np.uint64), (len(chosen), 1))
            out.append(folded(np.concatenate([head, own[chosen]], axis=1)))
            kinds += [(-2 if len(own) == a else -1) if proven else len(own)] * len(chosen)
        return out, kinds

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, names, kinds = [], [], []
            for _, hashes, sizes in shingle_sets(batch.column(0)):
                where = np.minimum(np.searchsorted(frequent, hashes), max(len(frequent) - 1, 0))
                often = frequent[where] == hashes if len(frequent) else np.zeros(len(hashes), bool)
                ends = np.cumsum(sizes)
                some = np.diff(np.append(0, np.cumsum(often)[ends - 1] * (ends > 0))) if len(hashes) else sizes * 0
                for name, begin, n, any_often in zip(
                    set_ids(hashes, sizes).view(np.int64).tolist(), (ends - sizes).tolist(), sizes.tolist(), some.tolist()
                ):
                    if not n or name in seen:
                        continue
                    seen.add(name)
                    own, got, kind = hashes[begin : begin + n], [], []
                    if n <= light:
                        got, kind = signatures(own)
                    if n >= heavy_from:
                        if any_often:
                            late = often[begin : begin + n]
                            last = own[late][np.lexsort((own[late], rank[where[begin : begin + n]][late]))]
                            own = np.concatenate([own[~late], last])
                        own = own[: prefix(n)]
                        got = [*got, own]
                        kind = [*kind, *np.where(np.isin(own, hot), 0, n).tolist()] if any_often and len(hot) else [*kind, *[n] * len(own)]
                    keys += got
                    kinds += kind
                    names.append((name, len(kind)))
            if len(seen) > _SEEN:
                seen.clear()  # a class may be posted twice, which changes nothing
            if keys:
                name, times = np.array(names, dtype=np.int64).T
                columns = [np.concatenate(keys).view(np.int64), np.repeat(name, times), np.array(kinds, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "name", "n"])

    return posted


def _edges(key: np.ndarray, name: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of short runs, and rows of name, size or other end, and kind for the rest, of
    lists sorted by key, size and name."""
    fresh = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]))
    key, name, n = key[fresh], name[fresh], n[fresh]
    other = []
    # Hot lists: all hang on the list. Signatures: all are linked to one of the smaller size.
    hub = n == 0
    other.append(np.column_stack([name[hub], mixed(key[hub].view(np.uint64)).view(np.int64), np.full(hub.sum(), TOGETHER)]))
    signed = n < 0
    if signed.any():
        k, m, kind = key[signed], name[signed], n[signed]
        begin = np.append(True, k[1:] != k[:-1])
        first = np.maximum.accumulate(np.where(begin, np.arange(len(k)), 0))
        tied = ~begin & (kind[first] == -2)
        other.append(np.column_stack([m[first[tied]], m[tied], np.full(tied.sum(), LINKED)]))
    key, name, n = key[n > 0], name[n > 0], n[n > 0]
    if not len(key):
        return np.zeros((0, 2), np.int64), np.concatenate(other)
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (n[:-1] * 5 < n[1:] * 4)))
    length = np.diff(np.append(first, len(key)))
    run = np.repeat(np.arange(len(first)), length)
    known = mixed((key[first[run]] ^ name[first[run]]).view(np.uint64)).view(np.int64)
    long = np.flatnonzero((length[run] > RUN) & (length[run] <= FAMILY))
    other.append(np.column_stack([name[long], n[long], known[long]]))
    wide = np.flatnonzero(length[run] > FAMILY)
    other.append(np.column_stack([name[wide], known[wide], np.full(len(wide), TOGETHER)]))
    pairs, left = [], np.flatnonzero((length[run] <= RUN) & (length[run] > 1))
    for step in range(1, RUN):
        left = left[left + step < len(run)]
        left = left[run[left] == run[left + step]]
        left = left[n[left] * 5 >= n[left + step] * 4]  # so do those nearer
        if not len(left):
            break
        pairs.append(np.column_stack([name[left], name[left + step]]))
    pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    return np.sort(pairs, axis=1), np.concatenate(other)


def _distinct(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort(pairs.T)]
    return pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(1))] if len(pairs) else pairs


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of this task's lists, which arrive in order; and rows of name, size
    and run for members of long runs."""
    held: list[np.ndarray] = []  # the list whose end has not come
    pairs, members, waiting = [], [], 0

    def emitted() -> Iterator[pa.RecordBatch]:
        if pairs:
            rows = _distinct(np.concatenate(pairs))
            columns = [pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.nulls(len(rows), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "run"])
        for rows in members:
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], names=["a", "b", "run"])
        pairs.clear()
        members.clear()

    def take(rows: np.ndarray) -> int:
        new, long = _edges(*rows)
        pairs.append(_distinct(new))
        members.append(long)
        return len(pairs[-1]) + len(long)

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy() for i in range(3)])
        if not rows.shape[1]:
            continue
        last = int(np.searchsorted(rows[0], rows[0, -1]))
        if held and (last or rows[0, 0] != held[-1][0, -1]):
            # Lists before the last one of this batch are whole.
            waiting += take(np.concatenate([*held, rows[:, :last]], axis=1))
            held = []
        elif not held and last:
            waiting += take(rows[:, :last])
        held.append(rows[:, last:])
        if waiting > _PAIRS:
            yield from emitted()
            waiting = 0
    if held:
        take(np.concatenate(held, axis=1))
    yield from emitted()


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their sketches do not refute."""
    for batch in batches:
        a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
        keep = [i for i in range(len(a)) if differing(x[i], y[i]) <= n[i] + m[i] - 2 * overlap(n[i], m[i])]
        columns = [pa.array([c[i] for i in keep], pa.int64()) for c in (a, b)]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def _counted(table: pa.Table) -> pa.Table:
    """Counts all intersections of the sets of one task by scanning inverted lists.

    Sets of the same side are compared only if the task has one side. Returns for each
    set the smallest name that it reaches here and its number of linked documents.
    """
    hashes, sizes = [], []
    for _, h, s in shingle_sets(table.column("text").combine_chunks()):
        hashes.append(h)
        sizes.append(s)
    hashes, sizes = np.concatenate(hashes), np.concatenate(sizes)
    name = table.column("name").to_numpy()
    real = set_ids(hashes, sizes).view(np.int64) == name  # not another text of the same doc_id
    side, copies, block = (table.column(c).to_numpy() for c in ("side", "copies", "block"))
    crossed = len(np.unique(side)) > 1 or bool((table.column("crossed").to_numpy()).any())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    begins = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(begins, len(hashes)))
    lists = owner[order]
    # For each posting, where its list begins and how long it is; then back in set order.
    number = np.empty(len(hashes), np.int64)
    number[order] = np.repeat(np.arange(len(begins)), lengths)
    label, links = np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
    ends = np.cumsum(sizes)
    for row in np.flatnonzero(real):
        own = number[ends[row] - sizes[row] : ends[row]]
        own = own[lengths[own] > 1]
        if not len(own):
            continue
        count = lengths[own]
        steps = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        shared = np.bincount(lists[np.repeat(begins[own], count) + steps], minlength=len(sizes))
        linked = real & (block == block[row]) & (100 * shared >= 80 * (sizes + sizes[row] - shared))
        linked[row] = False
        if crossed:
            linked &= side != side[row]
        links[row] = copies[linked].sum()
        joined = np.unique(label[linked])
        joined = joined[joined != label[row]]
        if len(joined):
            label[np.isin(label, joined)] = label[row]
    root = np.full(len(sizes), np.iinfo(np.int64).max)
    np.minimum.at(root, label, name)
    return pa.table(
        {"name": name[real], "root": root[label][real], "links": links[real]},
    )


def _joined(table: pa.Table) -> pa.Table:
    """Joins the sets of one task that link, block by block, and names of sets with the
    smallest that each reaches here.

    Scans the inverted lists of one asking set at a time, and of no set that is in the
    largest component so far: its links to what lies outside are found from there. Sets
    of one ``known`` component are joined beforehand.
    """
    hashes, sizes = [], []
    for _, h, s in shingle_sets(table.column("text").combine_chunks()):
        hashes.append(h)
        sizes.append(s)
    hashes, sizes = np.concatenate(hashes), np.concatenate(sizes)
    name, block, known, ask = (table.column(c).to_numpy() for c in ("name", "block", "known", "ask"))
    real = set_ids(hashes, sizes).view(np.int64) == name  # not another text of the same doc_id
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(hashes, kind="stable")
    begins = np.flatnonzero(np.append(True, hashes[order][1:] != hashes[order][:-1])) if len(hashes) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(begins, len(hashes)))
    lists = owner[order]
    number = np.empty(len(hashes), np.int64)
    number[order] = np.repeat(np.arange(len(begins)), lengths)
    ends = np.cumsum(sizes)

    def linked_with(row: int) -> np.ndarray:
        own = number[ends[row] - sizes[row] : ends[row]]
        own = own[lengths[own] > 1]
        if not len(own):
            return np.zeros(0, np.int64)
        count = lengths[own]
        steps = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        shared = np.bincount(lists[np.repeat(begins[own], count) + steps], minlength=len(sizes))
        return np.flatnonzero(real & (block == block[row]) & (100 * shared >= 80 * (sizes + sizes[row] - shared)))

    _, label = np.unique(known, return_inverse=True)
    # Rows of one name and one known component are joined from the beginning.
    label = label.astype(np.int64)
    for one in np.unique(block):
        mine = np.flatnonzero(real & (block == one))
        waiting = ask[mine].copy()
        while True:
            inside = label[mine]
            values, times = np.unique(inside, return_counts=True)
            if len(values) < 2:
                break
            left = np.flatnonzero(waiting & ((inside != values[np.argmax(times)]) if times.max() > 1 else True))
            if not len(left):
                break
            waiting[left[0]] = False
            row = mine[left[0]]
            joined = np.unique(label[linked_with(row)])
            hit = np.isin(label[mine], joined)
            label[mine[hit]] = label[row]
    root = np.full(int(label.max()) + 1 if len(label) else 0, np.iinfo(np.int64).max)
    np.minimum.at(root, label[real], name[real])
    return pa.table({"name": name[real], "root": root[label[real]]})


# ---- the plan ----


def similarity_classes(df: DataFrame, *, key: str = "doc_id", text: str = "text", links: bool = False) -> DataFrame:
    """One row per document: key, n_shingles and component_id (smallest key it reaches through
    links); with ``links`` also n_links (documents it links with, equal ones included).

    Null and empty texts have an empty set and reach themselves only. Rows with a null key
    have no component and link with nothing. Repeated rows of one key link like copies.
    Other columns are not read; an empty table gives no rows.
    """
    with small_batches(df.sparkSession):
        return _similarity_classes(df, key, text, links)


def _similarity_classes(df: DataFrame, key: str, text: str, links: bool) -> DataFrame:
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sized = settle(docs.mapInArrow(_sized, "doc_id bigint, key bigint, n bigint, sketch binary"))
    sets = sized.where(F.col("sketch").isNotNull()).select("doc_id", F.col("key").alias("name"), "n", "sketch")
    linkable = sets.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))

    small = sets.where(F.col("n") <= 5 * max(LIGHT)).groupBy("n").count().collect()
    light = boundary({r["n"]: r["count"] for r in small})
    often = (
        sized.where(F.col("sketch").isNull())
        .groupBy("key")
        .agg(F.sum("n").alias("df"))
        .orderBy(F.desc("df"), "key")
        .limit(FREQUENT)
        .collect()
    )
    ranked = sorted((r["key"] % 2**64, r["df"]) for r in often)
    frequent = np.array([k for k, _ in ranked], dtype=np.uint64)
    rank = np.array([n for _, n in ranked], dtype=np.int64)
    hot = frequent[rank > FAMILY]

    postings = docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(
        _posting(frequent, rank, light, hot, not links), "key bigint, name bigint, n bigint"
    )
    # A hot list is dealt to many tasks, as each of its rows stands for itself.
    salt = F.when(F.col("n") == 0, F.pmod("name", F.lit(1024))).otherwise(0)
    postings = postings.withColumn("salt", salt)
    listed = Window.partitionBy("key", "salt").orderBy("n", "name")
    less, more = F.lag("n").over(listed), F.lead("n").over(listed)
    near_sizes = (less * 5 >= F.col("n") * 4) | (F.col("n") * 5 >= more * 4)  # most have a list of their own
    beside = F.when(F.col("n") > 0, near_sizes).otherwise((F.col("n") == 0) | less.isNotNull() | more.isNotNull())
    paired = settle(
        postings.withColumn("beside", beside)
        .where("beside")
        .select("key", "salt", "n", "name")
        .sortWithinPartitions("key", "salt", "n", "name")
        .select("key", "name", "n")
        .mapInArrow(_paired, "a bigint, b bigint, run bigint")
    )
    classes = settle(
        linkable.groupBy("name").agg(
            F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
        )
    )

    def side(key: str, n: str, sketch: str) -> DataFrame:
        return classes.select(F.col("name").alias(key), F.col("n").alias(n), F.col("sketch").alias(sketch))

    near = (
        paired.where(F.col("run").isNull())
        .select("a", "b")
        .distinct()
        .join(side("a", "n", "x"), "a")
        .join(side("b", "m", "y"), "b")
        .select("a", "b", "n", "m", "x", "y")
        .mapInArrow(_near, "a bigint, b bigint")
    )
    # Only members of long runs travel with their sketch to the task of the run.
    families = (
        paired.where(~F.col("run").isin(TOGETHER, LINKED))
        .select("a", "run")
        .join(side("a", "n", "sketch"), "a")
        .select("run", F.col("a").alias("name"), "n", "sketch")
        .groupBy("run")
        .applyInArrow(_family, "a bigint, b bigint")
    )
    together = paired.where(F.col("run") == TOGETHER).select("a", "b")
    proven = paired.where(F.col("run") == LINKED).select("a", "b")
    # Written in between, so that a task has one Python worker at a time.
    blocks = components(settle(near.union(families).union(together)))
    candidates = settle(
        classes.join(blocks, F.col("name") == F.col("node")).select("name", "rep", "copies", "n", F.col("component").alias("block"))
    )
    if links:
        joined, _ = _all_links(docs, candidates)
        joined = settle(joined)
    else:
        joined = _verified(docs, candidates)
    reached = components(joined.where("name != root").select(F.col("name").alias("a"), F.col("root").alias("b")).union(proven))
    grouped = classes.join(reached.select(F.col("node").alias("name"), "component"), "name", "left").withColumn(
        "component", F.coalesce("component", "name")
    )
    if links:
        grouped = grouped.join(joined.groupBy("name").agg(F.sum("links").alias("links")), "name", "left")
    first = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    counted = [(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")] if links else []
    grouped = grouped.join(first, "component").select("name", "component_id", *counted)
    names = [F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id", *(["n_links"] if links else [])]
    out = linkable.join(grouped, "name").select(*names)
    alone = sets.where(F.col("doc_id").isNull() | (F.col("n") == 0)).withColumns(
        {"component_id": F.col("doc_id"), "n_links": F.lit(0).cast("bigint")}
    )
    return out.union(alone.select(*names))


def _verified(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(name, root): which sets of a block link, as ends of a forest. Written."""
    half = TASK // 2
    volume = candidates.groupBy("block").agg(F.sum("n").alias("volume"), F.min("name").alias("pivot"))
    total = volume.agg(F.sum("volume"), F.max("volume")).first()
    bins = max(1, -(-(total[0] or 0) // (half // 2)))
    placed = candidates.join(volume, "block").withColumn("parts", F.ceil(F.col("volume") / F.lit(half)).cast("bigint"))
    small = F.col("volume") <= half // 2
    part = F.pmod(F.xxhash64("name"), F.col("parts"))
    # Each part of a large block gets the block's pivot, which joins most of a family.
    every = F.when(F.col("name") == F.col("pivot"), F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).otherwise(F.array(part))
    placed = placed.select(
        "name", "rep", "block", "n", "parts", small.alias("small"), part.alias("part"), F.explode(every).alias("task"),
        F.when(small, F.pmod(F.xxhash64("block"), F.lit(bins))).otherwise(F.col("block")).alias("bin"),
        F.col("name").alias("known"), F.lit(True).alias("ask"),
    )
    joined = settle(_met(docs, placed))
    if (total[1] or 0) <= half:
        return joined
    # Of blocks in parts, the sets outside the largest component meet all other parts.
    reached = components(joined.where("name != root").select(F.col("name").alias("a"), F.col("root").alias("b")))
    whole = settle(
        placed.where("parts > 1")
        .select("name", "rep", "block", "n", "parts", "part")
        .distinct()
        .join(reached.select(F.col("node").alias("name"), "component"), "name", "left")
        .withColumn("known", F.coalesce("component", "name"))
    )
    sizes = whole.groupBy("block", "known").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("block").agg(F.max(F.struct("size", "known")).alias("most")).select("block", F.col("most.known").alias("largest"))
    rest = settle(whole.join(largest, "block").where("known != largest").drop("largest", "component"))
    turns = rest.groupBy("block").agg(F.ceil(F.sum("n") / F.lit(half)).cast("bigint").alias("turns"))
    turn = F.pmod(F.xxhash64("name", F.lit(1)), F.col("turns"))
    asking = rest.join(turns, "block").withColumn("turn", turn).withColumn("to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    asked = whole.join(turns, "block").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("turns") - 1)))
    columns = ["name", "rep", "block", F.lit(False).alias("small"), "known", F.col("block").alias("bin")]
    task = lambda to: (F.col(to) * F.col("turns") + F.col("turn")).alias("task")
    both = asking.select(*columns, task("to"), F.lit(True).alias("ask")).union(asked.select(*columns, task("part"), F.lit(False).alias("ask")))
    return joined.union(settle(_met(docs, both.groupBy("name", "rep", "block", "small", "known", "bin", "task").agg(F.max("ask").alias("ask")))))


def _met(docs: DataFrame, placed: DataFrame) -> DataFrame:
    placed = placed.select(F.col("rep").alias("doc_id"), "name", "block", "bin", "small", "task", "known", "ask")
    found = docs.join(looked_up(placed), "doc_id").dropDuplicates(["bin", "small", "task", "name", "text"])
    return found.groupBy("bin", "small", "task").applyInArrow(_joined, "name bigint, root bigint")


def _all_links(docs: DataFrame, candidates: DataFrame) -> tuple[DataFrame, bool]:
    """Links inside blocks (name, root, links), and whether a block was cut in parts."""
    volume = candidates.groupBy("block").agg(F.sum("n").alias("volume"))
    half = TASK // 2
    total = volume.agg(F.sum("volume"), F.count(F.lit(1)), F.max("volume")).first()
    bins = max(1, -(-(total[0] or 0) // (half // 2)))
    parts = F.ceil(F.col("volume") / F.lit(half)).cast("bigint")
    placed = candidates.join(volume, "block").withColumn("parts", parts)
    part = F.pmod(F.xxhash64("name"), F.col("parts"))
    # A large block is cut in parts; each pair of parts is a task, so a part goes to all.
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    small = F.col("volume") <= half // 2
    placed = (
        placed.withColumn("part", part)
        .withColumn("other", other)
        .select(
            "name",
            "rep",
            "copies",
            "block",
            F.when(small, F.pmod(F.xxhash64("block"), F.lit(bins))).otherwise(F.col("block")).alias("bin"),
            small.alias("small"),
            F.least("part", "other").alias("low"),
            F.greatest("part", "other").alias("high"),
            F.col("part").alias("side"),
        )
        .withColumn("crossed", F.col("low") != F.col("high"))
    )
    found = docs.join(looked_up(placed.withColumnRenamed("rep", "doc_id")), "doc_id").dropDuplicates(["bin", "small", "low", "high", "name", "text"])
    linked = found.groupBy("bin", "small", "low", "high").applyInArrow(
        _counted, "name bigint, root bigint, links bigint"
    )
    return linked, (total[2] or 0) > half
