"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.session import settle

#: Edges a task contracts at once, so that its memory has a bound.
EDGES = 200_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A star for each tree that the edges of this task make."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def stars() -> pa.RecordBatch:
        nodes = [x for x in parent if root(x) != x]
        columns = [pa.array(nodes, pa.int64()), pa.array([parent[x] for x in nodes], pa.int64())]
        parent.clear()
        return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        if len(parent) > EDGES:
            yield stars()
    yield stars()


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (columns a, b) with the same components, without a shuffle."""
    return edges.select("a", "b").mapInArrow(_contracted, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node and component (smallest node it reaches) of each end of ``edges`` (a, b).

    Each round joins every node with the smallest of its neighbours; what is left
    halves at least, and each round is a written table. Hubs are summed map-side and
    their joins are left to adaptive execution, which splits hot keys.
    """
    stars = settle(contracted(edges))
    before = None
    while True:
        both = stars.union(stars.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(low, "a")
            .select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
            .where("a != b")
            .distinct()
        )
        stars = settle(small)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    own = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return own.union(stars.select("a", "b"))
