"""Nearest neighbours by vantage-point trees, one per shard.

A small tree over a bounded sample routes every vector to a shard of near ones. A shard with
too many gets a tree of its own, over a bounded sample of its own rows, and so on, so that
shards stay as small as they are however many rows there are. A query
first searches the shard it would belong to; the k-th distance found there bounds the
answer, and the query goes on to the shards that the triangle inequality cannot rule
out with it. Inside a shard a tree of its own is searched in the same way.

A branch is visited if its lower bound is at most ``factor`` times the current k-th
distance. Factor 1 is exact; smaller ones prune more and may miss neighbours.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.common import hash_slice, looked_up
from loanlens.session import settle

#: Vectors on which the routing tree is fitted, about.
SAMPLE = 20_000
SHARD_ROWS = 4_096
#: Vectors of an oversized shard on which its own tree is fitted, about.
SHARD_SAMPLE = 2_000
#: Bytes of trees that are broadcast at once; more are used in turns.
TREES = 64 << 20
#: Queries that meet one copy of a shard.
QUERY_ROWS = 20_000
LEAF = 64


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, summed from the first dimension to the last in double precision."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        step = a[:, i, None].astype(np.float64) - b[None, :, i]
        total += step * step
    return np.sqrt(total)


@dataclass
class Node:
    """A vantage point, the radius that parts its two sides, and the rows of a leaf."""

    point: np.ndarray | None = None
    radius: float = 0.0
    inner: Node | None = None
    outer: Node | None = None
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    leaf: int = 0


def grown(vectors: np.ndarray, rows: np.ndarray, leaf_rows: int, leaves: list[Node]) -> Node:
    """The vantage point is the row farthest from the first one; the median distance parts."""
    if len(rows) > leaf_rows:
        start = distances(vectors[rows[:1]], vectors[rows])[0]
        point = vectors[rows[start.argmax()]]
        d = distances(point[None], vectors[rows])[0]
        radius = float(np.median(d))
        near = d <= radius
        if not near.all():
            return Node(
                point,
                radius,
                grown(vectors, rows[near], leaf_rows, leaves),
                grown(vectors, rows[~near], leaf_rows, leaves),
            )
    leaves.append(Node(rows=rows, leaf=len(leaves)))
    return leaves[-1]


class Search:
    """Batched search of many queries in one tree; keeps the k nearest by distance and id."""

    def __init__(self, vectors, ids, queries, query_ids, k: int, factor: float):
        self.vectors, self.ids, self.queries, self.query_ids, self.factor = vectors, ids, queries, query_ids, factor
        self.far = np.full((len(queries), k), np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)

    def look(self, q: np.ndarray, rows: np.ndarray) -> None:
        k = self.far.shape[1]
        d = distances(self.queries[q], self.vectors[rows])
        d[self.query_ids[q][:, None] == self.ids[rows][None]] = np.inf
        far = np.concatenate([self.far[q], d], axis=1)
        ids = np.concatenate([self.found[q], np.broadcast_to(self.ids[rows], d.shape)], axis=1)
        order = np.lexsort((ids, far), axis=1)[:, :k]
        self.far[q] = np.take_along_axis(far, order, 1)
        self.found[q] = np.take_along_axis(ids, order, 1)

    def visit(self, node: Node, q: np.ndarray) -> None:
        if not len(q):
            return
        if node.point is None:
            self.look(q, node.rows)
            return
        d = distances(self.queries[q], node.point[None])[:, 0]
        inside = d <= node.radius
        self.visit(node.inner, q[inside])
        self.visit(node.outer, q[~inside])
        reach = self.factor * self.far[q, -1] * (1 + 1e-12)  # rounding must not prune
        self.visit(node.outer, q[inside & (node.radius - d <= reach)])
        self.visit(node.inner, q[~inside & (d - node.radius <= reach)])


def home(node: Node, vectors: np.ndarray, q: np.ndarray, out: np.ndarray) -> None:
    if node.point is None:
        out[q] = node.leaf
    elif len(q):
        inside = distances(vectors[q], node.point[None])[:, 0] <= node.radius
        home(node.inner, vectors, q[inside], out)
        home(node.outer, vectors, q[~inside], out)


def reached(node: Node, vectors: np.ndarray, q: np.ndarray, reach: np.ndarray, out: list) -> None:
    """Leaves that each vector's reach cannot rule out."""
    if not len(q):
        return
    if node.point is None:
        out.append((q, np.full(len(q), node.leaf)))
        return
    d = distances(vectors[q], node.point[None])[:, 0]
    reached(node.inner, vectors, q[d - node.radius <= reach[q]], reach, out)
    reached(node.outer, vectors, q[node.radius - d <= reach[q]], reach, out)


class Level:
    """Trees of oversized shards, in blocks that are broadcast one by one: by shard the tree
    and the number of its first leaf."""

    def __init__(self, spark, trees: DataFrame, first: int):
        facts = trees.agg(F.sum(F.length("tree")), F.sum("leaves")).first()
        self.blocks, self.end = max(1, -(-(facts[0] or 0) // TREES)), first + (facts[1] or 0)
        # A row for each oversized shard: thousands of times fewer than there are vectors.
        before = Window.orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
        self.trees = settle(trees.withColumn("first", F.coalesce(F.sum("leaves").over(before), F.lit(0)) + first))
        self.spark = spark

    def __call__(self, rows: DataFrame, step) -> DataFrame:
        """The rows with their shard replaced, by a function of a tree, vectors and places in
        the batch that gives places and leaves. Rows of shards without a tree stay."""
        kind = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
        at = rows.columns.index("leaf")
        out = []
        for block in range(self.blocks):
            mine = F.pmod(F.xxhash64(F.col("leaf").cast("bigint")), F.lit(self.blocks)) == block
            found = {r["leaf"]: (pickle.loads(r["tree"]), r["first"]) for r in self.trees.where(mine).collect()}
            given = self.spark.sparkContext.broadcast(found)

            def moved(batches, given=given):
                for batch in batches:
                    own, leaf = matrix(batch.column(1), None), batch.column(at).to_numpy()
                    places, leaves = [], []
                    for old in np.unique(leaf).tolist():
                        q = np.flatnonzero(leaf == old)
                        if old in given.value:
                            tree, first = given.value[old]
                            q, new = step(tree, own, q, batch)
                            places, leaves = [*places, q], [*leaves, new + first]
                        else:
                            places, leaves = [*places, q], [*leaves, np.full(len(q), old)]
                    q = np.concatenate([np.zeros(0, np.int64), *places])
                    columns = [c.take(pa.array(q)) for c in batch.columns]
                    columns[at] = pa.array(np.concatenate([np.zeros(0, np.int64), *leaves]).astype(np.int64))
                    yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

            out.append(rows.where(mine).mapInArrow(moved, kind))
        return reduce(DataFrame.unionByName, out)


def to_home(tree: Node, own: np.ndarray, q: np.ndarray, batch) -> tuple[np.ndarray, np.ndarray]:
    leaf = np.zeros(len(own), np.int64)
    home(tree, own, q, leaf)
    return q, leaf[q]


def to_reached(factor: float):
    def step(tree: Node, own: np.ndarray, q: np.ndarray, batch) -> tuple[np.ndarray, np.ndarray]:
        reach, out = factor * batch.column(batch.schema.get_field_index("reach")).to_numpy() * (1 + 1e-12), []
        reached(tree, own, q, reach, out)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(x for x, _ in out)]), np.concatenate([none, *(x for _, x in out)])

    return step


def level_of(spark, placed: DataFrame, oversized: DataFrame, dim: int, first: int, number: int) -> Level | None:
    """Trees for the oversized shards (leaf, count); None where no shard can be parted."""

    def fitted(rows: pa.Table) -> pa.Table:
        vectors, leaves = matrix(rows["vector"], dim), []
        count = rows["count"][0].as_py()
        order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
        tree = grown(vectors[order], np.arange(len(vectors)), max(8, len(vectors) * SHARD_ROWS // count), leaves)
        return pa.table({"leaf": rows["leaf"].slice(0, 1), "tree": [pickle.dumps(tree)], "leaves": [len(leaves)]})

    spread = 1_000_000
    share = F.least(F.lit(spread), F.ceil(F.lit(SHARD_SAMPLE * spread) / F.col("count")))
    salted = F.concat(F.lit(f"{number}:"), F.col("vec_id").cast("string"))
    sample = placed.join(looked_up(oversized), "leaf").where(hash_slice(salted, spread) < share)
    trees = settle(sample.select("leaf", "vec_id", "vector", "count").groupBy("leaf").applyInArrow(fitted, "leaf bigint, tree binary, leaves bigint"))
    trees = trees.where("leaves > 1")
    return None if trees.isEmpty() else Level(spark, trees, first)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int | None) -> np.ndarray:
    """One row per vector, all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, len(flat) // max(len(column), 1) if dim is None else dim)


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def nearest(
    df: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, factor: float = 0.9
) -> DataFrame:
    """query_id, rank (from 1), key and score (the distance) of the ``k`` nearest rows found
    for each row of ``queries``, but not the row of its own key; all, if there are fewer.

    Ties go to the smaller key. Vectors that are not usable, and those of another length
    than the most frequent one (of equals the smallest), take no part, as do rows with a
    null key. Of equal vectors only the k + 1 smallest keys can be among the answers, and
    only they are searched. Other columns are not read; an empty table gives no rows.
    """
    spark = df.sparkSession

    def clean(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"))
        return rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))

    rows, asked = clean(df), clean(queries)
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = lengths["dim"] if lengths else 1
    rows, asked = (x.where(F.size("vector") == dim) for x in (rows, asked))
    copy = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    # The limit is applied before the shuffle, too, so that a hot vector is not gathered.
    rows = rows.distinct().withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy")

    total = rows.count()
    spread = 1_000_000
    share = min(spread, -(-SAMPLE * spread // max(total, 1)))
    sample = rows.where(hash_slice(F.col("vec_id"), spread) < share).orderBy("vec_id").limit(2 * SAMPLE).toArrow()
    vectors = matrix(sample["vector"], dim)
    leaves: list[Node] = []
    tree = grown(vectors, np.arange(len(vectors)), max(LEAF, len(vectors) * SHARD_ROWS // max(total, 1)), leaves)
    given = spark.sparkContext.broadcast(tree)

    def routed(batches):
        for batch in batches:
            own = matrix(batch.column(1), dim)
            leaf = np.zeros(len(own), np.int64)
            home(given.value, own, np.arange(len(own)), leaf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["vec_id", "vector", "leaf"])

    kind = dict(rows.dtypes)["vector"]
    kind_q = dict(asked.dtypes)["vector"]
    placed = settle(rows.mapInArrow(routed, f"vec_id bigint, vector {kind}, leaf bigint"))
    first = settle(asked.mapInArrow(routed, f"vec_id bigint, vector {kind_q}, leaf bigint"))

    levels: list[Level] = []
    end = len(leaves)
    sizes = settle(placed.groupBy("leaf").count())
    tried = None
    while True:
        over = sizes.where(F.col("count") > 2 * SHARD_ROWS)
        over = over if tried is None else over.join(F.broadcast(tried), "leaf", "left_anti")
        if over.isEmpty() or (level := level_of(spark, placed, over, dim, end, len(levels))) is None:
            break
        levels.append(level)
        end = level.end
        # Only the rows of oversized shards are written again.
        parted = looked_up(level.trees.select("leaf"))
        inside, outside = placed.join(parted, "leaf", "left_semi"), placed.join(parted, "leaf", "left_anti")
        columns = ["vec_id", "vector", "leaf"]
        placed = outside.select(columns).unionByName(settle(level(inside.select(columns), to_home)))
        first = settle(level(first, to_home))
        # What could not be parted once is not tried again.
        failed = over.select("leaf").join(parted, "leaf", "left_anti")
        tried = settle(failed if tried is None else tried.union(failed))
        sizes = settle(placed.groupBy("leaf").count())
    # A leaf of more rows than a shard that distances cannot part is cut by the hash of the key.

    def searched(asking: DataFrame) -> DataFrame:
        """The k nearest of each query in each shard that it asks."""
        crowd = asking.groupBy("leaf").agg(F.count(F.lit(1)).alias("asking"))
        # At most a row for each leaf of the routing tree.
        cut = sizes.join(crowd, "leaf").select(
            "leaf",
            F.ceil(F.col("count") / F.lit(2 * SHARD_ROWS)).cast("bigint").alias("parts"),
            F.ceil(F.col("asking") / F.lit(QUERY_ROWS)).cast("bigint").alias("blocks"),
        )
        cut = F.broadcast(cut)
        all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
        stored = placed.join(cut, "leaf").select(
            "leaf", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), all_of("blocks").alias("block"), "vec_id", "vector"
        )
        asks = asking.join(cut, "leaf").select(
            "leaf", all_of("parts").alias("part"), F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"), "vec_id", "vector"
        )

        def search(shard: pa.Table, asks: pa.Table) -> pa.Table:
            own, query = matrix(shard["vector"], dim), matrix(asks["vector"], dim)
            ids = asks["vec_id"].to_numpy()
            run = Search(own, shard["vec_id"].to_numpy(), query, ids, k, factor)
            if len(own) and len(query):
                run.visit(grown(own, np.arange(len(own)), LEAF, []), np.arange(len(query)))
            kept = np.isfinite(run.far)
            return pa.table({"query_id": np.broadcast_to(ids[:, None], kept.shape)[kept], "vec_id": run.found[kept], "score": run.far[kept]})

        by = ["leaf", "part", "block"]
        grouped = stored.groupBy(*by).cogroup(asks.groupBy(*by))
        return grouped.applyInArrow(search, "query_id bigint, vec_id bigint, score double")

    near = settle(searched(first))
    by_rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    kth = (
        near.withColumn("rank", F.row_number().over(by_rank))
        .where(F.col("rank") <= k)
        .groupBy("query_id")
        .agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).otherwise(float("inf")).alias("reach"))
    )

    def onward(batches):
        for batch in batches:
            own, out = matrix(batch.column(1), dim), []
            reach = factor * batch.column(3).to_numpy() * (1 + 1e-12)
            reached(given.value, own, np.arange(len(own)), reach, out)
            q = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
            leaf = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.int64)
            columns = [c.take(pa.array(q)) for c in batch.columns]
            columns = [columns[0], columns[1], pa.array(leaf), columns[2], columns[3]]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vector", "leaf", "home", "reach"])

    reach = F.coalesce("reach", F.lit(float("inf")))
    second = first.join(kth, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "vector", "leaf", reach.alias("reach"))
    second = second.mapInArrow(onward, f"vec_id bigint, vector {kind_q}, leaf bigint, home bigint, reach double")
    for level in levels:
        second = level(second, to_reached(factor))
    second = settle(second.where("leaf != home").select("vec_id", "vector", "leaf"))
    both = near.union(searched(second)).distinct()
    return (
        both.withColumn("rank", F.row_number().over(by_rank))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("vec_id").alias(key), "score")
    )

