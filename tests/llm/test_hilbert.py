import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.llm import hilbert
from loanlens.llm.queries import QUERIES


@pytest.mark.parametrize("axes, bits", [(1, 4), (2, 3), (3, 1), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(axes, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * axes)).reshape(axes, -1)
    place = hilbert.curve_places(cells, bits)
    assert sorted(place) == list(range(cells.shape[1]))
    along = cells[:, np.argsort(place)]
    assert (np.abs(np.diff(along)).sum(0) == 1).all()


def test_query_against_the_documents(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op2_hilbert_shards"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        data = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data)) and r.grown_shard is None
    check_law(rows, 24)
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def check_law(rows, shards):
    sizes = [sum(r.shard == s for r in rows) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def shards_of(df, n=3):
    dims = {"source": F.col("source"), "n": F.col("n_chars"), "offset": F.col("offset")}
    return hilbert.hilbert_shards(df, dims, [F.col("doc_id"), F.col("text")], order=["doc_id", "text"], shards=n)


def test_edges(frame):
    assert shards_of(frame([])).collect() == []
    rows = [(1, None), (2, ""), (3, "y" * 200_000), (4, "a"), (4, "a"), (None, "b"), *[(i, "same") for i in range(5, 25)]]
    for source in ("s", None):
        got = shards_of(frame(rows, source=source)).collect()
        assert len(got) == len(rows)
        check_law(got, 3)


def test_ranges_cover_their_rows(frame):
    got = shards_of(frame([(i, "x" * i) for i in range(60)])).withColumn("n", F.length("text"))
    ranges = {r.shard: r for r in hilbert.shard_ranges(got, ["n"]).collect()}
    assert all(ranges[r.shard].min_n <= r.n <= ranges[r.shard].max_n for r in got.collect())
    assert sum(r.rows for r in ranges.values()) == 60


def test_levels_are_ranks_and_the_curve_follows_from_them(spark):
    """Texts that begin alike have levels of their own; many texts share levels evenly."""
    names = ["crawl-2023-06", "crawl-2024-10", "wikipedia", None]
    rows = [(i, names[i % 4], f"u{i * 7919 % 1000:04d}", float(i % 9) if i % 5 else float("nan")) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, source string, url string, x double")
    dims = {c: F.col(c) for c in ("source", "url", "x")}
    got = {r.id: r for r in hilbert.quantised(df.repartition(5), dims, 4).collect()}
    for i, source, url, x in rows:
        assert got[i]._x0 == (0 if source is None else 1 + names.index(source))
        assert got[i]._x2 == 0 if x != x else got[i]._x2 >= 1
    by_url = [got[i]._x1 for i, *_ in sorted(rows, key=lambda r: r[2])]
    assert by_url == sorted(by_url) and set(by_url) == set(range(1, 16))
    assert max(by_url.count(k) for k in range(1, 16)) <= 68
    by_x = [got[i]._x2 for i, _, _, x in sorted((r for r in rows if r[3] == r[3]), key=lambda r: r[3])]
    assert by_x == sorted(by_x) and len(set(by_x)) == 9
    curve = hilbert.curve_places(np.array([[r._x0, r._x1, r._x2] for r in got.values()]).T, 4)
    found = hilbert.hilbert_shards(df, dims, [F.col("id")], order=["id"], shards=5, bits=4)
    assert {r.id: r.curve for r in found.collect()} == dict(zip(got, curve.tolist()))


def test_predicates_read_few_shards(spark):
    names = ["crawl-2023-06", "crawl-2024-10", "crawl-2024-11", "wikipedia"]
    rows = [(i, names[i * 31 % 97 % 4], float(i * 7919 % 4096)) for i in range(4096)]
    df = spark.createDataFrame(rows, "id long, source string, size double")
    dims = {"source": F.col("source"), "size": F.col("size")}
    got = hilbert.hilbert_shards(df, dims, [F.col("id"), F.col("source"), F.col("size")], order=["id"], shards=64)
    ranges = hilbert.shard_ranges(got, ["source", "size"])
    for name in names:
        assert ranges.where((F.col("min_source") <= name) & (F.col("max_source") >= name)).count() <= 40
    assert ranges.where("min_size <= 500 AND max_size >= 0").count() <= 24
    assert ranges.where("min_size <= 500 AND max_size >= 0 AND min_source <= 'wikipedia' AND max_source >= 'wikipedia'").count() <= 14
