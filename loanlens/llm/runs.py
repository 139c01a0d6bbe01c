"""Periodic runs of words, found by tiles that grow with the period.

Words at distance p are equal on a *match interval* of p: a run of length n has one of
n - p positions. Periods from P to 2P - 1, P a power of two, form an octave, whose tiles
begin at the multiples c of P, P words before c and 5P words after it, so that tiles
overlap. A run's match interval has at least 3P positions, so it holds 2P positions from
some c on. Hashes of 2P words, compared for all periods at once, tell the tiles and
periods where that may be; there two Z-functions at the boundary c, one of the words after
it and one of those before it reversed, give how far the match goes inside the tile.

The fragments of all tiles are dealt by document and period, and those that overlap are
stitched to whole match intervals. What is left is checked for its length, and of equal
stretches the smallest period counts. A document of more than ``LONG`` words gives its
tiles to many tasks.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.llm.common import small_batches
from loanlens.session import settle

#: Words beyond which the tiles of a document go to several tasks, and words of tiles per task.
LONG = 1 << 16
SPAN = 1 << 15
#: A run has this many periods and words at least.
TIMES, LEAST = 4, 6

_BASE = 0x9E3779B97F4A7C15
_FRAGMENT = pa.struct([("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_FRAGMENTS = "array<struct<period:bigint,start:bigint,end:bigint>>"


def words_of(text: str | None) -> list[bytes]:
    """Words: what lies between the six ASCII white-space characters."""
    return text.encode().split() if text else []


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def z_function(s: list[int]) -> list[int]:
    """How many items from each place on equal those at the beginning."""
    n = len(s)
    z, left, right = [n] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _boundary(ids: np.ndarray, c: int, octave: int, periods: list[int]) -> list[tuple[int, int, int]]:
    """Fragments of match intervals around c, inside its tile."""
    size = 1 << octave
    after = z_function(ids[c : c + 5 * size].tolist())
    left = ids[max(0, c - size) : c][::-1].tolist()
    end = min(len(ids), c + 2 * size - 1)
    before = z_function([*left, -1, *ids[c:end][::-1].tolist()])
    found = []
    for p in periods:
        back = before[len(left) + 1 + end - c - p] if left else 0
        found.append((p, c - back, c + after[p]))
    return found


def tile_fragments(ids: np.ndarray, octaves: range, longest: int, first: int = 0, last: int | None = None) -> list[tuple[int, int, int]]:
    """(period, start, end) of match intervals seen by tiles whose boundary is one of the
    places first, ..., last - 1 of ids; first is a multiple of the tile's distance or its
    ids begin that much before it. Overlapping fragments are one."""
    hashes = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
    hashes ^= hashes >> np.uint64(29)
    power, window, found = _BASE, 1, []
    for octave in octaves:
        size = 1 << octave
        if 3 * size > len(ids) or size > longest:
            break
        while window < 2 * size:
            hashes = hashes[:-window] * np.uint64(power) + hashes[window:]
            power, window = power * power % 2**64, 2 * window
        begun = first % size
        ours = hashes[begun:]
        # Each place lies one period of the octave after exactly one boundary.
        at = np.flatnonzero(ours[size:] == np.repeat(ours[::size], size)[: max(len(ours) - size, 0)]) + size
        cs = (at // size - 1) * size + begun
        ps = at + begun - cs
        keep = (ps <= longest) & (cs >= first) & (cs < (len(ids) if last is None else last))
        cs, ps = cs[keep], ps[keep]
        for part in np.split(np.arange(len(cs)), np.flatnonzero(np.diff(cs)) + 1) if len(cs) else []:
            found += _boundary(ids, int(cs[part[0]]), octave, ps[part].tolist())
    return joined(found)


def joined(fragments: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    merged: list[list[int]] = []
    for p, start, end in sorted(fragments):
        if merged and merged[-1][0] == p and start <= merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([p, start, end])
    return [tuple(m) for m in merged]


def least(period: int) -> int:
    """Positions that the match interval of a run has at least."""
    return max(LEAST, TIMES * period) - period


def whole_fragments(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Fragments of all tiles of one document, without those that are too short or whose
    stretch has a smaller period."""
    longest = len(ids) // TIMES
    stretches: dict[tuple[int, int], tuple[int, int, int]] = {}
    for p, start, end in tile_fragments(ids, range(longest.bit_length()), longest):
        if end - start >= least(p):
            stretches.setdefault((start, end + p), (p, start, end))
    return list(stretches.values())


def _solver(long: int):
    kind = pa.struct([("n", pa.int64()), ("words", pa.string()), ("fragments", pa.list_(_FRAGMENT))])

    @F.arrow_udf(f"struct<n:bigint,words:string,fragments:{_FRAGMENTS}>")
    def solve(texts: pa.Array) -> pa.Array:
        counts, all_words, all_found = [], [], []
        for text in texts:
            words = words_of(text.as_py())
            found = [] if len(words) > long else whole_fragments(numbered(words))
            counts.append(len(words))
            all_words.append(b" ".join(words).decode())
            all_found.append([{"period": p, "start": s, "end": e} for p, s, e in found])
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(all_words, pa.string()), pa.array(all_found, pa.list_(_FRAGMENT))], fields=list(kind)
        )

    return solve


def _spans(span: int):
    """Spans of tiles of one octave, with the words that they need."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch["_row"].to_pylist(), batch["_words"]):
                ids = numbered(words_of(text.as_py()))
                longest = len(ids) // TIMES
                for octave in range(longest.bit_length()):
                    size = 1 << octave
                    step = max(size, span)
                    for first in range(0, len(ids), step):
                        begin, end = max(0, first - size), min(len(ids), first + step + 5 * size)
                        buffer = io.BytesIO()
                        np.save(buffer, ids[begin:end])
                        yield pa.RecordBatch.from_pydict({
                            "_row": [row], "octave": [octave], "begin": [begin], "first": [first - begin],
                            "last": [first - begin + step], "longest": [longest], "ids": [buffer.getvalue()],
                        })

    return cut


def _solve_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.load(io.BytesIO(r["ids"]))
            octave = range(r["octave"], r["octave"] + 1)
            found = tile_fragments(ids, octave, r["longest"], r["first"], r["last"])
            ps, starts, ends = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_pydict({
                "_row": pa.array([r["_row"]] * len(found), pa.int64()), "period": pa.array(ps, pa.int64()),
                "start": pa.array([s + r["begin"] for s in starts], pa.int64()), "end": pa.array([e + r["begin"] for e in ends], pa.int64()),
            })


def spread_fragments(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Fragments of documents (_row, _words) whose tiles are dealt to many tasks."""
    cut = docs.mapInArrow(_spans(span), "_row bigint, octave bigint, begin bigint, first bigint, last bigint, longest bigint, ids binary")
    return cut.repartition("_row", "octave", "begin").mapInArrow(_solve_spans, "_row bigint, period bigint, start bigint, end bigint")


def stitched(fragments: DataFrame) -> DataFrame:
    """(_row, runs) from (_row, period, start, end): runs by start, then period."""
    inside = Window.partitionBy("_row", "period").orderBy("start", "end")
    before = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    island = F.sum("_new").over(inside)
    whole = (
        fragments.withColumn("_new", new)
        .withColumn("_island", island)
        .groupBy("_row", "period", "_island")
        .agg(F.min("start").alias("start"), (F.max("end") - F.min("start") + F.col("period")).alias("length"))
        .where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))
    )
    runs = whole.groupBy("_row", "start", "length").agg(F.min("period").alias("period"))
    listed = F.sort_array(F.collect_list(F.struct("start", "period", "length")))
    ordered = F.transform(listed, lambda r: F.struct(r.start.alias("start"), r.length.alias("length"), r.period.alias("period")))
    return runs.groupBy("_row").agg(ordered.alias("runs"))


@F.arrow_udf(T.StringType())
def _collapsed(words: pa.Array, runs: pa.Array) -> pa.Array:
    texts = []
    for text, found in zip(words, runs.to_pylist()):
        parts = words_of(text.as_py())
        kept = np.ones(len(parts), bool)
        for r in found or ():
            kept[r["start"] + r["period"] : r["start"] + r["length"]] = False
        texts.append(b" ".join(w for w, k in zip(parts, kept.tolist()) if k).decode())
    return pa.array(texts, pa.string())


def periodic_runs(
    docs: DataFrame, keep: dict[str, Callable[[Column], Column]] | None = None, text: str = "text", long: int = LONG, span: int = SPAN
) -> DataFrame:
    """Documents, without their text, with their runs and what is kept of the collapsed text.

    A run is a stretch of words with smallest period q and at least 4q and 6 words that no
    neighbouring word extends; ``runs`` lists (start, length, period) by start, then period,
    empty if there is none. The collapsed text has all words that no run holds after its
    first q words, joined by one space; ``keep`` gives the columns made from it (by default
    ``collapsed``, the text itself), so that what is not asked for is not written. Null
    and empty texts have no words. Repeated rows are each a document. Columns of docs
    with the names of results are replaced.
    """
    keep = keep or {"collapsed": lambda c: c}
    others = [c for c in docs.columns if c not in (text, "runs", *keep)]
    solved = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("_doc"), _solver(long)(F.col(text)).alias("_s"))
    periodic = (F.size("_s.fragments") > 0) | (F.col("_s.n") > long)
    with small_batches(docs.sparkSession):
        solved = settle(
            solved.select(
                F.monotonically_increasing_id().alias("_row"),
                "_doc",
                "_s.n",
                "_s.fragments",
                periodic.alias("_periodic"),
                F.when(periodic, F.col("_s.words")).alias("_words"),
                *[F.when(~periodic, f(F.col("_s.words"))).alias(f"_keep{i}") for i, f in enumerate(keep.values())],
            )
        )
        here = solved.where("_periodic").select("_row", F.explode("fragments").alias("f")).select("_row", "f.*")
        there = spread_fragments(solved.where(F.col("n") > long).select("_row", "_words"), span)
        runs = settle(stitched(here.unionByName(there)))
    kept = [F.col(f"_keep{i}").alias(name) for i, name in enumerate(keep)]
    empty = F.expr("CAST(array() AS array<struct<start:bigint,length:bigint,period:bigint>>)")
    fields = [F.col(f"_doc.`{c}`") for c in others]
    plain = solved.where("NOT _periodic").select(*fields, empty.alias("runs"), *kept)
    found = solved.where("_periodic").join(runs, "_row", "left").withColumn("runs", F.coalesce("runs", empty))
    found = found.withColumn("_collapsed", _collapsed("_words", "runs"))
    collapsed = [f(F.col("_collapsed")).alias(name) for name, f in keep.items()]
    return plain.unionByName(found.select(*fields, "runs", *collapsed))
