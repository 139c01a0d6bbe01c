"""URL filters: a sorted array of 64-bit digests, memory-mapped by every worker.

A list of rules (host, path, verdict) becomes two arrays: the hosts that have rules, with
the lengths of their rules' paths, and the rules themselves as host and path in one text.
Each array holds the xxhash64 digests of its texts in order, and beside them the texts and
a value per text. A batch of urls asks for all its keys by one vectorised binary search;
a digest that is found is confirmed by the stored text, so that collisions do no harm.

A list of up to ``SHIPPED`` bytes is one file in the shared folder, which Spark brings to
each executor once and whose pages all its workers share. A longer one is cut by digest
into parts; distinct keys are sent to their part, and no part goes through the driver.
"""

from __future__ import annotations

import mmap
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import unused
from loanlens.session import settle, work_dir

SEED = 42  # that of Spark's xxhash64
ALLOW, BLOCK = "allow", "block"
#: Bytes of keys and texts that are sent to every executor.
SHIPPED = 256 << 20
#: Texts in a part of a longer list, and keys that ask a part at once.
PART = 2_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digests(texts: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in texts), np.uint64, len(texts))


class DigestArray:
    """Digests in order with the texts and values that belong to them.

    Layout: number of texts, of bytes of texts and of bytes of values; digests; ends of
    texts; ends of values; texts; values.
    """

    def __init__(self, data: bytes | mmap.mmap, at: int = 0):
        self.count, texts, values = (int(x) for x in np.frombuffer(data, np.uint64, 3, at))
        n, at = self.count, at + 24
        self.keys = np.frombuffer(data, np.uint64, n, at)
        self.text_ends = np.frombuffer(data, np.uint64, n + 1, at + 8 * n)
        self.value_ends = np.frombuffer(data, np.uint64, n + 1, at + 16 * n + 8)
        self._data, self._texts = data, at + 24 * n + 16
        self._values = self._texts + texts
        self.end = self._values + values

    @staticmethod
    def pack(entries: list[tuple[bytes, bytes]], hashed=digests) -> bytes:
        """The bytes of an array; of equal texts the first entry counts."""
        entries = list(dict(reversed(entries)).items())
        keys = hashed([text for text, _ in entries])
        order = np.argsort(keys, kind="stable")
        columns = [[entries[i][side] for i in order] for side in (0, 1)]
        ends = [np.cumsum([0, *map(len, c)]).astype(np.uint64) for c in columns]
        head = np.array([len(entries), ends[0][-1], ends[1][-1]], np.uint64)
        body = b"".join(x.tobytes() for x in (head, keys[order], *ends)) + b"".join(map(b"".join, columns))
        return body + bytes(-len(body) % 8)

    def text(self, i: int) -> bytes:
        return self._data[self._texts + int(self.text_ends[i]) : self._texts + int(self.text_ends[i + 1])]

    def value(self, i: int) -> bytes:
        return self._data[self._values + int(self.value_ends[i]) : self._values + int(self.value_ends[i + 1])]

    def probe(self, texts: list[bytes], hashed=digests) -> np.ndarray:
        """Place of each text, -1 where the array does not hold it."""
        asked = hashed(texts)
        place = np.full(len(texts), -1, np.int64)
        at = np.searchsorted(self.keys, asked)
        for i in np.flatnonzero((at < self.count) & (self.keys[np.minimum(at, self.count - 1)] == asked) if self.count else []):
            j = int(at[i])
            while j < self.count and self.keys[j] == asked[i]:
                if self.text(j) == texts[i]:
                    place[i] = j
                    break
                j += 1
        return place


def mapped(data: bytes) -> mmap.mmap:
    """The bytes in pages of a file without a name, which the system can write out."""
    with tempfile.TemporaryFile() as file:
        file.write(data or bytes(8))
        file.flush()
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)


@lru_cache(maxsize=4)
def _opened(name: str) -> tuple[DigestArray, DigestArray]:
    """Hosts and rules of a file that Spark has brought to this executor."""
    with open(SparkFiles.get(name), "rb") as file:
        data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    hosts = DigestArray(data)
    return hosts, DigestArray(data, hosts.end + -hosts.end % 8)


def suffixes(host: bytes) -> list[bytes]:
    """The host and the domains that it is part of, longest first."""
    found = [host]
    while b"." in found[-1]:
        found.append(found[-1].split(b".", 1)[1])
    return found


def _best(hosts: DigestArray, rules: DigestArray, urls: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes] | None]:
    """Longest rule and its verdict for each (host, path), by two rounds of probes."""
    asked = list(dict.fromkeys(s for host in {h for h, _ in urls} for s in suffixes(host)))
    places = hosts.probe(asked)
    lengths = {s: np.frombuffer(hosts.value(p), np.uint32) for s, p in zip(asked, places) if p >= 0}
    keys, owners = [], []
    for i, (host, path) in enumerate(urls):
        for suffix in suffixes(host):
            for length in lengths.get(suffix, ()):
                if length <= len(path):
                    keys.append(suffix + path[:length])
                    owners.append((i, len(suffix)))
    best: list[tuple[tuple[int, int], int] | None] = [None] * len(urls)
    for key, (i, host), place in zip(keys, owners, rules.probe(keys)):
        if place >= 0 and (best[i] is None or best[i][0] < (len(key), host)):
            best[i] = ((len(key), host), int(place))
    return [b and (rules.text(b[1]), rules.value(b[1])) for b in best]


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.
    Path: from there up to ``?``, ``#`` or the end. Both empty without ``://`` or url."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substr(url, mark + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return lowered(host), path


def _listed(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, value) of hosts and of rules; a rule that is both blocked and allowed blocks."""
    known = rules.select(lowered(F.col("host")).alias("host"), "path", "verdict").dropna()
    rule = F.concat("host", "path")
    texts = known.groupBy(rule.alias("key")).agg(F.max("verdict").alias("value"))
    length = F.octet_length("path")
    hosts = known.groupBy(F.col("host").alias("key")).agg(F.sort_array(F.collect_set(length)).alias("value"))
    return hosts, texts


def _shipped(spark: SparkSession, hosts: DataFrame, rules: DataFrame) -> str:
    """Name of the file of both arrays, written to the shared folder and sent from there."""
    entries = [
        [(r.key.encode(), np.array(r.value, np.uint32).tobytes()) for r in hosts.collect()],
        [(r.key.encode(), r.value.encode()) for r in rules.collect()],
    ]
    data = b"".join(map(DigestArray.pack, entries))
    name = f"digests-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark).rstrip('/')}/{name}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(path)
    for at in range(0, len(data), 4 << 20):
        out.write(bytearray(data[at : at + (4 << 20)]))
    out.close()
    spark.sparkContext.addFile(system.makeQualified(path).toString())
    return name


def _judge(name: str):
    kind = pa.struct([("rule", pa.string()), ("verdict", pa.string())])

    @F.arrow_udf("struct<rule:string,verdict:string>")
    def judge(host: pa.Array, path: pa.Array) -> pa.Array:
        urls = [(h.encode(), p.encode()) for h, p in zip(host.to_pylist(), path.to_pylist())]
        distinct = list(dict.fromkeys(urls))
        best = _best(*_opened(name), distinct)
        found = {u: b and {"rule": b[0].decode(), "verdict": b[1].decode()} for u, b in zip(distinct, best)}
        return pa.array([found[u] for u in urls], kind)

    return judge


def looked_up_in_parts(asked: DataFrame, entries: DataFrame, part: int = PART) -> DataFrame:
    """(key, value) of the asked keys that entries hold, for lists too long to send.

    Entries and distinct keys are dealt by digest, so that a part is as large as any other;
    the task of a part maps its array and is asked in batches.
    """
    entries, asked = settle(entries), settle(asked.select("key").distinct())
    parts = max(1, -(-max(entries.count(), asked.count()) // part))
    dealt = F.pmod(F.xxhash64("key"), F.lit(parts)).alias("_part")
    value = entries.schema["value"].dataType

    def answer(listed: pa.Table, probes: pa.Table) -> pa.Table:
        texts = [t.encode() for t in listed["key"].to_pylist()]
        array = DigestArray(mapped(DigestArray.pack([(t, str(i).encode()) for i, t in enumerate(texts)])))
        places = array.probe([t.encode() for t in probes["key"].to_pylist()])
        hit = np.flatnonzero(places >= 0)
        return pa.table({
            "key": probes["key"].take(pa.array(hit)),
            "value": listed["value"].take(pa.array([int(array.value(int(p))) for p in places[hit]], pa.int64())),
        })

    both = entries.select(dealt, "key", "value").groupBy("_part").cogroup(asked.select(dealt, "key").groupBy("_part"))
    return both.applyInArrow(answer, f"key string, value {value.simpleString()}")


def _domains(host: Column) -> Column:
    labels = F.split(host, r"\.")
    tail = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), tail)


def _judged_in_parts(urls: DataFrame, hosts: DataFrame, rules: DataFrame, part: int) -> DataFrame:
    """(_host, _path, _found) of the distinct urls that a rule fits."""
    urls = settle(urls.select("_host", "_path").distinct())
    domains = urls.select("_host").distinct().select("_host", F.explode(_domains(F.col("_host"))).alias("key"))
    domains = settle(domains)
    with_rules = domains.join(looked_up_in_parts(domains, hosts, part), "key")
    # Paths are cut by bytes, as lengths are those of UTF-8.
    start = F.substring(F.encode("_path", "UTF-8"), F.lit(1), F.col("_length")).cast("string")
    asked = (
        urls.join(with_rules, "_host")
        .select("_host", "_path", F.col("key").alias("_domain"), F.explode("value").alias("_length"))
        .where((F.octet_length("_path") >= F.col("_length")) & F.is_valid_utf8(start))
        .withColumn("key", F.concat("_domain", start))
    )
    asked = settle(asked)
    fits = asked.join(looked_up_in_parts(asked, rules, part), "key")
    order = F.struct(F.octet_length("key").alias("n"), F.octet_length("_domain").alias("h"), "key", "value")
    best = fits.groupBy("_host", "_path").agg(F.max(order).alias("_best"))
    return best.select("_host", "_path", F.struct(F.col("_best.key").alias("rule"), F.col("_best.value").alias("verdict")).alias("_found"))


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW, shipped: int = SHIPPED, part: int = PART) -> DataFrame:
    """Pages with host, path, rule and verdict of their url.

    ``rules`` has host, path and verdict (``allow`` or ``block``). A rule fits its host and
    all subdomains if the url's path starts with the rule's. The longest wins; of two as
    long, that with the longer host. Rules with a null are left out, of contradicting equal
    ones the block counts. Urls that no rule fits get a null rule and the default, so do null
    urls and those without ``://``, unless a rule has an empty host. Repeated rows are
    each judged. Columns of pages called host, path, rule or verdict are replaced.
    """
    spark = pages.sparkSession
    hosts, texts = map(settle, _listed(rules))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("key") + 32), F.lit(0))).first()[0]
    size += hosts.agg(F.coalesce(F.sum(F.octet_length("key") + 32 + 4 * F.size("value")), F.lit(0))).first()[0]
    host, path = host_and_path(F.col(url))
    h, p, f = unused(pages, "_host", "_path", "_found")
    rows = pages.withColumns(dict(zip((h, p), host_and_path(F.col(url)))))
    if size <= shipped:
        rows = rows.withColumn(f, _judge(_shipped(spark, hosts, texts))(h, p))
    else:
        urls = rows.select(F.col(h).alias("_host"), F.col(p).alias("_path"))
        found = _judged_in_parts(urls, hosts, texts, part).toDF(h, p, f)
        rows = rows.join(found, [h, p], "left")
    verdict = F.coalesce(F.col(f).verdict, F.lit(default))
    return rows.withColumns({"host": F.col(h), "path": F.col(p), "rule": F.col(f).rule, "verdict": verdict}).drop(h, p, f)
