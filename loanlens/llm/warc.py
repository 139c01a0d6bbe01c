"""WARC archives: written and read by Spark, and joined to captures.

A capture is a request, a response (or, for a payload that another capture holds, a
revisit) and a metadata record, tied by WARC-Concurrent-To. Records are made as text by
built-in functions and written by Spark's text writer, whose line separator is the
blank lines between records; so archives can be in any store. Reading parses whole
files by Content-Length in Python, and a join brings the records of a capture together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import looked_up
from loanlens.session import settle

# Fixed values of the format.
VERSION = "WARC/1.1"
BETWEEN = "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Payload bytes in a file, about. A reader holds a file at once.
FILE_BYTES = 16_000_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight letters for each five bytes."""
    digest = F.upper(F.sha1(payload))
    parts = []
    for part in range(4):
        number = F.conv(F.substring(digest, 10 * part + 1, 10), 16, 10).cast("bigint")
        for letter in range(8):
            code = F.shiftright(number, 35 - 5 * letter).bitwiseAND(F.lit(31)).cast("int")
            parts.append(F.substring(F.lit(BASE32), code + 1, F.lit(1)))
    return F.concat(*parts)


def payloads(pages: DataFrame, key: str, url: str, html: str, least: int) -> DataFrame:
    """Pages with digest, size and the page whose response holds the payload.

    Of pages with equal payloads of at least ``least`` bytes the largest key has the
    response. Only keys and digests are shuffled to find it; a digest in a third of the
    rows meets one row of the other side, and its join is left to adaptive execution,
    which splits it. What comes back to the pages is a row for each revisit.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    own = pages.select(
        F.col(key).cast("bigint").alias("page_id"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        body.alias("body"),
        F.octet_length(body).cast("bigint").alias("bytes"),
        base32_sha1(F.encode(body, "UTF-8")).alias("digest"),
    )
    light = settle(own.where(F.col("bytes") >= least).select("page_id", "digest"))
    # Of pages without a key none is the largest: they are revisits of one that has a key.
    holders = (
        light.groupBy("digest")
        .agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("times"))
        .where("times > 1 AND holder IS NOT NULL")
        .select("digest", "holder")
    )
    revisits = light.join(holders, "digest").where("page_id IS NULL OR page_id != holder").distinct()
    revisits = revisits.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "holder")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest"))
    # Only a page without a key may share a record's name; it gets one from its place.
    found = own.join(looked_up(revisits), same, "left").withColumn("holder", F.coalesce("holder", "page_id"))
    row = F.concat_ws(":", F.lit("row"), F.monotonically_increasing_id().cast("string"), "digest")
    return found.withColumn("name", F.coalesce(F.col("page_id").cast("string"), row))


def _block(headers: list[tuple[str, Column | str]], body: Column) -> Column:
    """A record without the blank lines after it. Header values have no line breaks."""
    lines = [F.lit(VERSION)]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
        lines.append(F.concat(F.lit(f"{name}: "), value))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    head = F.concat_ws("\r\n", *lines)  # a null value leaves its header out
    return F.concat(head, F.lit(BETWEEN), body)


def record_id(kind: str, key: Column) -> Column:
    """A name-based identifier, the same in every run."""
    h = F.md5(F.concat_ws(":", F.lit(kind), key.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    least: int = 0,
) -> None:
    """Writes three records for each page to gzip files under ``path``.

    A null payload or address is an empty one. A page with a null key has records that are
    named after its place, without a page number; it is a revisit where a page with a key
    has its payload, else a response. Repeated keys are written as often as they occur;
    each occurrence of the holder of a payload is a response.
    """
    rows = payloads(pages, key, url, html, least)
    k, name, target = F.col("page_id"), F.col("name"), F.col("url")
    own = record_id("capture", name)
    revisit = F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(k)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit(BETWEEN),
    )
    common = [("WARC-Date", date), ("WARC-Target-URI", target)]
    page = ("X-Page-Id", k)
    answer = _block(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", own),
            *common,
            page,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(revisit, REVISIT)),
            ("WARC-Refers-To", F.when(revisit, record_id("capture", F.col("holder").cast("string")))),
            ("Content-Type", "application/http;msgtype=response"),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("body"))),
    )
    host = F.coalesce(F.nullif(F.regexp_extract(target, r"^\w+://([^/?#\r\n]*)", 1), F.lit("")), F.lit("-"))
    asked = F.concat(
        F.lit("GET / HTTP/1.1\r\nHost: "), host, F.lit(BETWEEN)
    )
    request = _block(
        [("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", name)), *common, page, ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request")],
        asked,
    )
    about = F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit("\r\n"))
    metadata = _block(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", name)), *common, page, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")],
        about,
    )
    size = pages.agg(F.sum(F.octet_length(html) + 1_000), F.count(F.lit(1))).first()
    each = max(1, (size[0] or 0) // max(size[1], 1))
    (
        rows.select(F.explode(F.array(request, answer, metadata)).alias("value"))
        .write.option("lineSep", BETWEEN)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", max(3, 3 * FILE_BYTES // each))
        .text(path)
    )


RECORD = (
    "type string, record_id string, concurrent_to string, refers_to string, page_id bigint, "
    "target_uri string, date string, payload_digest string, payload_bytes bigint, payload binary, fields string"
)


def unpacked(data: bytes) -> bytes:
    """The content of a file: as it is, or that of its gzip members, as far as they go."""
    import zlib

    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data))
        data = member.unused_data
    return b"".join(parts)


def parsed(data: bytes) -> Iterator[dict]:
    """Records of a file, cut by Content-Length, so that any payload is safe. A file that
    ends inside a record gives those before it."""
    at = 0
    while at < len(data):
        head_end = data.find(b"\r\n\r\n", at)
        lines = data[at : head_end if head_end >= 0 else None].split(b"\r\n")
        if not lines[0].startswith(b"WARC/") and (head_end >= 0 or not b"WARC/".startswith(lines[0][:5])):
            raise ValueError(f"no record at byte {at}")
        if head_end < 0:
            return
        headers = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        begin = head_end + 4
        end = begin + int(headers["content-length"])
        if end > len(data):
            return
        yield {"headers": headers, "block": data[begin:end]}
        at = end + 4


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [(n, {"bigint": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (f.split() for f in RECORD.split(", "))]
    )

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema)

    for batch in batches:
        for content in batch.column(0):
            data = content.as_py()
            rows, held = [], 0
            for record in parsed(unpacked(data)):
                h, block = record["headers"], record["block"]
                row = {
                    "type": h.get("warc-type"),
                    "record_id": h.get("warc-record-id"),
                    "concurrent_to": h.get("warc-concurrent-to"),
                    "refers_to": h.get("warc-refers-to"),
                    "page_id": int(h["x-page-id"]) if "x-page-id" in h else None,
                    "target_uri": h.get("warc-target-uri"),
                    "date": h.get("warc-date"),
                    "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                }
                if row["type"] in ("response", "revisit"):
                    head, _, body = block.partition(b"\r\n\r\n")
                    for line in head.split(b"\r\n"):
                        name, _, value = line.partition(b":")
                        if name.lower() == b"content-length":
                            row["payload_bytes"] = int(value)
                    if row["type"] == "response":
                        row["payload"] = body
                else:
                    row["fields"] = block.decode("utf-8", "replace")
                rows.append(row)
                held += len(block)
                if held > 4_000_000:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the files under ``path``; other columns than ``payload`` are light."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInArrow(_records, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: the answer, and its request and metadata records, found by
    their concurrent-to identifier; for a revisit also the page of the answer it refers to,
    found by the record's identifier.

    An answer without the others has nulls for them; of several that name it, the first by
    record identifier counts. Records that name no answer are left out, and a record with
    equal identifier and content that occurs again makes a capture again. Archives are
    parsed twice: once for all but the payloads, which is written, once for the answers.
    """
    light = settle(records.drop("payload"))
    answers = records.where(F.col("type").isin("response", "revisit"))

    def beside(kind: str) -> DataFrame:
        rows = light.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        nested = F.struct("record_id", "date", "target_uri", "fields")
        return rows.groupBy(F.col("concurrent_to").alias(f"_{kind}")).agg(F.min(nested).alias(kind))

    out = answers
    for kind in ("request", "metadata"):
        out = out.join(beside(kind), F.col("record_id") == F.col(f"_{kind}"), "left").drop(f"_{kind}")
    # A page that very many refer to is one row of the other side.
    held = light.where(F.col("type") == "response").groupBy(F.col("record_id").alias("_held")).agg(F.max("page_id").alias("refers_to_page"))
    revisits = light.where(F.col("type") == "revisit").select("record_id", "refers_to")
    found = revisits.join(held, F.col("refers_to") == F.col("_held")).groupBy(F.col("record_id").alias("_revisit")).agg(F.max("refers_to_page").alias("refers_to_page"))
    out = out.join(found, F.col("record_id") == F.col("_revisit"), "left").drop("_revisit")
    response = F.struct("record_id", "type", "date", "payload_digest", "payload_bytes", "refers_to", "payload")
    return out.select(
        "page_id", "target_uri", F.col("refers_to_page"), response.alias("response"), "request", "metadata"
    )
