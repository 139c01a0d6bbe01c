import base64
import hashlib

from loanlens.llm import warc
from loanlens.session import new_path

SCHEMA = "page_id bigint, url string, html string, type string, digest string"


def test_round_trip_of_awkward_payloads(spark):
    bodies = [
        "<p>a</p>", "<p>a</p>", "", None, "é" * 300_000, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n",
        "tail\r\n\r\n", "\r\n", "<p>a</p>", "", "Content-Length: 9\r\n\r\n",
    ]
    rows = [(i, f"http://h{i}/x\r\ny: z" if i % 2 else None, b, "t", "d") for i, b in enumerate(bodies)]
    unkeyed = [(None, "u", "no key", "t", "d"), (None, None, "no key", "t", "d"), (None, "u", "<p>a</p>", "t", "d")]
    df = spark.createDataFrame([*rows, *unkeyed], SCHEMA)
    path = new_path(spark, "warc-test")
    warc.write_archives(df, path)
    found = warc.captures(warc.read_archives(spark, path)).collect()
    got = {r.page_id: r for r in found if r.page_id is not None}
    assert set(got) == set(range(len(bodies))) and len(found) == len(bodies) + 3
    without = sorted((r.response.type, bytes(r.response.payload or b""), r.refers_to_page) for r in found if r.page_id is None)
    assert without == [("response", b"no key", None), ("response", b"no key", None), ("revisit", b"", 8)]
    assert len({r.response.record_id for r in found}) == len(found) and all(r.request and r.metadata for r in found)
    holder = {}
    for i, b in enumerate(bodies):
        holder[b or ""] = i
    for i, b in enumerate(bodies):
        r, data = got[i], (b or "").encode()
        assert r.response.payload_bytes == len(data)
        assert r.response.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if holder[b or ""] == i:
            assert r.response.type == "response" and bytes(r.response.payload) == data and r.refers_to_page is None
        else:
            assert r.response.type == "revisit" and r.refers_to_page == holder[b or ""] and r.response.payload is None
        assert r.request.fields.startswith("GET ") and f"payload-bytes: {len(data)}" in r.metadata.fields


def test_small_payloads_may_be_written_again(spark):
    df = spark.createDataFrame([(1, "u", "ab", "", ""), (2, "u", "ab", "", "")], SCHEMA)
    path = new_path(spark, "warc-test")
    warc.write_archives(df, path, least=3)
    assert {r.response.type for r in warc.captures(warc.read_archives(spark, path)).collect()} == {"response"}


def test_orphans_and_empty(spark):
    fields = [f.split() for f in warc.RECORD.split(", ")]
    row = lambda **k: tuple(k.get(n) for n, _ in fields)
    records = spark.createDataFrame(
        [
            row(type="response", record_id="a", page_id=1),
            row(type="request", record_id="r2", concurrent_to="a", fields="2"),
            row(type="request", record_id="r1", concurrent_to="a", fields="1"),
            row(type="metadata", record_id="m", concurrent_to="gone"),
            row(type="metadata", record_id="n"),
            row(type="revisit", record_id="v", page_id=2, refers_to="a"),
            row(type="revisit", record_id="w", page_id=3, refers_to="unknown"),
        ],
        warc.RECORD,
    )
    one, two, three = sorted(warc.captures(records).collect(), key=lambda r: r.page_id)
    assert one.request.fields == "1" and one.metadata is None
    assert (two.refers_to_page, three.refers_to_page) == (1, None)
    assert warc.captures(records.limit(0)).collect() == []


def test_truncated_and_foreign_files(spark):
    import gzip

    import pytest

    record = lambda kind, body, *more: "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", *more, f"Content-Length: {len(body)}", "", body]).encode() + b"\r\n\r\n"
    members = [record("warcinfo", "x"), record("response", "HTTP/1.1 200 OK\r\n\r\nbody", "WARC-Record-ID: <a>"), record("metadata", "y")]
    whole = b"".join(members)
    assert warc.unpacked(b"".join(map(gzip.compress, members))) == whole
    for cut in range(len(whole)):
        assert [r["block"] for r in warc.parsed(whole[:cut])] == [r["block"] for r in warc.parsed(whole)][: len(list(warc.parsed(whole[:cut])))]
    assert len(list(warc.parsed(whole[: len(whole) - 8]))) == 2
    assert whole.startswith(warc.unpacked(gzip.compress(whole)[:-30]))
    with pytest.raises(ValueError, match="no record"):
        list(warc.parsed(b"something else\r\n\r\n"))
