"""URL filters: both ways of looking up equal a plain search, digests may collide."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loanlens.llm import urlfilter
from loanlens.llm.urlfilter import DigestArray

RULES = "host string, path string, verdict string"


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    best = None
    for h, p, verdict in sorted(rules, key=lambda r: r[2]):
        if h is None or p is None:
            continue
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (), (len((h + p).encode()), len(h.encode()), h + p, verdict))
    return host, path, best and best[2], best[3] if best else default


def test_digest_is_that_of_spark(spark):
    texts = ["", "a", "net/", "é中" * 20, "x" * 1000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()
    assert [r[0] % 2**64 for r in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


def test_array_confirms_texts_against_collisions():
    few = lambda texts: np.array([len(t) % 3 for t in texts], np.uint64)
    entries = [(f"k{'x' * i}".encode(), str(i).encode()) for i in range(30)]
    array = DigestArray(DigestArray.pack(entries, few))
    asked = [t for t, _ in entries] + [b"other", b"", b"kxxy"]
    places = array.probe(asked, few)
    assert [array.value(p) for p in places[:30]] == [v for _, v in entries]
    assert [array.text(p) for p in places[:30]] == asked[:30] and set(places[30:]) == {-1}


def test_empty_array():
    array = DigestArray(DigestArray.pack([]))
    assert list(array.probe([b"a"])) == [-1] and list(array.probe([])) == []


RULE_ROWS = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/", "block"), ("A.example.NET", "/en", "allow"),
    ("org", "", "block"), ("x.org", "/é", "allow"), ("bc.de", "/abc", "allow"), ("c.de", "/", "block"), ("de", "/abcd", "block"),
    (None, "/", "block"), ("q", None, "block"), ("", "/z", "block"), ("net", "/", "block"),
]
URLS = [
    None, "", "no scheme", "http://", "http://NET/", "http://net", "http://net?/", "https://a.b.net/x?y#z", "http://example.net/en/1",
    "http://a.example.net/en/1", "http://a.example.net/EN/1", "http://x.org/éa", "http://x.org/e", "http://xorg/", "http://y.x.org#a/b",
    "http://a.bc.de/abcde", "http://bc.de/abc", "http://c.de/", "ftp://u:p@c.de:80/", "http://end./z", "http:///z", "http://a..net/",
    "x://y://net/", "http://net/" + "long" * 5000, "http://" + "a." * 300 + "net/", "http://a\nb.net/\n",
]


@pytest.mark.parametrize("sizes", [{}, {"shipped": 0, "part": 3}])
def test_judged_equals_plain_search(spark, sizes):
    random.seed(3)
    parts = ["net", "org", "de", "c", "bc", "x", "example", "a", ""]
    urls = URLS + [f"h://{'.'.join(random.choices(parts, k=random.randint(1, 4)))}/{random.choice(['en/', 'abcd', 'é', 'z', ''])}" for _ in range(300)]
    rows = [(i, u, "mine", "kept") for i, u in enumerate(urls + urls[:9])]
    pages = spark.createDataFrame(rows, "page_id long, url string, _host string, `_found` string")
    got = urlfilter.judged(pages, spark.createDataFrame(RULE_ROWS, RULES), **sizes)
    assert got.columns == ["page_id", "url", "_host", "_found", "host", "path", "rule", "verdict"]
    found = {r.page_id: r for r in got.collect()}
    assert len(found) == got.count() == len(rows)
    for i, url, *_ in rows:
        assert tuple(found[i][4:]) == plain(url, RULE_ROWS), url
        assert found[i][2:4] == ("mine", "kept")


@pytest.mark.parametrize("sizes", [{}, {"shipped": -1, "part": 3}])
def test_empty_tables(spark, sizes):
    pages, rules = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), spark.createDataFrame(RULE_ROWS, RULES)
    assert urlfilter.judged(pages.limit(0), rules, **sizes).count() == 0
    row = urlfilter.judged(pages, rules.limit(0), default="block", **sizes).first()
    assert (row.rule, row.verdict) == (None, "block")
