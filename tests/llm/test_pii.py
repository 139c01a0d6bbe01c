import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from loanlens.llm import pii
from loanlens.llm.queries import QUERIES

# The patterns as they are specified.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], list(PLAIN).index(s[0])))


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(2)
    parts = ["a", "b@c.d", "@", ".", "_", "%", "+", "-", " ", "1", "255", "256", "4111111111111111", "(", ")", "é", "x.y", "+1 555", "12.3"]
    for _ in range(4_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_are_read_once():
    for text in ("a" * 500_000, "1." * 250_000, "1 " * 250_000, "+" * 300_000, "a@" * 200_000, "9" * 400_000):
        pii.proposed_spans(text, pii.base_spans(text))


def test_query_against_the_documents(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op7_weak_supervision"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        want = plain_spans(docs[r.doc_id])
        text = ",".join(f"{k}:{b}:{e}" for k, b, e in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in PLAIN]
        assert set(filter(None, text.split(","))) <= set(filter(None, r.spans.split(",")))


def test_labelers_are_weighed_and_merged_spans_are_found(frame):
    rows = [(i, f"mail a{i}@b.com or card 4111111111111111 call +1 (202) 555-01{i % 90 + 10}") for i in range(60)]
    rows += [(100, "cards 4111111111111111 4111111111111111 here"), (101, "version 1.2.3.4.5 of 2020")]
    df = frame(rows)
    model = pii.fit(df, F.col("text"))
    # The pattern's check tells true candidates better than chance.
    table = model.reliability["card"][0]
    assert table[1][2] > table[0][2]
    got = {r.doc_id: r._spans for r in pii.personal_data(df).collect()}
    assert [(s.kind, s.start, s.base) for s in got[100]] == [("card", 6, False), ("card", 23, False)]


def plain_strict(kind, match):
    """What the pattern labeler demands, as whole expressions."""
    usual = {
        "email": r"(?!\.)(?!.*\.\.)[^@]*(?<!\.)@(?:(?!-)[A-Za-z0-9-]+(?<!-)\.)+[A-Za-z]{2,}",
        "ip": r"(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})",
        "card": r".*",
        "phone": r"\+[1-9].*|\(?[2-9][0-9]{2}[). -]{1,2}[2-9].*",
    }
    return bool(re.fullmatch(usual[kind], match)) and pii.valid(kind, match)


def test_every_kind_has_a_pattern_vote_that_may_fail():
    good = {"email": "a.b@c-d.org", "ip": "10.0.20.255", "card": "4111 1111 1111 1111", "phone": "+1 202 555 0123"}
    bad = {"email": [".a@b.co", "a..b@c.de", "a@-b.com", "a@b.c", "a@1.22", "a (at) b.com"], "ip": ["10.01.2.3", "1.2.3.999"], "card": ["4111111111111112"], "phone": ["+0 202 555 0123", "102 555 0123", "(202) 155-0123"]}
    for kind in pii.KINDS:
        for match in [good[kind], *bad[kind]]:
            assert pii.strict(kind, match, pii.valid(kind, match)) == (match == good[kind]) == plain_strict(kind, match)


def test_added_spans_by_a_count_of_every_candidate(spark, sf_dir):
    """Estimates from one row per candidate, without patterns, and the spans they accept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    planted = [
        (10**9 + i, f"call us on 202 555 01{i:02d} or bob{i} (at) mail (dot) org, build 1.2.3.4.{i} and card 4111-1111-1111-1111 4111-1111-1111-1111 x{i}")
        for i in range(30)
    ]
    docs = docs.unionByName(spark.createDataFrame(planted, "doc_id bigint, text string"))
    model = pii.fit(docs, F.col("text"))
    given = {r.doc_id: r.text or "" for r in docs.collect()}
    seen = {kind: [] for kind in pii.KINDS}
    for text in given.values():
        base = pii.base_spans(text)
        for kind, begin, end in base + pii.proposed_spans(text, base):
            votes, features = pii.signs(text, kind, begin, end)
            ballot = [votes // 3**i % 3 - 1 for i in range(4)]
            assert (ballot[0] == 1) == plain_strict(kind, text[begin:end]), text[begin:end]
            seen[kind].append((ballot, features))
    for kind, rows in seen.items():
        assert rows
        votes = np.array([v for v, _ in rows])
        table, share, q = pii.reliabilities(votes, np.ones(len(rows)))
        assert np.allclose(table, model.reliability[kind]) and np.isclose(share, model.share[kind])
        x = np.zeros((len(rows), pii.FEATURES + 1))
        x[:, -1] = 1
        for i, (_, features) in enumerate(rows):
            assert len(set(features)) == len(features)
            x[i, features] = 1
        w = model.weights[kind]
        # The likelihood of all candidates with its ridge is at its greatest.
        assert np.abs(x.T @ (q - 1 / (1 + np.exp(-x @ w))) - w).max() < 1e-4
    added = 0
    for r in pii.personal_data(docs).collect():
        text, base = given[r.doc_id], pii.base_spans(given[r.doc_id])
        want, last = [(*s, True) for s in base], 0
        for kind, begin, end in sorted(pii.proposed_spans(text, base), key=lambda s: (s[1], pii.KINDS.index(s[0]))):
            features = pii.signs(text, kind, begin, end)[1]
            if begin >= last and model.weights[kind][[*features, -1]].sum() >= np.log(pii.ACCEPT / (1 - pii.ACCEPT)):
                want.append((kind, begin, end, False))
                last, added = end, added + 1
        assert sorted((s.kind, s.start, s.end, s.base) for s in r._spans) == sorted(want)
    assert added > 0


def test_words_around_decide_that_no_list_has(frame):
    words = ["zorblat", "quimby"]
    assert not any(w in x for w in words for x in [*pii.CONTEXT.values(), pii.AGAINST])
    rows = [(i, f"phone zorblat 202 555 01{i:02d} ok") for i in range(60)] + [(100 + i, f"isbn quimby 111-111-11{i:02d} ok") for i in range(60)]
    model = pii.fit(frame(rows), F.col("text"))

    def chance(word):
        text = f"{word} 303 555 0199 ok"
        return model.probability("phone", pii.signs(text, "phone", len(word) + 1, len(word) + 13)[1])

    assert chance("zorblat") > chance("plain") > chance("quimby")


def test_more_patterns_than_are_fitted(frame, monkeypatch):
    rows = [(i, f"card w{i} 4111111111111111 4111111111111111 and phone v{i} +1 202 555 0{i:03d}") for i in range(300)]
    monkeypatch.setattr(pii, "PATTERNS", 20)
    got = {r.doc_id: r._spans for r in pii.personal_data(frame(rows)).collect()}
    assert all(sum(s.kind == "phone" and s.base for s in got[i]) == 1 for i, _ in rows)
    assert [[(s.kind, s.start) for s in got[i] if not s.base] for i in (5, 250)] == [[("card", 8), ("card", 25)], [("card", 10), ("card", 27)]]


def test_edges_and_redaction(frame):
    rows = [(1, None), (2, ""), (3, "no data"), (4, "é a@b.co é"), (4, "é a@b.co é"), (5, "y" * 300_000 + " 10.0.0.1"), (None, "+1 202 555 0123")]
    df = pii.personal_data(frame(rows))
    got = [r.asDict() for r in df.withColumn("clean", pii.redacted(F.col("text"), F.col("_spans"))).collect()]
    clean = {r["doc_id"]: r["clean"] for r in got}
    assert clean[1] is None and clean[2] == "" and clean[3] == "no data" and clean[4] == "é <EMAIL> é"
    assert clean[5].endswith("y <IP>") and clean[None] == "<PHONE>"
    assert len(got) == len(rows) and all(r["source"] == "s" for r in got)
    assert pii.personal_data(frame([])).collect() == []
