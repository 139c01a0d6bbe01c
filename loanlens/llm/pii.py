"""Personal data by weak supervision.

Four kinds of spans: email, ip, card, phone. Base spans are those of fixed patterns and
checks and always stay. Looser patterns propose more candidates. Labelers of different
nature (pattern, gazetteer, context, shape) vote on every candidate; the votes of the
whole corpus are counted by pattern, expectation-maximisation on these counts estimates
how reliable each labeler is, and its posteriors train a logistic classifier that
decides which proposed spans are added.

The classifier does not see the context and shape votes. It sees the characters of a span,
those beside it, and the words around it, hashed; so it learns words that no list has.

Candidates are counted by votes and features. The at most 3**4 vote patterns of each kind
reach the driver with their counts of the whole corpus. The classifier is fitted on all
feature patterns while there are at most ``PATTERNS`` of a kind, and on about as many,
chosen by hash, beyond.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import small_batches
from loanlens.session import settle

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "shape")
#: Probability from which a proposed span is added.
ACCEPT = 0.8
ROUNDS = 50
#: Distinct patterns of a kind, about, on which its classifier is fitted.
PATTERNS = 10_000

# Base patterns. Runs are taken whole (possessive), so that a long one is read once; the
# matches are those of the plain patterns.
_BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)?"),
    "ip": re.compile(r"[0-9]++((?:\.[0-9]++){3})?"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOOSE = {
    "email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?[(\[{]\s?(?i:at)\s?[)\]}]\s?[A-Za-z0-9-]++"
        r"(?:\s?(?:\.|[(\[{]\s?(?i:dot)\s?[)\]}])\s?[A-Za-z0-9-]++)+"
    ),
    "ip": re.compile(r"(?<=[0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20./-]?[0-9]{4}){2}[\x20./-]?[0-9]{3,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
}
#: What a text must hold to have a candidate at all.
CANDIDATE = r"[0-9@]|[(\[{]\s?[Aa][Tt]"

# Gazetteers and context words.
DOMAINS = set(
    "com org net edu gov mil int io co ai app dev info biz name pro mobi xyz online site shop blog cloud tech me tv "
    "de fr es uk eu us ca it nl ch at be pl ru cn jp in br mx ar cl pe pt ie se no dk fi is cz sk hu ro bg gr tr ua "
    "il za ng ke eg sa ae ir pk bd lk th vn my sg id ph kr tw hk au nz lu lt lv ee si hr rs".split()
)
CARD_STARTS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|30[0-5]|36|38|6011|65|35")
CONTEXT = {
    "email": set(
        "email e-mail mail mailto contact contacto correo kontakt courriel write address inbox reply sender recipient "
        "cc bcc from to reach support escribir schreiben".split()
    ),
    "ip": set(
        "ip ipv host server address client login serveur servidor adresse gateway dns subnet router proxy firewall "
        "ping remote peer node connected connection".split()
    ),
    "card": set(
        "card cards visa mastercard amex discover maestro credit debit karte carte tarjeta payment pay paid cvv cvc "
        "expiry expires kreditkarte cardholder charged".split()
    ),
    "phone": set(
        "phone tel telephone call calls called mobile cell fax telefon telefono anruf appel sms text whatsapp hotline "
        "dial number handy movil portable".split()
    ),
}
AGAINST = set(
    "version release isbn issn doi order invoice token key sha md5 hash id uuid page section chapter total commit "
    "build article figure table part serial sku price score".split()
)
AROUND = 40
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, match: str) -> bool:
    """The check behind a kind's pattern."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))
    if kind == "card":
        return len(match) <= 37 and 12 <= len(d := _digits(match)) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(match)) <= 15
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of the fixed patterns that pass their check, by start and kind."""
    found = []
    digits = any(c in text for c in "0123456789")
    for kind, given in zip(KINDS, ("@" in text, "." in text and digits, digits, "+" in text and digits)):
        if given:
            optional = kind in ("email", "ip")
            for m in _BASE[kind].finditer(text):
                if (not optional or m[1]) and valid(kind, m[0]):
                    found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def proposed_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Matches of the looser patterns that no base span of any kind touches."""
    taken = sorted((b, e) for _, b, e in base)
    out, at = [], 0
    for kind in KINDS:
        at = 0
        for m in _LOOSE[kind].finditer(text):
            begin, end = m.span()
            while at < len(taken) and taken[at][1] <= begin:
                at += 1
            if not any(b < end and e > begin for b, e in taken[at : at + 4]):
                out.append((kind, begin, end))
    return out


def strict(kind: str, match: str, good: bool) -> bool:
    """The vote of the pattern labeler: the check, and what is usual beyond it, so that it
    may fail for spans of every kind."""
    if kind == "email":
        name, _, host = match.partition("@")
        labels = host.split(".")
        plain = bool(host) and not name.startswith(".") and not name.endswith(".") and ".." not in name
        return plain and all(x[:1] != "-" and x[-1:] != "-" for x in labels) and len(labels[-1]) > 1 and labels[-1].isalpha()
    if kind == "ip":
        return good and all(p == "0" or p[0] != "0" for p in match.split("."))
    if kind == "phone":
        digits = _digits(match)
        return good and (digits[0] != "0" if match[0] == "+" else digits[0] in "23456789" and digits[3] in "23456789")
    return good


# Features of the classifier, by number: of the span, of its neighbours, of words by hash.
SPAN = ("good", "known", "grouped", "long", "plus", "letters", "dots", "hyphens", "spaces", "alike", "rising")
BESIDE = ("none", "space", "letter", "digit", "bracket", "other")
SIZES = 5  # classes of the number of digits
WORDS = 128
FEATURES = len(SPAN) + SIZES + 2 * len(BESIDE) + 2 * WORDS


def _beside(text: str, at: int) -> str:
    c = text[at] if 0 <= at < len(text) else ""
    if not c:
        return "none"
    if c.isspace():
        return "space"
    if c.isalpha():
        return "letter"
    if c.isdigit():
        return "digit"
    return "bracket" if c in "()[]{}<>\"'" else "other"


def features_of(text: str, begin: int, end: int, good: bool, known: bool) -> list[int]:
    """Numbers of the features that a candidate has, ascending."""
    match = text[begin:end]
    digits = _digits(match)
    span = {
        "good": good,
        "known": known,
        "grouped": any(c in " -./()" for c in match),
        "long": len(match) > 14,
        "plus": match[0] == "+",
        "letters": any(c.isalpha() for c in match),
        "dots": "." in match,
        "hyphens": "-" in match,
        "spaces": " " in match,
        "alike": len(digits) > 3 and len(set(digits)) <= 2,
        "rising": len(digits) > 3 and digits[:8] in "01234567890123456789",
    }
    found = [i for i, name in enumerate(SPAN) if span[name]]
    at = len(SPAN)
    found.append(at + min(len(digits) // 4, SIZES - 1))
    at += SIZES
    for place in (begin - 1, end):
        found.append(at + BESIDE.index(_beside(text, place)))
        at += len(BESIDE)
    before = _WORDS.findall(text[max(0, begin - AROUND) : begin].lower())[-2:]
    after = _WORDS.findall(text[end : end + AROUND].lower())[:1]
    for words in (before, after):
        found += sorted({at + crc32(w.encode("utf-8", "replace")) % WORDS for w in words})
        at += WORDS
    return found


def signs(text: str, kind: str, begin: int, end: int) -> tuple[int, list[int]]:
    """Votes of the labelers as one number to base 3, and the numbers of the features."""
    match = text[begin:end]
    digits = _digits(match)
    around = _WORDS.findall(f"{text[max(0, begin - AROUND) : begin]} {text[end : end + AROUND]}".lower())
    cue, against = any(w in CONTEXT[kind] for w in around), any(w in AGAINST for w in around)
    left = begin == 0 or not text[begin - 1].isalnum()
    right = end == len(text) or not text[end].isalnum()
    alike = len(digits) > 3 and len(set(digits)) <= 2
    good = valid(kind, match)
    if kind == "email":
        known = re.split(r"[^A-Za-z]+", match)[-1].lower() in DOMAINS
    elif kind == "card":
        known = bool(CARD_STARTS.match(digits))
    elif kind == "ip":
        known = good and 0 < int(match.split(".")[0]) < 224
    else:
        known = len(digits) >= 10 and digits[-10] not in "01"
    votes = (
        1 if strict(kind, match, good) else -1,
        1 if known else -1,
        cue - against,
        1 if left and right and not alike else -1,
    )
    return sum((v + 1) * 3**i for i, v in enumerate(votes)), features_of(text, begin, end, good, known)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for text in batch.column(0).to_pylist():
            base = base_spans(text)
            for kind, begin, end in base + proposed_spans(text, base):
                votes, features = signs(text, kind, begin, end)
                found[(KINDS.index(kind), votes, tuple(features))] += 1
        rows = list(zip(*[(*k, n) for k, n in found.items()])) or [[]] * 4
        types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names=["kind", "votes", "features", "n"])


@dataclass
class Model:
    """Per kind: classifier weights (last: constant), how each labeler votes on false and
    true spans, and the share of true ones."""

    weights: dict[str, np.ndarray]
    reliability: dict[str, np.ndarray]
    share: dict[str, float]

    def probability(self, kind: str, features: list[int]) -> float:
        weights = self.weights[kind]
        return float(1 / (1 + np.exp(-np.clip(weights[features].sum() + weights[-1], -30, 30))))


def reliabilities(votes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation for labelers that vote independently given the truth.

    ``votes`` has -1, 0, 1 per pattern and labeler, ``n`` the candidates of each pattern.
    Returns P(vote | truth) by labeler, truth and vote, the share of true candidates,
    and the probability of truth for each pattern. The majority starts the rounds.
    """
    q = np.clip(0.5 + votes.sum(1) / (2 * votes.shape[1]), 0.05, 0.95)
    for _ in range(ROUNDS):
        share = float((n @ q + 1) / (n.sum() + 2))
        table = np.empty((votes.shape[1], 2, 3))
        for truth, weight in enumerate((n * (1 - q), n * q)):
            for v in range(3):
                table[:, truth, v] = weight @ (votes == v - 1) + 0.5
        table /= table.sum(2, keepdims=True)
        log = np.log(table)[np.arange(votes.shape[1]), :, votes + 1].sum(1)
        q = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1] + np.log((1 - share) / share), -30, 30)))
    return table, share, q


def classifier(bits: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic weights for soft labels, by Newton's method with a small ridge."""
    x = np.column_stack([bits, np.ones(len(bits))]).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (q - p)) - w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(df: DataFrame, text: Column) -> Model:
    """Counts the votes on all candidates of all texts and learns from the counts."""
    texts = df.select(text.alias("text")).where(F.col("text").rlike(CANDIDATE))
    counting = (
        texts.mapInArrow(_counted, "kind bigint, votes bigint, features array<int>, n bigint")
        .groupBy("kind", "votes", "features")
        .agg(F.sum("n").alias("n"))
    )
    with small_batches(df.sparkSession):
        patterns = settle(counting)
    counted = patterns.groupBy("kind", "votes").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("patterns")).collect()
    model, truth, share = Model({}, {}, {}), {}, {}
    for number, kind in enumerate(KINDS):
        rows = sorted((r["votes"], r["n"], r["patterns"]) for r in counted if r["kind"] == number)
        ballots, n, distinct = np.array(rows, dtype=np.int64).reshape(-1, 3).T
        votes = ballots[:, None] // 3 ** np.arange(len(LABELERS)) % 3 - 1
        model.reliability[kind], model.share[kind], q = reliabilities(votes, n.astype(float))
        truth[number] = dict(zip(ballots.tolist(), q))
        share[number] = min(1.0, PATTERNS / max(int(distinct.sum()), 1))

    slices = 1_000_000
    most = F.create_map(*[F.lit(v) for number, x in share.items() for v in (number, round(x * slices))])
    slot = F.pmod(F.xxhash64("votes", "features"), F.lit(slices))
    chosen = patterns.where(slot < F.element_at(most, F.col("kind").cast("int"))).collect()
    chosen.sort(key=lambda r: (r["kind"], r["votes"], r["features"]))
    for number, kind in enumerate(KINDS):
        rows = [r for r in chosen if r["kind"] == number]
        bits = np.zeros((len(rows), FEATURES))
        for i, r in enumerate(rows):
            bits[i, r["features"]] = 1
        q = np.array([truth[number][r["votes"]] for r in rows])
        model.weights[kind] = classifier(bits, q, np.array([r["n"] for r in rows], dtype=float))
    return model


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"


def spans(df: DataFrame, text: Column, model: Model) -> Column:
    """All spans of a text by start and kind: base ones, and proposed ones that the
    classifier accepts. Offsets are code points, the end excluded. Null gives none."""
    given = df.sparkSession.sparkContext.broadcast(model)
    fields = [pa.field("kind", pa.string()), pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("base", pa.bool_()), pa.field("score", pa.float64())]

    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        model, out = given.value, []
        for text in texts.to_pylist():
            if text is None:
                out.append([])
                continue
            base = base_spans(text)
            found = [(*s, True, model.probability(s[0], signs(text, *s)[1])) for s in base]
            last = 0
            for kind, begin, end in sorted(proposed_spans(text, base), key=lambda s: (s[1], KINDS.index(s[0]))):
                score = model.probability(kind, signs(text, kind, begin, end)[1])
                if begin >= last and score >= ACCEPT:
                    found.append((kind, begin, end, False, score))
                    last = end
            found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
            out.append([dict(zip(("kind", "start", "end", "base", "score"), s)) for s in found])
        return pa.array(out, pa.list_(pa.struct(fields)))

    # Texts without any candidate are not sent to Python.
    return find(F.when(text.rlike(CANDIDATE), text))


def personal_data(df: DataFrame, *, text: str = "text") -> DataFrame:
    """All rows and columns of ``df`` with ``_spans``, which replaces a column of this name. A
    null or empty text has none; repeated rows get the same; an empty table gives no rows."""
    return df.withColumn("_spans", spans(df, F.col(text), fit(df, F.col(text))))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; spans that overlap
    are replaced together, by the kind of the first."""

    @F.arrow_udf("string")
    def replace(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), spans.to_pylist()):
            if text is not None and found:
                parts, last = [], 0
                for s in found:
                    if s["start"] >= last:
                        parts += [text[last : s["start"]], f"<{s['kind'].upper()}>"]
                    last = max(last, s["end"])
                text = "".join([*parts, text[last:]])
            out.append(text)
        return pa.array(out, pa.string())

    some = F.size(spans) > 0
    return F.when(some, replace(F.when(some, text), F.when(some, spans))).otherwise(text)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string")))
    return F.array_join(one, ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("bigint")
