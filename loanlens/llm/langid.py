"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. A word's
probability is the sum over all ways to cut it into pieces, found by a forward pass;
a text's is the product over its words. Piece probabilities are estimated from labelled
documents by expectation-maximisation over the same segmentations.

A word is a run of letters of any length, so a text without spaces is one word. Runs of
more than ``WINDOW`` letters are passed window after window: a window begins with the
sums at the last places before it, as many as the longest piece has letters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import hash_slice, small_batches, unused
from loanlens.session import settle

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents per language, about, from which piece probabilities are estimated.
TRAIN_DOCS = 3_000
ROUNDS = 3
#: Languages whose piece probabilities are held at once; more are taken in blocks.
LANGUAGES = 400
UNKNOWN = "und"
_START = "▁"
#: Letters whose sums are held at once. So many letters that no piece covers, each with the
#: smallest probability, are still above the smallest number.
WINDOW = 30
_TRAINED = 60  # letters; for estimating pieces alone, longer runs are cut into several words
_CACHED = 100_000  # words that a task remembers, fewer with many languages
_CELLS = 4_000_000
_SMOOTH = 0.01
_SCALE = 1_000_000
_WORD = re.compile(r"[^\W\d_]+")


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """Pieces of a SentencePiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = dict.fromkeys(
        model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))
    )
    return list(pieces)


def words_of(text: str | None) -> list[str]:
    """Letter runs in lower case; empty if the text has no letter."""
    words = _WORD.findall(text.lower()) if text else []
    return words if any(c.isalpha() for word in words for c in word) else []


def at_once(languages: int) -> int:
    """Words that share a lattice, so that its memory does not grow with the languages."""
    return max(20, 16_000 // max(languages, 1))


class Pieces:
    """The vocabulary as hashes of 64 bits, in which substrings of many words are looked
    up at once."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    BITS = 20

    def __init__(self, vocabulary: list[str]):
        self.count = len(vocabulary)
        self.longest = max(map(len, vocabulary), default=0)
        whole, begun, base = [], set(), int(self.BASE)
        for piece in vocabulary:
            h = 0
            for c in piece:
                h = (h * base + ord(c) + 1) % 2**64
                begun.add(h)
            whole.append(h)
        self.number = np.argsort(np.array(whole, np.uint64), kind="stable")
        self.hashes = np.array(whole, np.uint64)[self.number]
        #: Which leading bits occur in hashes of pieces, and in those of their beginnings.
        self.whole, self.begun = (np.zeros(1 << self.BITS, bool) for _ in range(2))
        self.whole[self.lead(self.hashes)] = True
        self.begun[self.lead(np.array(list(begun), np.uint64))] = True

    def lead(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are pieces, and the pieces."""
        maybe = np.flatnonzero(self.whole[self.lead(hashes)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), max(self.count - 1, 0))
        sure = self.hashes[at] == hashes[maybe] if self.count else np.zeros(0, bool)
        return maybe[sure], self.number[at[sure]]


class Lattice:
    """All pieces of many words: word, begin, end and piece of each, by end. ``start`` stands
    before every word; a window inside a longer run has none."""

    def __init__(self, words: list[str], pieces: Pieces, start: str = _START):
        self.sizes = np.array([len(start) + len(w) for w in words], dtype=np.int64)
        codes = np.frombuffer("".join(start + w for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.cumsum(self.sizes)
        word = np.repeat(np.arange(len(words)), self.sizes)
        begin = np.arange(len(codes)) - np.repeat(ends - self.sizes, self.sizes)
        left = np.repeat(ends, self.sizes) - np.arange(len(codes))  # letters up to the end
        at, hashes, arcs = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
        for length in range(1, max(pieces.longest, 1) + 1):
            hashes = hashes * pieces.BASE + codes[at + length - 1] + np.uint64(1)
            where, piece = pieces.find(hashes)
            arcs.append((at[where], np.full(len(where), length), piece))
            if length == 1:
                other = np.ones(len(at), bool)
                other[where] = False
                arcs.append((at[other], np.ones(other.sum(), np.int64), np.full(other.sum(), pieces.count)))
            go_on = (left[at] > length) & pieces.begun[pieces.lead(hashes)]
            at, hashes = at[go_on], hashes[go_on]
            if not len(at):
                break
        at, length, piece = (np.concatenate(x) for x in zip(*arcs))
        end = begin[at] + length
        order = np.argsort(end * len(words) + word[at], kind="stable")
        self.end, self.word, self.begin, self.piece = (x[order] for x in (end, word[at], begin[at], piece))
        self.steps = np.searchsorted(self.end, np.arange(1, self.sizes.max(initial=0) + 2))

    def forward(self, probability: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        """For each word, place and language: summed probability of all ways to get there.
        ``given`` are those of the first places, if they are known."""
        alpha = np.zeros((len(self.sizes), self.sizes.max(initial=0) + 1, probability.shape[1]))
        known = 1 if given is None else given.shape[1]
        alpha[:, :known] = 1 if given is None else given
        for end in range(known, alpha.shape[1]):
            arcs = slice(self.steps[end - 1], self.steps[end])
            word = self.word[arcs]
            if len(word):
                mass = alpha[word, self.begin[arcs]] * probability[self.piece[arcs]]
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                alpha[word[first], end] = np.add.reduceat(mass, first, axis=0)
        return alpha

    def log_probabilities(self, probability: np.ndarray) -> np.ndarray:
        return np.log(self.forward(probability)[np.arange(len(self.sizes)), self.sizes] + 1e-300)

    def expected(self, probability: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected number of each piece, per language, for words that occur ``weights`` times
        in it."""
        alpha = self.forward(probability)
        beta = np.zeros_like(alpha)
        rows = np.arange(len(self.sizes))
        beta[rows, self.sizes] = 1
        for end in range(alpha.shape[1] - 1, 0, -1):
            arcs = slice(self.steps[end - 1], self.steps[end])
            np.add.at(beta, (self.word[arcs], self.begin[arcs]), beta[self.word[arcs], end] * probability[self.piece[arcs]])
        share = weights / np.maximum(alpha[rows, self.sizes], 1e-300)
        mass = alpha[self.word, self.begin] * probability[self.piece] * beta[self.word, self.end] * share[self.word]
        counts = np.zeros_like(probability)
        np.add.at(counts, self.piece, mass)
        return counts


def run_log_probabilities(words: list[str], pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """Log probabilities of words of any length, in windows that all words pass together.

    After a window the sums are divided by that at its border, whose log is kept."""
    runs = [_START + w for w in words]
    logs, back, begin = np.zeros((len(runs), probability.shape[1])), 0, 0
    left, state = np.arange(len(runs)), np.ones((len(runs), 1, probability.shape[1]))
    while len(left):
        lattice = Lattice([runs[i][begin - back : begin + WINDOW] for i in left], pieces, start="")
        alpha = lattice.forward(probability, state)
        border = alpha[np.arange(len(left)), lattice.sizes]
        logs[left] += np.log(border)
        begin += WINDOW
        on = np.array([len(runs[i]) > begin for i in left])
        back = min(begin, max(pieces.longest, 1))
        state = alpha[on][:, alpha.shape[1] - 1 - back :] / border[on][:, None]
        left = left[on]
    return logs


@dataclass
class Model:
    """A block of languages, their log prior among all languages, and piece probabilities
    (pieces and unknown, languages)."""

    languages: list[str]
    prior: np.ndarray
    pieces: Pieces
    probability: np.ndarray


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = (w[i : i + _TRAINED] for w in words_of(text) for i in range(0, len(w), _TRAINED))
            found.setdefault(lang, Counter()).update(words)
        rows = [(lang, word, n) for lang, words in found.items() for word, n in words.items()]
        columns = list(zip(*rows)) or [[], [], []]
        kinds = (pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "word", "n"])


def fit(
    df: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", path: str = VOCABULARY
) -> Iterator[Model]:
    """Models of all labels, ``LANGUAGES`` at a time, each estimated when it is asked for.

    Estimates from rows with a label: all of them for the prior, about ``TRAIN_DOCS`` of
    each language, chosen by the hash of the key, for the pieces. Rounds collect only
    expected counts: one number for each piece and language. Without labels there is one
    model without languages."""
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")
    )
    with small_batches(df.sparkSession):
        rows = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    pieces, languages = Pieces(vocabulary(path)), sorted(rows)
    for begin in range(0, max(len(languages), 1), LANGUAGES):
        with small_batches(df.sparkSession):
            model = _fit(labelled, languages[begin : begin + LANGUAGES], rows, pieces)
        yield model


def _fit(labelled: DataFrame, languages: list[str], rows: dict[str, int], pieces: Pieces) -> Model:
    probability = np.full((pieces.count + 1, len(languages)), 1.0 / (pieces.count + 1))
    prior = np.log(np.array([rows[x] for x in languages], dtype=float) / max(sum(rows.values()), 1))
    if not languages:
        return Model(languages, prior, pieces, probability)

    spread = 1_000_000
    most = F.create_map(*[F.lit(v) for x in languages for v in (x, min(spread, -(-TRAIN_DOCS * spread // rows[x])))])
    chosen = labelled.where(F.col("lang").isin(languages) & (hash_slice(F.col("key"), spread) < most[F.col("lang")]))
    words = settle(
        chosen.select("lang", "text").mapInArrow(_counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    context, number = labelled.sparkSession.sparkContext, {x: i for i, x in enumerate(languages)}
    for _ in range(ROUNDS):
        given = context.broadcast((pieces, probability, number))

        def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, probability, number = given.value
            total = np.zeros_like(probability)
            step = at_once(len(number))
            for batch in batches:
                langs, names, n = (batch.column(i).to_pylist() for i in range(3))
                for begin in range(0, len(names), step):
                    part = slice(begin, begin + step)
                    weights = np.zeros((len(names[part]), len(number)))
                    weights[np.arange(len(weights)), [number[x] for x in langs[part]]] = n[part]
                    total += Lattice(names[part], pieces).expected(probability, weights)
            where = np.nonzero(total)
            # Whole numbers sum to the same in any order.
            columns = [*where, np.rint(total[where] * _SCALE).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["piece", "lang", "n"])

        found = (
            words.mapInArrow(expected, "piece bigint, lang bigint, n bigint")
            .groupBy("piece", "lang")
            .agg(F.sum("n").alias("n"))
            .toPandas()
        )
        total = np.zeros_like(probability)
        total[found["piece"], found["lang"]] = found["n"] / _SCALE
        probability = (total + _SMOOTH) / (total.sum(0) + _SMOOTH * len(total))
    return Model(languages, prior, pieces, probability)


def predicted(df: DataFrame, model: Model, text: Column) -> Column:
    """Struct of the block's best language (``und`` for a text that is null or has no
    letter, or if nothing was learned), its log probability together with the text, and the
    log of the sum of these over the block. Both are null for ``und``."""
    given = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, best double, total double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = given.value
        width = len(model.languages)
        known: dict[str, int] = {}
        cached = max(1_000, min(_CACHED, _CELLS // max(width, 1)))
        table, step = np.zeros((cached, width)), at_once(width)

        def learn(words: list[str]) -> None:
            for begin in range(0, len(words), step):
                part = words[begin : begin + step]
                table[len(known) : len(known) + len(part)] = Lattice(part, model.pieces).log_probabilities(model.probability)
                known.update(zip(part, range(len(known), len(known) + len(part))))

        def evidence(words: list[str]) -> np.ndarray:
            """Sum of the log probabilities of words, in parts that the table can hold."""
            try:
                return table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0)
            except KeyError:
                total = np.zeros(width)
            for begin in range(0, len(words), cached // 2):
                part = words[begin : begin + cached // 2]
                new = [w for w in dict.fromkeys(part) if w not in known]
                if len(known) + len(new) > cached:
                    known.clear()
                    new = list(dict.fromkeys(part))
                learn(new)
                total += table[np.fromiter(map(known.__getitem__, part), np.int64, len(part))].sum(0)
            return total

        def summed(words: list[str]) -> np.ndarray:
            """As ``evidence``; long runs are not remembered."""
            if max(map(len, words)) <= WINDOW:
                return evidence(words)
            total = evidence([w for w in words if len(w) <= WINDOW])
            runs = Counter(w for w in words if len(w) > WINDOW)
            names, times = list(runs), np.array(list(runs.values()), float)
            for begin in range(0, len(names), step):
                logs = run_log_probabilities(names[begin : begin + step], model.pieces, model.probability)
                total = total + times[begin : begin + step] @ logs
            return total

        for texts in batches:
            names, bests, totals = [], [], []
            # New words of many texts are looked up together.
            for begin in range(0, len(texts), 100):
                split = [words_of(t) for t in texts.slice(begin, 100).to_pylist()]
                new = {w for w in set().union(*split).difference(known) if len(w) <= WINDOW}
                if len(new) + len(known) <= cached:
                    learn(list(new))
                for words in split:
                    if not words or not width:
                        names.append(UNKNOWN)
                        bests.append(None)
                        totals.append(None)
                        continue
                    total = model.prior + summed(words)
                    best = int(total.argmax())
                    names.append(model.languages[best])
                    bests.append(float(total[best]))
                    totals.append(float(total[best] + np.log(np.exp(total - total[best]).sum())))
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(bests, pa.float64()), pa.array(totals, pa.float64())],
                ["lang_pred", "best", "total"],
            )

    return predict(text)


def held_out(key: Column) -> Column:
    """Whether the key's checksum keeps a document out of the training part."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(df: DataFrame, *, text: str = "text", key: str = "doc_id", lang: str = "lang", path: str = VOCABULARY) -> DataFrame:
    """All rows and columns of ``df`` with ``_held_out`` and ``_language`` (lang_pred, score),
    which replace columns of these names; all others stay.

    Whole texts are scored, runs of letters without an end too; only the estimate of pieces
    cuts these, at 60 letters.
    All labels are learned. With more than ``LANGUAGES`` of them the texts are read once for
    each block, and written in between, so that one block is held at a time; the best
    language and the sum go on. The model is fitted on rows whose key is known and not held
    out. Ties go to the first language by name. Repeated rows get equal predictions.
    """
    models = fit(df.where(F.col(key).isNotNull() & ~held_out(F.col(key))), text=text, lang=lang, key=key, path=path)
    found, (next_block,) = None, unused(df, "_next")
    for model in models:
        if found is None:
            found = df.withColumns({"_held_out": held_out(F.col(key)), "_language": predicted(df, model, F.col(text))})
            continue
        # Blocks come in order of names, so a tie stays with the earlier one.
        scored = settle(found).withColumn(next_block, predicted(df, model, F.col(text)))
        found = scored.withColumn("_language", _better(F.col("_language"), F.col(next_block))).drop(next_block)
    score = F.coalesce(F.exp(F.col("_language.best") - F.col("_language.total")), F.lit(0.0))
    return found.withColumn("_language", F.struct(F.col("_language.lang_pred"), score.alias("score")))


def _better(a: Column, b: Column) -> Column:
    """The better of two blocks' languages, and the log of both sums."""
    ahead = F.coalesce(b["best"] > a["best"], F.lit(False))
    total = F.greatest(a["total"], b["total"]) + F.log1p(F.exp(-F.abs(a["total"] - b["total"])))
    return F.struct(
        F.when(ahead, b["lang_pred"]).otherwise(a["lang_pred"]).alias("lang_pred"),
        F.greatest(a["best"], b["best"]).alias("best"),
        total.alias("total"),
    )
