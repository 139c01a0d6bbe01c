"""Benchmark decontamination by template windows, with built-in functions only.

Numbers, names and units of a text are replaced by typed placeholders, so that a
question with other numbers or names in it keeps its template. Windows of templates
of a document and of a benchmark item are hash-joined, and the values behind the
placeholders must map one to one between the two.

Canonicalising every window of the corpus is not needed: each benchmark window names
its two longest literal words, and only windows of the corpus with equal words in
these places can be equal. Documents are exploded to words once, matched with the
longer word, checked for the other, and only what is left becomes a window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.session import settle

# Units that follow a number, and what may surround a word.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms "
    "oz lb lbs pound pounds ton tons ml l liter liters litre litres s sec second seconds min minute minutes h "
    "hr hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents "
    "percent mph kmh v w kw"
).split()
EDGES = ".,;:!?\"'`()[]{}<>%$#&*=|/\\~^_-+"
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
SPACE = r"[\x20\x09-\x0D]+"
DIGITS = r"^[0-9]+([.,][0-9]+)*$"
SENTENCE_END = r"[.!?:]['\")\]]*$"

#: Anchors, and windows, that are broadcast at once; more are taken in blocks.
BLOCK = 500_000


def word_list(text: Column) -> Column:
    """Words between white space; a null or blank text has one empty word, which is no
    anchor and so starts no window."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r")), SPACE)


def literal(word: Column) -> Column:
    """Lower case, without what stands around a word."""
    return F.lower(F.btrim(word, F.lit(EDGES)))


def exact(word: Column) -> Column:
    """Literal form, or the word itself if it is made of signs only."""
    return F.coalesce(F.nullif(literal(word), F.lit("")), word)


def kinds(words: Column, starts: Column, after_number: Column) -> Column:
    """For each word: its placeholder or literal form, and the value behind it.

    A name is a capitalised word that does not begin a sentence; a unit is a known one
    after a number. ``starts`` says whether the first word begins a sentence, and
    ``after_number`` whether a number stands before it.
    """

    def kind(word: Column, i: Column) -> Column:
        before = F.get(words, i - 1)
        plain = F.btrim(word, F.lit(EDGES))
        begins = F.when(i == 0, starts).otherwise(before.rlike(SENTENCE_END))
        measured = F.when(i == 0, after_number).otherwise(F.btrim(before, F.lit(EDGES)).rlike(DIGITS))
        form = (
            F.when(plain.rlike(DIGITS), F.lit(NUMBER))
            .when(F.lower(plain).isin(UNITS) & measured, F.lit(UNIT))
            .when(plain.rlike(r"^\p{Lu}\p{Ll}") & ~begins, F.lit(NAME))
            .otherwise(F.lower(plain))
        )
        return F.struct(form.alias("form"), F.lower(plain).alias("value"))

    return F.transform(words, kind)


def is_slot(form: Column) -> Column:
    return form.isin(NUMBER, NAME, UNIT)


def longest(window: Column, other_than: Column | None = None) -> Column:
    """Place in a window that must match exactly of its longest literal word, or else of
    its longest value; -1 if there is none."""
    skip = F.lit(-1) if other_than is None else other_than
    scores = F.transform(
        window,
        lambda x, i: F.when(i == skip, F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("length"))).otherwise(
            F.struct((~is_slot(x.form) & (x.form != "")).cast("int").alias("kind"), F.length(x.exact).alias("length"))
        ),
    )
    best = F.array_max(scores)
    return F.when(best["kind"] < 0, -1).otherwise(F.array_position(scores, best).cast("int") - 1)


def longest_literal(window: Column, other_than: Column | None = None) -> Column:
    """Place in the window of its longest literal word, the first of equals."""
    skip = F.lit(-1) if other_than is None else other_than
    lengths = F.transform(
        window, lambda x, i: F.when(is_slot(x.form) | (i == skip), 0).otherwise(F.length(x.form))
    )
    return F.array_position(lengths, F.array_max(lengths)).cast("int") - 1


def benchmark_windows(benchmark: DataFrame, key: str, text: str, width: int, literals: int) -> DataFrame:
    """Windows of items: item, place, n_words, template, values, its two longest words with
    their places, whether it is weak, and the item's numbers of windows. An item of fewer
    words than ``width`` is one window.

    The first word of an item counts once as the begin of a sentence and once as not,
    since a document may quote it in the middle of one. Windows with fewer literal words
    than ``literals`` (or all, if the item is shorter) say too little as a template. They
    are weak: in place of the template they have their exact words, and no values.
    """
    words = benchmark.select(F.col(key).alias("item_id"), word_list(F.col(text)).alias("words")).where(
        F.col("item_id").isNotNull()
    )
    both = words.select("item_id", "words", F.explode(F.array(F.lit(True), F.lit(False))).alias("start"))
    with_exact = F.transform(
        F.arrays_zip(kinds(F.col("words"), F.col("start"), F.lit(False)).alias("kind"), F.col("words").alias("word")),
        lambda x: F.struct(x["kind"].form.alias("form"), x["kind"].value.alias("value"), exact(x["word"]).alias("exact")),
    )
    coded = both.select("item_id", "start", with_exact.alias("coded"))
    span = F.least(F.lit(width), F.size("coded"))
    cut = coded.select(
        "item_id",
        "start",
        span.alias("n_words"),
        "coded",
        F.explode(F.sequence(F.lit(0), F.size("coded") - span)).alias("place"),
    ).where(F.col("start") | (F.col("place") == 0))
    window, weak = F.col("window"), F.col("weak")
    n_literals = F.size(F.filter(window, lambda x: ~is_slot(x.form) & (x.form != "")))
    in_item = Window.partitionBy("item_id")
    slots = F.transform(F.filter(window, lambda x: is_slot(x.form)), lambda x: F.struct(x.form.alias("form"), x.value.alias("value")))
    return (
        cut.select(
            "item_id", "place", "n_words", F.slice("coded", F.col("place") + 1, F.col("n_words")).alias("window")
        )
        .withColumn("weak", n_literals < F.least(F.lit(literals), F.col("n_words")))
        .select(
            "item_id",
            "place",
            "n_words",
            "weak",
            F.array_join(
                F.when(weak, F.transform(window, lambda x: x.exact)).otherwise(F.transform(window, lambda x: x.form)), " "
            ).alias("template"),
            F.when(weak, F.slice(slots, 1, 0)).otherwise(slots).alias("values"),
            F.when(weak, longest(window)).otherwise(longest_literal(window)).alias("at"),
            "window",
        )
        .withColumn("at2", F.when(weak, longest(window, F.col("at"))).otherwise(longest_literal(window, F.col("at"))))
        .withColumn("first", F.get(window, F.col("at")))
        .withColumn("other", F.get(window, F.col("at2")))
        .withColumn("anchor", F.when(weak, F.col("first.exact")).otherwise(F.col("first.form")))
        # Where a weak window has one literal word, other values beside it would only make more anchors.
        .withColumn(
            "second",
            F.when(~weak & ~is_slot(F.col("other.form")), F.col("other.form")).when(
                weak & (is_slot(F.col("first.form")) | ~is_slot(F.col("other.form"))), F.col("other.exact")
            ),
        )
        .where(F.col("anchor") != "")
        .drop("window", "first", "other")
        .distinct()
        .withColumn("strong", F.collect_set(F.when(~weak, F.col("place"))).over(in_item))
        .withColumn("n_places", F.size(F.collect_set("place").over(in_item)))
        .withColumn("n_windows", F.size("strong"))
        .withColumn("extra", ~F.array_contains("strong", F.col("place")))
        .drop("strong")
    )


def in_blocks(small: DataFrame, on: str, join) -> DataFrame:
    """Union of ``join(block)`` over blocks of ``small`` that may be broadcast: rows of a
    block have one hash of ``on``, and a block has about ``BLOCK`` rows."""
    blocks = max(1, -(-small.count() // BLOCK))
    part = F.pmod(F.xxhash64(on), F.lit(blocks))
    return reduce(
        DataFrame.unionByName,
        [join(F.broadcast(small.where(part == i) if blocks > 1 else small)) for i in range(blocks)],
    )


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    doc_key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    width: int = 8,
    literals: int = 5,
    verbatim: bool = False,
) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds a passage, perhaps with
    other numbers, names or units.

    Returns doc_key, item_key, n_passages (alignments of the two), n_windows (largest
    number of the item's windows in one alignment), coverage (their share), n_changed
    (placeholders with another value in that alignment). The values behind placeholders
    must map one to one within an alignment; else it is no re-parameterised copy. With
    ``verbatim``, as queries and pipeline call it, such an alignment still has its windows
    whose placeholders all hold equal values, and n_changed is 0 then; without it they go too.
    Windows with few literal words match only with equal values. They count in the share
    where they are found, or if the item has no others.
    Null and empty texts match nothing; rows with a null key are left out; repeated
    documents are judged each; other columns are not read.
    """
    windows = settle(benchmark_windows(benchmark, item_key, text, width, literals))
    anchors = windows.select("anchor", "at", "second", "at2", "n_words").distinct()
    # Key names of our own, so that other columns cannot clash.
    docs = documents.select(F.col(doc_key).alias("doc_id"), F.col(text).alias("text")).where(
        F.col("doc_id").isNotNull()
    )
    worded = docs.select("doc_id", word_list(F.col("text")).alias("words"))
    # One generated stage explodes, probes and keeps: the array is not copied for each word.
    single = worded.select("doc_id", "words", F.posexplode("words").alias("pos", "word")).withColumn(
        "anchor", exact(F.col("word"))
    )

    def windows_at(anchors: DataFrame) -> DataFrame:
        begin = F.col("pos") - F.col("at")
        found = single.join(anchors, "anchor").where(
            (begin >= 0)
            & (begin + F.col("n_words") <= F.size("words"))
            & (F.col("second").isNull() | (exact(F.get("words", begin + F.col("at2"))) == F.col("second")))
        )
        # With the word before, which tells whether the first one starts a sentence.
        return found.select(
            "doc_id",
            begin.alias("begin"),
            F.get("words", begin - 1).alias("before"),
            F.slice("words", F.greatest(begin, F.lit(0)) + 1, F.col("n_words")).alias("window"),
        )

    # The few windows that hold an anchor in its place; written, so that what follows
    # is computed once for each.
    found = settle(in_blocks(anchors, "anchor", windows_at))
    before = F.col("before")
    starts = before.isNull() | before.rlike(SENTENCE_END)
    after_number = F.coalesce(F.btrim(before, F.lit(EDGES)).rlike(DIGITS), F.lit(False))
    # An item's window knows the number before it; a unit that begins the window does too.
    candidates = found.select(
        "doc_id",
        "begin",
        F.array_join(F.transform("window", exact), " ").alias("exact"),
        kinds(F.col("window"), starts, after_number).alias("window"),
    ).select(
        "exact",
        "doc_id",
        "begin",
        F.array_join(F.transform("window", lambda x: x.form), " ").alias("template"),
        F.filter("window", lambda x: is_slot(x.form)).alias("doc_values"),
    )

    def same_template(windows: DataFrame) -> DataFrame:
        return matched(candidates.join(windows, "template"), F.arrays_zip("values", "doc_values"))

    def same_words(windows: DataFrame) -> DataFrame:
        words = candidates.drop("template").withColumnRenamed("exact", "template")
        return matched(words.join(windows, "template"), F.slice(F.arrays_zip("values", "doc_values"), 1, 0))

    def matched(rows: DataFrame, slots: Column) -> DataFrame:
        shift = (F.col("begin") - F.col("place")).alias("shift")
        return rows.select("doc_id", "item_id", "n_windows", "n_places", "place", "weak", "extra", shift, slots.alias("slots"))

    def differ(slot: Column) -> Column:
        return slot["values"].value != slot["doc_values"].value

    # Weak windows are joined by their words, so that all their values are equal.
    weak = windows.where("weak")
    matches = in_blocks(windows.where("NOT weak"), "template", same_template)
    if not weak.isEmpty():
        matches = matches.unionByName(in_blocks(weak, "template", same_words))
    matches = matches.withColumn("equal", F.col("weak") | (F.lit(verbatim) & ~F.exists("slots", differ)))
    pairs = F.flatten(F.collect_set("slots"))  # at most the item's windows times their width
    one_to_one = (F.col("ours") == F.size("slots")) & (F.col("theirs") == F.size("slots"))
    aligned = (
        matches.groupBy("doc_id", "item_id", "shift")
        .agg(
            F.first("n_windows").alias("n_windows"),
            F.first("n_places").alias("n_places"),
            F.size(F.collect_set(F.when(F.col("extra"), F.col("place")))).alias("n_extra"),
            F.size(F.collect_set("place")).alias("n_all"),
            F.size(F.collect_set(F.when(F.col("equal"), F.col("place")))).alias("n_equal"),
            F.array_distinct(pairs).alias("slots"),
        )
        .withColumn("ours", F.size(F.array_distinct(F.transform("slots", lambda s: s["values"]))))
        .withColumn("theirs", F.size(F.array_distinct(F.transform("slots", lambda s: s["doc_values"]))))
        .withColumn("n", F.when(one_to_one, F.col("n_all")).otherwise(F.col("n_equal")))
        .where(F.col("n") > 0)
        .withColumn("of", F.when(F.col("n_windows") > 0, F.col("n_windows") + F.col("n_extra")).otherwise(F.col("n_places")))
        .withColumn("changed", F.when(one_to_one, F.size(F.filter("slots", differ))).otherwise(0))
    )
    best = F.max(F.struct("n", (-F.col("changed")).alias("kept"), "of"))
    return (
        aligned.groupBy("doc_id", "item_id")
        .agg(F.count(F.lit(1)).alias("n_passages"), best.alias("best"))
        .select(
            F.col("doc_id").alias(doc_key),
            F.col("item_id").alias(item_key),
            "n_passages",
            F.col("best.n").alias("n_windows"),
            (F.col("best.n") / F.col("best.of")).alias("coverage"),
            (-F.col("best.kept")).cast("int").alias("n_changed"),
        )
    )
