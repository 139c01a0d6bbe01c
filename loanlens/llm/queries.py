"""The queries of this subpackage, over whole tables with production parameters, and
their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm import hilbert, jaccard, langid, packing, pii, preference, repair, rollup, runs, templates, urlfilter, vptree, warc
from loanlens.llm.common import WORD, table, word_count
from loanlens.llm.oracles import ORACLES  # noqa: F401
from loanlens.session import new_path, settle, small_frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def packed(documents: DataFrame) -> DataFrame:
    return packing.pack_buckets(documents, "doc_id", word_count(F.col("text")))


@query
def op1_length_buckets(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))


@query
def op2_hilbert_shards(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8
    return hilbert.hilbert_shards(
        documents,
        {"source": F.col("source"), "lang": F.col("lang"), "log_bytes": F.log2(size)},
        [F.col("doc_id"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")],
        order=["doc_id", "size", "text_crc32"],
        shards=24,
    ).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


@query
def op3_vantage_points(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


@query
def op4_marginal_language(spark, sf_dir):
    return langid.identified(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("_held_out").alias("held_out"), "_language.lang_pred", "_language.score"
    )


@query
def op5_warc_transactions(spark, sf_dir):
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    captures = warc.captures(warc.read_archives(spark, path))
    response = F.col("response")
    # The digest of what was read, where the payload itself is in the archive.
    digest = F.coalesce(warc.base32_sha1(response.payload), response.payload_digest)
    return captures.select(
        "page_id",
        response.payload_bytes.alias("payload_bytes"),
        digest.alias("payload_digest"),
        response.type.alias("record_type"),
        F.col("refers_to_page").alias("refers_to"),
        (F.col("request.record_id").isNotNull() & F.col("metadata.record_id").isNotNull()).alias("is_complete"),
    )


@query
def op6_jaccard_classes(spark, sf_dir):
    return jaccard.similarity_classes(table(spark, sf_dir, "documents"))


@query
def op7_weak_supervision(spark, sf_dir):
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("_spans", lambda s: s.base)
    counts = [pii.count_of(base, kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("_spans")).alias("spans")
    )


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return templates.contaminated(documents, benchmark, verbatim=True)


@query
def op8_template_leaks(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Second tokenizer version: letter runs, up to three digits, or other signs.
PIECES = r"\p{L}+|\p{N}{1,3}|[^\p{L}\p{N}\x20\x09-\x0D]+"


@query
def op9_token_rollup(spark, sf_dir):
    """Documents arrive in two batches, one of which is delivered twice; every tenth is
    withdrawn; every third is recounted with a newer tokenizer version."""
    documents = table(spark, sf_dir, "documents")
    text, key = F.col("text"), F.coalesce(F.col("doc_id"), F.lit(0))
    both = settle(
        documents.select(
            "doc_id",
            "source",
            "lang",
            word_count(text).alias("words"),
            F.coalesce(F.regexp_count(text, F.lit(PIECES)), F.lit(0)).alias("pieces"),
        )
    )
    old = rollup.counted(both, "words-1", F.col("words"))
    new = rollup.counted(both, "pieces-2", F.col("pieces"))
    store = rollup.Rollup(spark, new_path(spark, "rollup"))
    store.commit("0001", rollup.inserts(old.where(key % 2 == 0)))
    store.commit("0002", rollup.inserts(old.where(key % 2 != 0)))
    store.commit("0001", rollup.inserts(old.where(key % 2 == 0)))
    store.commit("0003", rollup.deletes(old.where(key % 10 == 0)))
    changed = (key % 10 != 0) & (key % 3 == 0)
    store.commit("0004", rollup.revisions(old.where(changed), new.where(changed)))
    return store.totals()


@query
def op10_preference_pairs(spark, sf_dir):
    pairs = preference.preference_pairs(preference.regenerated(table(spark, sf_dir, "conversations")))
    # The spans of the masks as text.
    span = lambda s: F.concat_ws("-", s.start.cast("string"), s["end"].cast("string"))
    masks = ("chosen_mask", "rejected_mask")
    return pairs.withColumns({m: F.array_join(F.transform(m, span), ",") for m in masks})


#: Host, path and verdict.
RULES = [
    ("net", "/", urlfilter.BLOCK),
    ("example.net", "/en/", urlfilter.ALLOW),
    ("example.com", "/de/", urlfilter.BLOCK),
    ("org", "/fr/", urlfilter.ALLOW),
]


@query
def op11_url_digests(spark, sf_dir):
    rules = small_frame(spark, RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judged(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def planted(documents: DataFrame) -> DataFrame:
    """In each tenth document, by its id, the words from some place on repeat themselves."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    start = "g % size(words)"
    rows = documents.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("a", F.expr(f"CASE WHEN size(words) > 0 THEN {start} END"))
    rows = rows.withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    again = "array_join(transform(words, (w, i) -> IF(i < a, w, words[CAST(a + (i - a) % p AS INT)])), ' ')"
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.expr(again)).otherwise(F.col("text")).alias("text"))


@query
def op12_tiled_runs(spark, sf_dir):
    documents = planted(table(spark, sf_dir, "documents"))
    found = runs.periodic_runs(documents, {"collapsed_sha256": lambda text: F.sha2(text, 256)})
    listed = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    text = F.concat_ws("", F.transform(listed, lambda r: F.concat(r, F.lit("\n"))))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("n"), (-r.start).alias("s"), (-r.period).alias("p"))))
    found = found.withColumn("top", top)
    length, period = F.col("top.n"), -F.col("top.p")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults that the checksum of conversation and turn decides."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.expr("array_repeat(0, times)"))).drop("col")


@query
def op13_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    found = repair.report(repair.repaired_chunks(damaged(conversations))).withColumnRenamed("conv_id", "_conv")
    ids = conversations.select("conv_id").distinct()
    every = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", *repair.FAULTS, "illegal", "cost")]
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), digest)
