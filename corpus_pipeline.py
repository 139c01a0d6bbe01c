"""The document pipeline: five stages, each written as Parquet and reread by the next.

1. Language ID: documents whose language cannot be told go.
2. Similarity join: of each group of near copies one document stays.
3. Decontamination: documents with a passage of the benchmark go.
4. Personal data: spans are replaced by their kind.
5. Packing: the documents that are left are cut and packed into batches.

All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm import jaccard, langid, packing, pii, templates
from loanlens.llm.common import looked_up, table, unused, word_count
from loanlens.session import settle

#: Probability of the best language below which a text has none.
LEAST_SCORE = 0.5


#: Texts that go to Python at once. Spark and Python both hold a batch, and texts are long.
BATCH_ROWS = 1_000


def lean(spark: SparkSession) -> None:
    """Sets the batch size for the job's session; a stage is run after its function returns."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shielded(docs: DataFrame) -> DataFrame:
    """Columns whose names begin as those that operators add, under other names."""
    return docs.withColumnsRenamed({c: f"own{c}" for c in docs.columns if c.startswith("_")})


def restored(found: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of documents, under their names."""
    return found.select(
        *[(changed.get(c) if c in changed else F.col(f"`own{c}`" if c.startswith("_") else f"`{c}`")).alias(c) for c in docs.columns]
    )


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their own, written, so that every reader sees the same."""
    (row,) = unused(docs, "_row")
    return settle(docs.withColumn(row, F.monotonically_increasing_id())), row


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that can be told; a null or letterless text has none.
    Repeated rows share their fate; every row counts, whatever its doc_id."""
    lean(spark)
    found = langid.identified(shielded(docs))
    known = (F.col("_language.lang_pred") != langid.UNKNOWN) & (F.col("_language.score") >= LEAST_SCORE)
    return restored(found.where(known), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that links connect: that of the smallest known doc_id, or
    else any.

    Rows are told apart by a key of their own. So unlike texts under one doc_id stay, and
    rows without a doc_id are compared as others are. Rows without words have no group.
    """
    rows, row = with_row(docs)
    classes = jaccard.similarity_classes(rows.select(row, "text"), key=row)
    groups = classes.groupBy("component_id").count().where("count > 1").select("component_id")
    members = settle(classes.join(groups, "component_id").join(rows.select(row, "doc_id"), row).select("component_id", row, "doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", row))[row].alias("stays")
    stays = members.groupBy("component_id").agg(first)
    later = members.join(stays, "component_id").where(F.col(row) != F.col("stays")).select(row)
    return without(rows, later, row).select(*docs.columns)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(looked_up(gone), key, "left_anti")


#: Windows of eight words that a document must share with an item in one place, unless it
#: holds the whole item: less is a turn of phrase.
LEAST_WINDOWS = 3


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a passage of a benchmark item, re-parameterised or not: ten
    words of it in a row or so, or the whole of a shorter one. Rows are judged each, also
    those without a doc_id; null and empty texts stay."""
    rows, row = with_row(docs)
    leaks = templates.contaminated(rows.select(row, "text"), table(spark, sf_dir, "benchmark"), doc_key=row, verbatim=True)
    passages = leaks.where((F.col("n_windows") >= LEAST_WINDOWS) | (F.col("coverage") >= 1))
    return without(rows, passages.select(row).distinct(), row).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts; n_chars follows where something was replaced. Null
    and empty texts stay as they are, repeated rows get the same."""
    lean(spark)
    found = pii.personal_data(shielded(docs))
    text = pii.redacted(F.col("text"), F.col("_spans"))
    length = F.when(F.size("_spans") > 0, F.length(text).cast("bigint")).otherwise(F.col("n_chars"))
    return restored(found, docs, text=text, n_chars=length.cast(dict(docs.dtypes)["n_chars"]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bucket, batch and slot; a null or empty text is one
    empty piece, repeated rows are packed as often as they occur."""
    return packing.pack_buckets(docs, "doc_id", word_count(F.col("text")))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("pii", redact),
    ("packing", pack),
]

#: Language models and a trained classifier decide in it, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
