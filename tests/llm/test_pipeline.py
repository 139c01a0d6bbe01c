from pyspark.sql import functions as F

import corpus_pipeline
from loanlens.session import settle


def test_stages_by_planted_documents(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    body = "the man went over to the old river and saw that the small boat was gone from the water again"
    planted = [
        (10**9 + 1, None), (10**9 + 2, "#### 1234 $$$"), (10**9 + 3, body), (10**9 + 4, body), (10**9 + 4, body),
        (10**9 + 5, "so here it is " + item), (10**9 + 6, "write to someone@mail7.example.com about the house of the king"),
    ]
    rows = [(i, t, None, "planted", len(t or "")) for i, t in planted]
    docs = settle(documents.unionByName(spark.createDataFrame(rows, documents.schema)))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == documents.columns and out.dtypes == documents.dtypes
        docs = settle(out)
        kept[name] = {r.doc_id - 10**9 for r in docs.where("source = 'planted'").collect()}
    assert kept == {
        "language_id": {3, 4, 5, 6},
        "ngram_jaccard_join": {3, 5, 6},
        "benchmark_decontamination": {3, 6},
        "pii": {3, 6},
    }
    mail = docs.where(F.col("doc_id") == 10**9 + 6).first()
    assert "<EMAIL>" in mail.text and "@" not in mail.text and mail.n_chars == len(mail.text)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()
    # Clean documents stay: what goes are copies, leaks and nothing else.
    assert docs.count() > 0.7 * documents.count()


def test_an_empty_table_passes_all_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    assert docs.count() == 0


STOCK = "which of the following is the most likely"


def test_rows_are_told_apart_whatever_their_doc_id(spark, sf_dir):
    """Unlike texts under one id stay, copies without an id go, leaks without an id go, and
    columns that are called like those of operators come through."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    item = max((r.text for r in benchmark.collect()), key=len)
    base = "the man went over to the old river and saw that the small boat was gone from the water again"
    other = "there is no way that the house of the king could have been seen from the other side of the hill"
    rows = [(1, base), (1, other), (None, base + " x"), (None, "so here it is " + item), (None, None), (7, ""), (7, ""), (8, "write to a@mail7.example.com " + other[:20])]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, _spans string, _row string, _language int, `own_x` int"
    docs = settle(spark.createDataFrame([(i, t, "en", "s", len(t or ""), "mine", "r", 5, 6) for i, t in rows], columns))
    stages = dict(corpus_pipeline.STAGES)
    near = settle(stages["ngram_jaccard_join"](spark, docs, sf_dir))
    assert sorted((r.doc_id or 0, r.text or "") for r in near.collect()) == sorted((i or 0, t or "") for i, t in rows if t != base + " x")
    clean = settle(stages["benchmark_decontamination"](spark, near, sf_dir))
    assert clean.count() == near.count() - 1 and clean.where(F.col("text").startswith("so here")).count() == 0
    found = settle(stages["pii"](spark, clean, sf_dir))
    known = stages["language_id"](spark, found, sf_dir)
    for out in (near, clean, found, known):
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.where("_spans <> 'mine' OR _row <> 'r' OR _language <> 5 OR own_x <> 6").count() == 0
    assert found.where("text LIKE '%<EMAIL>%' AND n_chars = length(text)").count() == 1


def test_stock_phrases_are_clean_and_short_items_are_not(spark, sf_dir, tmp_path):
    items = [(1, f"Tell me {STOCK} cause of the fire in the old mill by the river at night ?"), (2, "What is 48 divided by 6 ?")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [f"He asked {STOCK} outcome of all this .", f"He said : tell me {STOCK} cause of the fire in the old mill", "So What is 48 divided by 6 ? he said"]
    docs = spark.createDataFrame([(i, t, None, None, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert [r.doc_id for r in kept.collect()] == [0]
