import pytest
from pyspark.sql import functions as F

from loanlens.llm import rollup
from loanlens.llm.common import word_count
from loanlens.session import new_path


def totals(store):
    return sorted(tuple(r) for r in store.totals().collect())


def test_inserts_deletes_revisions_and_retries(frame, spark):
    docs = frame([(1, "a b"), (2, "c"), (3, None), (4, "x " * 100_000), (4, "x"), (None, "")])
    old = rollup.counted(docs, "v1", word_count(F.col("text")))
    store = rollup.Rollup(spark, new_path(spark, "rollup-test"))
    store.commit("a", rollup.inserts(old))
    assert totals(store) == [("s", "en", "v1", 6, 100_004)]
    store.commit("a", rollup.inserts(old))  # delivered twice
    assert totals(store) == [("s", "en", "v1", 6, 100_004)]
    store.commit("b", rollup.deletes(old.where("doc_id = 2")))
    new = rollup.counted(docs, "v2", F.length("text"))
    store.commit("c", rollup.revisions(old.where("doc_id = 1"), new.where("doc_id = 1")))
    want = [("s", "en", "v1", 4, 100_001), ("s", "en", "v2", 1, 3)]
    assert totals(store) == want
    assert not store.commit("c", rollup.revisions(old.where("doc_id = 1"), new.where("doc_id = 1")))
    store.compact("all")
    assert totals(store) == want and store.batches().count() == 2 and list(store.entries()) == ["all"]
    # A batch that was folded is delivered again, then another one comes.
    assert not store.commit("a", rollup.inserts(old))
    assert totals(store) == want
    with pytest.raises(ValueError, match="other rows"):
        store.commit("b", rollup.inserts(old))
    assert store.commit("d", rollup.inserts(old.where("doc_id = 2")))
    store.compact("again")
    assert totals(store) == [("s", "en", "v1", 5, 100_002), ("s", "en", "v2", 1, 3)]
    assert not store.commit("a", rollup.inserts(old)) and not store.commit("d", rollup.inserts(old.where("doc_id = 2")))
    with pytest.raises(ValueError, match="known"):
        store.compact("a")
    assert totals(rollup.Rollup(spark, store.path)) == [("s", "en", "v1", 5, 100_002), ("s", "en", "v2", 1, 3)]


def test_a_lost_writer_changes_nothing(frame, spark, monkeypatch):
    counts = rollup.counted(frame([(1, "a b")]), "v1", word_count(F.col("text")))
    store = rollup.Rollup(spark, new_path(spark, "rollup-test"))
    assert totals(store) == [] and store.entries() == {}
    monkeypatch.setattr(rollup.Rollup, "_publish", lambda self, entry: 1 / 0)
    for change in (lambda: store.commit("a", rollup.inserts(counts)), lambda: store.compact("b")):
        with pytest.raises(ZeroDivisionError):
            change()
    monkeypatch.undo()
    assert totals(store) == []
    assert store.commit("a", rollup.inserts(counts)) and totals(store) == [("s", "en", "v1", 1, 2)]
    with pytest.raises(ValueError, match="name"):
        store.commit("a/b", rollup.inserts(counts))


def test_groups_that_cancel_out_and_nulls(frame, spark):
    docs = frame([(1, "a")], source=None, lang=None)
    counts = rollup.counted(docs, "v1", word_count(F.col("text")))
    store = rollup.Rollup(spark, new_path(spark, "rollup-test"))
    store.commit("empty", rollup.inserts(counts.limit(0)))
    assert totals(store) == []
    store.commit("a", rollup.inserts(counts))
    assert totals(store) == [(None, None, "v1", 1, 1)]
    store.commit("b", rollup.deletes(counts))
    assert totals(store) == []
