import re

import corpus_pipeline
from loanlens.llm import templates
from loanlens.llm.queries import QUERIES

ITEM = "Alice told Bob that 12 apples weigh 3 kg when the basket holds exactly seven ripe yellow pears today."


def pairs(frame, docs, items):
    bench = frame(items).withColumnRenamed("doc_id", "item_id")
    return {(r.doc_id, r.item_id): r for r in templates.contaminated(frame(docs), bench).collect()}


def test_other_numbers_names_and_units_are_caught(frame):
    docs = [
        (1, "Start here. " + ITEM + " The end."),
        (2, ITEM.replace("12", "99").replace("3 kg", "5 lb").replace("Bob", "Carol")),
        (3, "quoted in a sentence " + ITEM.upper().lower()),
        (4, "Nothing of this kind is in here, 12 apples or not."),
        (5, "that 12 apples weigh 3 kg"),
        (6, None),
        (7, ""),
        (8, "filler " * 50_000 + ITEM),
        (9, ITEM),
        (9, ITEM),
        (None, ITEM),
    ]
    got = pairs(frame, docs, [(1, ITEM), (2, None), (3, ""), (None, ITEM), (4, "short one, 5 words only")])
    assert {d for d, _ in got} == {1, 2, 3, 8, 9} and {i for _, i in got} == {1}
    assert got[1, 1].coverage == 1 and got[1, 1].n_changed == 0
    assert got[2, 1].coverage == 1 and got[2, 1].n_changed == 4


def test_values_must_map_one_to_one(frame):
    item = "If 4 red boxes and 9 blue boxes and 4 green boxes stand near the wall then count"
    fine = item.replace("4", "7")
    mixed = item.replace("4 green", "5 green")
    merged = item.replace("9", "4")
    got = pairs(frame, [(1, fine), (2, mixed), (3, merged)], [(1, item)])
    assert (1, 1) in got
    # The parts of it that hold one of the numbers only are no proof of the whole.
    assert (2, 1) not in got and (3, 1) not in got


def test_equal_windows_stay_where_others_break_the_map(frame):
    item = "If 4 red boxes and 9 blue boxes and 4 green boxes stand near the wall then count"
    docs = [(1, item.replace("4 green", "5 green")), (2, item.replace("4", "7").replace("7 green", "5 green").replace(" count", "")), (3, item)]
    bench = frame([(1, item)]).withColumnRenamed("doc_id", "item_id")
    got = {r.doc_id: r for r in templates.contaminated(frame(docs), bench, verbatim=True).collect()}
    # Windows 0, 1 and 10 of document 1 are the item's; document 2 has none such.
    assert set(got) == {1, 3}
    assert (got[1].n_windows, got[1].n_changed, got[1].coverage) == (3, 0, 3 / 11)
    assert (got[3].n_windows, got[3].coverage) == (11, 1)


def test_pipeline_drops_a_passage_with_one_number_changed(spark, sf_dir, tmp_path):
    item = "If 4 red boxes and 9 blue boxes and 4 green boxes stand near the wall then count"
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    rows = [(1, item.replace("4 green", "5 green"), "en", "s", 80), (2, "The wall is green.", "en", "s", 18)]
    docs = spark.createDataFrame(rows, documents.schema)
    assert [r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()] == [2]


def test_short_items_match_as_a_whole(frame):
    got = pairs(frame, [(1, "x y what is the answer z"), (2, "what is the")], [(5, "What is the answer?")])
    assert set(got) == {(1, 5)}


def test_items_of_few_literal_words_are_found_verbatim(frame):
    items = [
        (1, "What is 48 divided by 6 ?"),
        (2, "Who wrote Hamlet?"),
        (3, "Which Planet Is Known As The Red Planet?"),
        (4, "Compute 12 + 7 * 3 - 9 / 2 + 4 ."),
        (5, "48 6 12 7"),
        (6, "+ - * /"),
    ]
    docs = [(i, f"so he asked: {text} and went") for i, text in items]
    docs += [(10 + i, f"then {text} and went") for i, text in items]
    # Other values or signs are other questions here.
    docs += [(21, "What is 49 divided by 6 ?"), (22, "Who wrote Faust?"), (24, "Compute 12 + 7 * 3 + 9 / 2 + 4 .")]
    want = {(k, i) for i, _ in items for k in (i, 10 + i)}
    got = pairs(frame, docs, items)
    assert set(got) == want and all(r.coverage == 1 and r.n_changed == 0 for r in got.values())


def test_blocks_give_the_same(frame, monkeypatch):
    docs = [(1, ITEM), (2, "nothing else in it but words of another kind and length")]
    whole = pairs(frame, docs, [(1, ITEM)])
    monkeypatch.setattr(templates, "BLOCK", 2)
    assert pairs(frame, docs, [(1, ITEM)]) == whole


def test_empty(frame):
    assert pairs(frame, [], [(1, ITEM)]) == {} and pairs(frame, [(1, ITEM)], []) == {}


def test_query_finds_what_word_windows_find(spark, sf_dir):
    """Passages of eight equal words, found by brute force, are all found."""

    def words(text):
        return [w for w in re.split(r"[ \t\n\r\f\v]+", text or "") if w]

    def windows(text):
        plain = [w.strip(templates.EDGES).lower() for w in words(text)]
        return {tuple(plain[i : i + 8]) for i in range(len(plain) - 7)}

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    owner = {}
    for b in items:
        for w in windows(b.text):
            owner.setdefault(w, set()).add(b.item_id)
    want = {(d.doc_id, i) for d in docs for w in windows(d.text) & owner.keys() for i in owner[w]}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op8_template_leaks"](spark, sf_dir).collect()}
    assert want and want <= got and len(got) <= len(want) + 2


def test_main_path_has_no_python(spark, sf_dir):
    plan = QUERIES["op8_template_leaks"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
