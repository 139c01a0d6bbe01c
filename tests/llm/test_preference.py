from loanlens.llm import preference

SCHEMA = "pair_id bigint, side string, turn bigint, role string, text string, place string, n_prompt int"


def pairs(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {r.pair_id: r for r in preference.preference_pairs(df).collect()}


def conversation(pair, side, *turns):
    return [(pair, side, i, role, text) for i, (role, text) in enumerate(turns)]


def test_prompt_is_the_longest_common_prefix(spark):
    u, a = ("user", "Hi"), ("assistant", "Yes é")
    rows = [
        *conversation(1, "chosen", u, a, ("user", "more"), ("assistant", "good")),
        *conversation(1, "rejected", u, a, ("user", "more"), ("assistant", "bad"), ("user", "eh"), ("assistant", "")),
        *conversation(2, "chosen", u),  # a prefix of the other side
        *conversation(2, "rejected", u, a),
        *conversation(3, "chosen", u, a),  # equal
        *conversation(3, "rejected", u, a),
        *conversation(4, "chosen", ("system", None), a),  # nothing shared
        *conversation(4, "rejected", u, a),
        *conversation(5, "chosen", u, a),  # one side only
        *conversation(None, "chosen", u),
        *conversation(6, "other", u),
    ]
    got = pairs(spark, rows)
    assert set(got) == {1, 2, 4}
    one = got[1]
    assert one.prompt == "<|user|>\nHi\n<|assistant|>\nYes é\n<|user|>\nmore\n" and one.n_prompt_turns == 3
    assert one.chosen == "<|assistant|>\ngood\n"
    assert [one.chosen[m.start : m.end] for m in one.chosen_mask] == ["good\n"]
    assert [one.rejected[m.start : m.end] for m in one.rejected_mask] == ["bad\n", "\n"]
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].n_rejected_turns) == (1, "", 1)
    assert (got[4].n_prompt_turns, got[4].prompt) == (0, "") and got[4].chosen.startswith("<|system|>\n\n")


def test_long_texts_repeated_turns_and_empty(spark):
    long = "z" * 300_000
    twice = [(1, "chosen", 0, "user", "q"), (1, "chosen", 0, "user", "q"), (1, "rejected", 0, "user", "q"), (1, "rejected", None, None, long)]
    got = pairs(spark, twice)[1]
    assert got.n_prompt_turns == 0 and got.n_chosen_turns == got.n_rejected_turns == 2 and long in got.rejected
    assert pairs(spark, []) == {}


def test_regenerated_swaps_the_last_answer(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "bye"), (2, 0, "assistant", "b0"), (2, 1, "assistant", "b1"), (3, 0, "user", "alone")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, side string")
    got = {r.pair_id: r for r in preference.preference_pairs(preference.regenerated(df)).collect()}
    assert set(got) == {1, 2}
    assert got[1].rejected == "<|assistant|>\nb1\n" and got[1].n_chosen_turns == 2
    assert got[2].rejected == "<|assistant|>\n\n" and got[2].chosen == "<|assistant|>\nb1\n"


def test_two_shuffles_of_the_turns(spark, sf_dir):
    """One by conversation, which the pairs keep, and one of the next conversation's answers."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        turns = preference.regenerated(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
        plan = preference.preference_pairs(turns)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2, plan
    assert plan.count("SortMergeJoin") == 1


def test_null_and_empty_turns_are_equal_but_keep_their_order(spark):
    rows = [(1, "chosen", 0, None, "a"), (1, "chosen", 0, "", "b"), (1, "chosen", 1, "assistant", None), (1, "chosen", 2, "user", "x")]
    rows += [(1, "rejected", 0, "", "a"), (1, "rejected", 0, "", "b"), (1, "rejected", 1, "assistant", "")]
    got = pairs(spark, rows)[1]
    assert got.n_prompt_turns == 3 and got.chosen == "<|user|>\nx\n" and got.rejected == ""
