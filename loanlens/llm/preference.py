"""Preference pairs as one prompt and two masked completions.

A pair is two conversations, one chosen and one rejected, which meet in one shuffle. Their
longest common prefix of turns, found by comparing turns of equal position, is the prompt and is rendered once;
the turns after it are the completions. Only what an assistant says in a completion is
trained on: its characters are listed as mask spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The form of a rendered turn.
OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "\n"
ASSISTANT = "assistant"


def heading(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(AFTER_ROLE))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(heading(role), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def common_turns(one: Column, other: Column) -> Column:
    """Number of first turns that two arrays of turns share; null and empty are equal."""

    def equal(a: Column, b: Column) -> Column:
        fields = [F.coalesce(a[f], F.lit("")) == F.coalesce(b[f], F.lit("")) for f in ("role", "text")]
        return a.isNotNull() & b.isNotNull() & fields[0] & fields[1]

    same = F.zip_with(one, other, equal)
    first_other = F.array_position(same, F.lit(False))
    return F.when(first_other == 0, F.size(same)).otherwise(first_other - 1).cast("int")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen, rejected, n_prompt_turns, and for each completion
    its number of turns and its mask, spans [start, end) of characters in the completion.

    ``turns``: pair_id, side, turn, role, text. Turns of a side are ordered by turn, then
    role and text; equal rows are turns of their own. Null roles and texts are empty ones.
    Rows with a null pair or with another side are left out, as are pairs without both
    sides and pairs of equal conversations, which prefer nothing. Other columns are not
    read. A completion is one training example and so one row.
    """
    known = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
    turn = F.struct("turn", "role", "text")

    def of_side(name: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("side") == name, turn)))

    # One shuffle: both sides of a pair meet, and what follows reads their arrays.
    both = known.groupBy("pair_id").agg(of_side("chosen").alias("one"), of_side("rejected").alias("other"))
    n = F.col("n_prompt_turns")
    compared = (
        both.where((F.size("one") > 0) & (F.size("other") > 0))
        .withColumn("n_prompt_turns", common_turns(F.col("one"), F.col("other")))
        .where((n < F.size("one")) | (n < F.size("other")))
    )

    def part(turns: Column) -> Column:
        return F.transform(
            turns,
            lambda t: F.struct(
                heading(t["role"]).alias("head"),
                rendered(t["role"], t["text"]).alias("turn_text"),
                (t["role"] == ASSISTANT).alias("learn"),
            ),
        )

    pairs = compared.select(
        "pair_id",
        "n_prompt_turns",
        part(F.slice("one", 1, n)).alias("_prompt"),
        part(F.slice("one", n + 1, F.size("one"))).alias("_chosen"),
        part(F.slice("other", n + 1, F.size("other"))).alias("_rejected"),
    )

    def text_of(part: str) -> Column:
        return F.array_join(F.transform(part, lambda t: t.turn_text), "")

    def mask_of(part: str) -> Column:
        """The text of assistant turns with its end mark, without the heading."""
        start = F.lit(0).cast("int")
        empty = F.array().cast("array<struct<start:int,end:int>>")
        walked = F.aggregate(
            part,
            F.struct(start.alias("at"), empty.alias("spans")),
            lambda acc, t: F.struct(
                (acc.at + F.length(t.turn_text)).cast("int").alias("at"),
                F.when(
                    F.coalesce(t.learn, F.lit(False)),
                    F.concat(
                        acc.spans,
                        F.array(
                            F.struct(
                                (acc.at + F.length(t["head"])).cast("int").alias("start"),
                                (acc.at + F.length(t.turn_text)).cast("int").alias("end"),
                            )
                        ),
                    ),
                )
                .otherwise(acc.spans)
                .alias("spans"),
            ),
        )
        return walked.spans

    return pairs.select(
        "pair_id",
        F.col("n_prompt_turns").cast("bigint").alias("n_prompt_turns"),
        text_of("_prompt").alias("prompt"),
        text_of("_chosen").alias("chosen"),
        text_of("_rejected").alias("rejected"),
        F.size("_chosen").cast("bigint").alias("n_chosen_turns"),
        F.size("_rejected").cast("bigint").alias("n_rejected_turns"),
        mask_of("_chosen").alias("chosen_mask"),
        mask_of("_rejected").alias("rejected_mask"),
    )


def regenerated(conversations: DataFrame) -> DataFrame:
    """Pairs from a table of conversations (conv_id, turn, role, text), where each stands
    against itself with the last answer taken from the next conversation.

    Chosen is the conversation; rejected has, in place of its last assistant turn, the
    last one of conversation conv_id + 1 (an empty text, if there is none), and nothing
    after it. A conversation without an assistant turn makes no pair.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    answer = F.max(F.when(F.col("role") == ASSISTANT, F.struct("turn", "text")))
    marked = rows.withColumn("last", answer.over(Window.partitionBy("conv_id"))).where(F.col("last").isNotNull())
    other = rows.groupBy((F.col("conv_id") - 1).alias("conv_id")).agg(answer["text"].alias("answer"))
    at, is_last = F.col("last.turn"), F.col("turn") == F.col("last.turn")
    kept = (F.col("turn") < at) | (is_last & (F.col("role") == ASSISTANT)) | F.col("turn").isNull()
    chosen = F.col("side") == "chosen"
    text = F.when(~chosen & is_last, F.coalesce("answer", F.lit(""))).otherwise(F.col("text"))
    # The rows stay where the window put them until the pairs are gathered.
    return (
        marked.join(other, "conv_id", "left")
        .withColumn("side", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))))
        .where(chosen | kept)
        .select(F.col("conv_id").alias("pair_id"), "turn", "role", text.alias("text"), "side")
    )
