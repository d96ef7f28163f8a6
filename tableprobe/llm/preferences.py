"""Preference formatting: the turns that a chosen and a rejected conversation share are the prompt.

The longest common prefix of turns (role and text) is rendered once; what follows on either side is
a completion, with the spans of its characters that are trained on: the texts of assistant turns and
the marks that end them. Roles, other turns and the prompt are masked.

A null text is empty, a null role `unknown`. Turns are in the order of their number, then role and
text, nulls first. Of equal conversations both completions are empty. A conversation without turns
has an empty prompt. Everything is DataFrame work; a conversation becomes one row, as its prompt is
one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_next

#: What stands before and after a turn's text.
HEAD, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
ASSISTANT = "assistant"


def conversations_of(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """`conv` and its `turns`, an array of (role, text) in order."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = turns.groupBy(F.col(id_col).alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return whole.withColumn("turns", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t.role, F.lit(MIDDLE), t.text, F.lit(END))), "")


def _trained(turns: Column) -> Column:
    """Spans (start, stop) of the characters of the rendered turns that are trained on."""
    frame = len(HEAD) + len(MIDDLE)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        text = state.at + frame + F.length(t.role)
        stop = text + F.length(t.text) + len(END)
        return F.struct(stop.alias("at"), F.when(t.role == ASSISTANT, F.array_append(
            state.spans, F.struct(text.alias("start"), stop.alias("stop")))).otherwise(state.spans).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s.spans)


def format_preferences(pairs: DataFrame) -> DataFrame:
    """The table's columns but `chosen` and `rejected` (arrays of (role, text)), with `prompt_turns`,
    `prompt`, the texts `chosen` and `rejected`, and their spans `chosen_trained`, `rejected_trained`."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    sides = pairs.withColumns({c: F.coalesce(c, none) for c in ("chosen", "rejected")})
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, False)
    counted = sides.withColumn("_shared", F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int"))
    rest = lambda c: F.slice(c, F.col("_shared") + 1, F.size(c))
    others = [F.col(f"`{c}`") for c in pairs.columns if c not in (
        "chosen", "rejected", "prompt", "prompt_turns", "chosen_trained", "rejected_trained")]
    return counted.select(
        *others, F.col("_shared").alias("prompt_turns"), _rendered(F.slice("chosen", F.lit(1), F.col("_shared"))).alias("prompt"),
        _rendered(rest("chosen")).alias("chosen"), _rendered(rest("rejected")).alias("rejected"),
        _trained(rest("chosen")).alias("chosen_trained"), _trained(rest("rejected")).alias("rejected_trained"))


def mismatched(conversations: DataFrame) -> DataFrame:
    """Pairs made of whole conversations (conv, turns): chosen is each up to its last assistant turn,
    rejected the same with that turn's text taken from the next conversation, by id, that has one.
    A conversation without an assistant turn is its own prompt."""
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t.role == ASSISTANT, i)))
    placed = conversations.withColumn("last", last)
    some = placed.where("last is not null").withColumn("answer", F.get("turns", F.col("last"))["text"])
    paired = with_next(some.withColumn("conv", F.col("conv").cast("bigint")), "conv", "answer", {"other": "answer"})
    pairs = paired.select(
        "conv", F.slice("turns", F.lit(1), F.col("last") + 1).alias("chosen"),
        F.array_append(F.slice("turns", F.lit(1), F.col("last")), F.struct(
            F.lit(ASSISTANT).alias("role"), F.col("other").alias("text"))).alias("rejected"))
    alone = placed.where("last is null").select(F.col("conv").cast("bigint").alias("conv"), F.col("turns").alias("chosen"),
                                                F.col("turns").alias("rejected"))
    return pairs.unionByName(alone)
