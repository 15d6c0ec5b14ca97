"""Operator 10: preference pairs as one prompt and two masked completions.

A pair is a chosen and a rejected conversation (arrays of turns). Their longest common turn prefix is
rendered once as the prompt; what differs is rendered twice as completions. ``spans`` are the ranges
of a completion that count for the loss: texts and end marks of assistant turns, in code points from
the start of the completion; all else is masked.

``swapped_answers`` makes pairs of a plain table of conversations: a conversation up to its last
assistant turn is chosen, and the same with the last answer of the next conversation (by conv_id,
after the last the first) is rejected.

Everything is built-in functions; a conversation is one row, so its turns are gathered and nothing else.

Defined cases: null texts and roles are empty ones; rows without a conv_id belong to none; repeated
turns count once; turns of equal number are ordered by role and text; equal conversations give empty
completions; a conversation without an assistant turn is in no pair; a single conversation is paired
with itself; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark.llm import shared

START, BREAK, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def _turn(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit(BREAK), turn["text"], F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def spans(turns: Column) -> Column:
    """'begin-end' of the trained ranges, joined by commas."""
    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(turn["role"]) + len(START) + len(BREAK)
        end = begin + F.length(turn["text"]) + len(END)
        said = F.array(F.concat_ws("-", begin, end))
        return F.struct(end.alias("at"), F.when(turn["role"] == TRAINED, F.concat(state["said"], said)).otherwise(state["said"]).alias("said"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("said"))
    return F.aggregate(turns, none, step, lambda state: F.array_join(state["said"], ","))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(n).cast("int")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans) of (pair_id, chosen, rejected) with arrays of (role, text)."""
    cut = pairs.withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c), F.lit(1)))
    a, b = rest(F.col("chosen")), rest(F.col("rejected"))
    return cut.select("pair_id", "prompt_turns", rendered(F.slice("chosen", 1, F.col("prompt_turns"))).alias("prompt"),
                      rendered(a).alias("chosen"), spans(a).alias("chosen_spans"), rendered(b).alias("rejected"), spans(b).alias("rejected_spans"))


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) for every conversation with an assistant turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text")).distinct()
    whole = turns.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = whole.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    last = F.size("turns") - F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"]), TRAINED) + 1
    whole = whole.where(F.exists("turns", lambda t: t["role"] == TRAINED)).withColumn("chosen", F.slice("turns", 1, last.cast("int"))).select("pair_id", "chosen")
    whole = shared.written(whole, "conversations")

    n = shared.partitions(whole.sparkSession)
    ids = whole.select("pair_id")
    bounds = shared.range_bounds(ids, "pair_id", n)
    ids = ids.withColumn("bucket", shared.range_bucket("pair_id", bounds))
    heads = {r.bucket: r.head for r in ids.groupBy("bucket").agg(F.min("pair_id").alias("head")).collect()}      # one id for each bucket
    order = sorted(heads)
    after = {b: heads[order[(i + 1) % len(order)]] for i, b in enumerate(order)}
    following = F.array(*[F.lit(after.get(b)).cast("long") for b in range(len(bounds) + 1)])
    following = F.coalesce(F.lead("pair_id").over(Window.partitionBy("bucket").orderBy("pair_id")), F.get(following, F.col("bucket")))
    ids = ids.select("pair_id", following.alias("next_id"))
    answers = whole.select(F.col("pair_id").alias("next_id"), F.slice("chosen", -1, 1).alias("answer"))
    both = whole.join(ids, "pair_id").join(answers, "next_id")
    return both.select("pair_id", "chosen", F.concat(F.slice("chosen", 1, F.size("chosen") - 1), "answer").alias("rejected"))
