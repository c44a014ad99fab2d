"""Preference pairs for chat training.

A pair is a chosen and a rejected conversation, arrays of (role, text).  Their
longest common prefix of turns is rendered once as the prompt; the turns behind
it are rendered as the two completions, in which assistant turns are trained on
and all others are masked.  A mask is an array of code point ranges (start, end)
of the completion.

``pairs_from_conversations`` makes pairs from one table of turns: the chosen
conversation is a conversation as it is; the rejected one ends, instead of with
its last assistant turn and what follows, with the last assistant turn of its
neighbour.  The neighbour is the next id that has an assistant turn, and the
first one for the last, so each side of the join is unique and no group grows,
whatever the ids are.  The order is found in ranges of ids; only the first id of
each range is collected.

Defined cases: null roles are ``user``, null texts empty; turns are ordered by
(turn, role, text), and equal rows of a conversation count once; rows without a
conversation id are left out; a conversation without an assistant turn, or the
only one with one, makes no pair; equal conversations give a prompt and two
empty completions, marked ``identical``; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"  # fixed values of the ChatML form


def _render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(f"{CLOSE}\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _masks(turns: Column) -> Column:
    """Ranges of the texts and end marks of assistant turns in the rendered turns."""

    def step(acc: Column, turn: Column) -> Column:
        head = acc["at"] + F.length(turn["role"]) + F.lit(len(OPEN) + 1)
        end = head + F.length(turn["text"]) + F.lit(len(CLOSE) + 1)
        more = F.when(turn["role"] == "assistant", F.array(F.struct(head.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], more).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, start, step)["spans"]


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, identical) of pairs (pair_id, chosen, rejected)."""
    both = F.least(F.size("chosen"), F.size("rejected"))
    same = F.when(both > 0, F.transform(F.sequence(F.lit(1), both), lambda i: F.element_at("chosen", i).eqNullSafe(F.element_at("rejected", i))))
    first_off = F.array_position(same, F.lit(False))
    df = pairs.withColumn("n_prompt_turns", F.when(both <= 0, 0).when(first_off == 0, both).otherwise(first_off.cast("int") - 1))
    rest = lambda c: F.slice(F.col(c), F.col("n_prompt_turns") + 1, F.greatest(F.size(c) - F.col("n_prompt_turns"), F.lit(0)))
    df = df.withColumns({"_c": rest("chosen"), "_r": rest("rejected")})
    return df.select(
        "pair_id",
        "n_prompt_turns",
        _joined(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        _joined(F.col("_c")).alias("chosen"),
        _joined(F.col("_r")).alias("rejected"),
        _masks(F.col("_c")).alias("chosen_mask"),
        _masks(F.col("_r")).alias("rejected_mask"),
        ((F.size("_c") == 0) & (F.size("_r") == 0)).alias("identical"),
    )


def neighbours(ids: DataFrame) -> DataFrame:
    """(conv_id, next_id) in a ring over the distinct ``ids`` (conv_id); a single id has no neighbour."""
    spark = ids.sparkSession
    ids = written(spark, ids, "conversations")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(spark, ids.repartitionByRange(parts, "conv_id").withColumn("part", F.spark_partition_id()), "ranges")
    firsts = [tuple(r) for r in ranged.groupBy("part").agg(F.min("conv_id")).orderBy("part").collect()]
    behind = spark.createDataFrame([(p, firsts[(i + 1) % len(firsts)][1]) for i, (p, _) in enumerate(firsts)], "part int, behind long")
    following = F.lead("conv_id").over(Window.partitionBy("part").orderBy("conv_id"))
    return ranged.withColumn("following", following).join(F.broadcast(behind), "part").select("conv_id", F.coalesce("following", "behind").alias("next_id")).filter("conv_id <> next_id")


def pairs_from_conversations(turns: DataFrame) -> DataFrame:
    """Pairs (pair_id, chosen, rejected) of a table (conv_id, turn, role, text)."""
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    turns_of = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    # The last assistant turn, counted from 1; 0 if there is none.
    last = F.array_max(F.concat(F.array(F.lit(0)), F.transform("all", lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0))))
    whole = whole.select("conv_id", turns_of.alias("chosen"), last.alias("last")).filter("last > 0")
    able = turns.filter("conv_id is not null and role = 'assistant'").select(F.col("conv_id").cast("long")).distinct()
    reply = whole.select(F.col("conv_id").alias("next_id"), F.element_at("chosen", F.col("last")).alias("reply")).join(neighbours(able), "next_id").select("conv_id", "reply")
    paired = whole.join(reply, "conv_id")
    rejected = F.concat(F.slice("chosen", F.lit(1), F.col("last") - 1), F.array("reply"))
    return paired.select(F.col("conv_id").alias("pair_id"), "chosen", rejected.alias("rejected"))
