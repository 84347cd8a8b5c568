"""Preference formatting of chat data, with DataFrame functions only.

Chosen and rejected conversations of a pair share their first turns: the longest common prefix is rendered once as
the prompt, what follows in each as its completion. A completion's mask lists (weight, characters) of its turns in
order: weight 1 for assistant turns, 0 for turns that are context.

Results: null roles and texts render as empty; turns that repeat a number are ordered by role and text; rows of a pair
with one side only give that side as completion and an empty prompt; rows without a pair id belong to no pair and are
left out; equal conversations give empty completions; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("\n<|end|>\n"))


def joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def mask(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.when(t["role"] == "assistant", "1:").otherwise("0:"), F.length(rendered(t)).cast("string"))), ",")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """turns(pair_id, chosen boolean, turn, role, text) -> one row a pair: prompt, both completions and masks.

    One shuffle, on pair_id; a task never holds more than a pair's turns for one row.
    """
    own = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = turns.where("pair_id is not null").groupBy("pair_id").agg(F.sort_array(F.collect_list(F.when(F.col("chosen"), own))).alias("c"), F.sort_array(F.collect_list(F.when(~F.col("chosen"), own))).alias("r"))
    bare = lambda side: F.transform(side, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    both = sides.select("pair_id", bare("c").alias("c"), bare("r").alias("r"))
    short = F.least(F.size("c"), F.size("r"))
    differ = F.array_position(F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b)), False)
    split = both.withColumn("n", F.when(differ > 0, F.least(differ - 1, short)).otherwise(short).cast("int"))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    parts = split.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return parts.select(
        "pair_id", F.col("n").cast("long").alias("prompt_turns"), joined("p").alias("prompt"),
        joined("c").alias("chosen"), mask("c").alias("chosen_mask"), joined("r").alias("rejected"), mask("r").alias("rejected_mask"),
    )
