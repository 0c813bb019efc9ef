"""Preference formatting: one prompt and two masked completions for each pair of conversations.

The turns of a pair meet in one group (a pair, so as large as its two conversations); all else is
array functions. The prompt is the longest prefix of turns, equal in role and text, that chosen
and rejected share, rendered once; what is left of either side is its completion. A mask lists the
character ranges of the completion to train on: the assistants' texts and their end marks.

Defined results: turns are ordered by turn, role and text, so repeated or tied turns have one
order; a null text renders as an empty one, and null equals null; a null role renders as `none`.
status: `pair`, `identical` (both completions empty), `prefix` (one of them empty), or `unpaired`
(one side has no turns; its prompt is empty). Rows without a conversation id are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def _mask(turns: Column) -> Column:
    """The ranges to train on, as text: start-end, start-end, ..."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("ranges"))

    def step(have: Column, t: Column) -> Column:
        begin = have["at"] + F.char_length(t["role"]) + 5
        end = begin + F.char_length(t["text"]) + 8
        mine = F.concat(F.when(have["ranges"] == "", F.lit("")).otherwise(F.concat(have["ranges"], F.lit(","))), begin.cast("string"), F.lit("-"), (end - 1).cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", mine).otherwise(have["ranges"]).alias("ranges"))

    return F.aggregate(turns, start, step)["ranges"]


def preference_pairs(turns: DataFrame, pair: Column, is_chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """pair_id, status, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("none")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = turns.select(pair.alias("pair_id"), is_chosen.alias("is_chosen"), turn.alias("one")).filter("pair_id is not null and is_chosen is not null")
    side = lambda wanted: F.sort_array(F.collect_list(F.when(F.col("is_chosen") == wanted, F.col("one"))))
    d = d.groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"))
    same = F.zip_with(F.slice("c", 1, F.least(F.size("c"), F.size("r"))), F.slice("r", 1, F.least(F.size("c"), F.size("r"))), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    differs = F.array_position(same, F.lit(False))
    d = d.withColumn("n", F.when(differs > 0, differs - 1).otherwise(F.least(F.size("c"), F.size("r"))).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    status = (
        F.when((F.size("c") == 0) | (F.size("r") == 0), "unpaired")
        .when((F.col("n") == F.size("c")) & (F.col("n") == F.size("r")), "identical")
        .when((F.col("n") == F.size("c")) | (F.col("n") == F.size("r")), "prefix")
        .otherwise("pair")
    )
    return d.select(
        "pair_id", status.alias("status"), F.col("n").cast("long").alias("prompt_turns"), _rendered(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _rendered(rest("c")).alias("chosen"), _mask(rest("c")).alias("chosen_mask"), _rendered(rest("r")).alias("rejected"), _mask(rest("r")).alias("rejected_mask"),
    )
