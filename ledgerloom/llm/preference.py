"""Preference data from pairs of conversations: one prompt, two completions with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import Scratch

PART = 4096
TRAINED = "assistant"


def _head(role: str) -> Column:
    return F.concat(F.lit("<|"), F.col(role), F.lit("|>\n"))


END = "<|end|>\n"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx, role, text) of (conv_id, turn, role, text, ...): turns numbered from 0 by turn, role and text; null roles and texts become ''."""
    turns = conversations.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return turns.filter("conv_id is not null").select("conv_id", (F.row_number().over(order) - 1).alias("idx"), "role", "text")


def paired_by_opening(turns: DataFrame) -> DataFrame:
    """(conv_id, pair_id, side) of ordered turns: conversations with the same first turn, by conv_id, are chosen and rejected in turn.

    pair_id is the chosen one's conv_id. A last one without a partner is a chosen conversation alone. The place among those
    of an opening is counted in parts of PART ids and added up, so that one opening may have any share of the rows.
    """
    opening = turns.filter("idx = 0").select("conv_id", F.sha2(F.concat_ws("\n", "role", "text"), 256).alias("opening"), F.floor(F.col("conv_id") / PART).alias("part"))
    sizes = opening.groupBy("opening", "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("opening").orderBy("part")) - F.col("n")
    sizes = sizes.select("opening", "part", earlier.alias("earlier"))
    own = F.row_number().over(Window.partitionBy("opening", "part").orderBy("conv_id")) - 1
    placed = opening.withColumn("own", own).join(sizes, ["opening", "part"]).withColumn("place", F.col("earlier") + F.col("own"))
    placed = placed.withColumn("pair", F.floor(F.col("place") / 2)).withColumn("odd", F.col("place") % 2 == 1)
    chosen = placed.filter("not odd").select("opening", "pair", F.col("conv_id").alias("chosen_id"))
    rejected = placed.filter("odd").select("opening", "pair", F.col("conv_id").alias("rejected_id"))
    pairs = chosen.join(rejected, ["opening", "pair"], "left").select("chosen_id", "rejected_id")
    sides = F.array(F.struct(F.col("chosen_id").alias("conv_id"), F.lit("chosen").alias("side")), F.struct(F.col("rejected_id").alias("conv_id"), F.lit("rejected").alias("side")))
    return pairs.select(F.col("chosen_id").alias("pair_id"), F.explode(sides).alias("s")).select("s.conv_id", "pair_id", "s.side").filter("conv_id is not null")


def formatted(sides: DataFrame) -> DataFrame:
    """Pairs of conversations as training rows, from their turns (pair_id, side, idx, role, text), side chosen or rejected.

    n_common is the length of the longest common prefix of turns, the same role and text; it is rendered once as prompt.
    The other turns are the completions; chosen_mask and rejected_mask list the spans of code points, 'start-stop' joined
    by commas, of assistant texts with their end marks, which alone are trained on. A missing side has no turns: its
    completion and mask are '' and the prompt is '' too. Empty input gives no rows.
    """
    piece = F.concat(_head("role"), "text", F.lit(END))
    turns = sides.select("pair_id", "side", "idx", "role", "text", piece.alias("piece"))
    pair = Window.partitionBy("pair_id")
    same = F.count("*").over(Window.partitionBy("pair_id", "idx", "role", "text")) == 2
    # idx of the first turn that the two sides do not share
    differs = F.min(F.when(~same, F.col("idx"))).over(pair)
    turns = turns.withColumn("n_common", F.coalesce(differs, F.max("idx").over(pair) + 1)).withColumn("later", F.col("idx") >= F.col("n_common"))
    size = F.char_length("piece")
    stop = F.sum(F.when(F.col("later"), size).otherwise(0)).over(Window.partitionBy("pair_id", "side").orderBy("idx"))
    span = F.concat((stop - size + F.char_length(_head("role"))).cast("string"), F.lit("-"), stop.cast("string"))
    turns = turns.withColumn("span", F.when(F.col("later") & (F.col("role") == TRAINED), span))
    kept = lambda name, keep: F.array_sort(F.collect_list(F.when(keep, F.struct("idx", name))))
    text = lambda name, keep, by="": F.array_join(F.transform(kept(name, keep), lambda s: s[name]), by)
    of = lambda side: (F.col("side") == side) & F.col("later")
    return turns.groupBy("pair_id").agg(
        F.max("n_common").cast("long").alias("n_common"),
        text("piece", (F.col("side") == "chosen") & ~F.col("later")).alias("prompt"),
        text("piece", of("chosen")).alias("chosen"),
        text("piece", of("rejected")).alias("rejected"),
        text("span", of("chosen") & F.col("span").isNotNull(), ",").alias("chosen_mask"),
        text("span", of("rejected") & F.col("span").isNotNull(), ",").alias("rejected_mask"),
    )


def preference_rows(conversations: DataFrame) -> DataFrame:
    """formatted() of all conversations (conv_id, turn, role, text, ...), paired by their openings.

    Rows without a conv_id belong to no conversation and are left out; repeated rows are turns of their own.
    """
    scratch = Scratch(conversations.sparkSession)
    turns = scratch.keep(ordered_turns(conversations), "turns")
    return formatted(turns.join(paired_by_opening(turns), "conv_id"))
