"""Operator 3 (DataFrame functions only): preference formatting of chosen and rejected conversations.

For each pair the longest common turn prefix is found, rendered once as the prompt, and what follows on either side is
rendered as a completion with a mask: spans [start, end) of the characters to train on (what assistants say and the mark
that ends their turn). Turns are compared one by one after partial aggregation, so a conversation of any length is never
gathered: a section comes out in parts of at most ``PART`` turn numbers (one part for usual conversations), and prompt,
chosen and rejected of a pair are its parts in order.

Turns are placed by their number. Rows without conversation or turn number cannot be placed and are left out; of several
rows for one turn the smallest (role, text) counts, so repeated rows change nothing. Null roles render as ``unknown``,
null texts as empty, and both equal only another null. A pair needs both sides; the common prefix ends at the first turn
number at which role or text differ or one side has none. Equal conversations give a prompt and no completions, pairs
that differ from the start give no prompt. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turn numbers in one part of a section.
PART = 256
#: The marks around a turn.
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def render_turn(role: str = "role", text: str = "text"):
    """(header, body) columns: the body is what an assistant learns to write."""
    head = F.concat(F.lit("<|"), F.coalesce(F.col(role), F.lit("unknown")), F.lit("|>\n"))
    return head, F.concat(F.coalesce(F.col(text), F.lit("")), F.lit(CLOSE))


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair, section (prompt, chosen, rejected) and part.

    turns: conv_id, turn, role, text. pairs: pair_id, chosen_id, rejected_id. Result: pair_id, section, part, n_turns,
    text, mask (``start:end`` spans joined by commas, positions in code points of this part).
    """
    one = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("t"))
    sides = pairs.where("chosen_id <> rejected_id").select("pair_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit(1).alias("side"), F.col("rejected_id").alias("conv_id")))).alias("s")).select("pair_id", "s.*")
    placed = one.join(sides.hint("merge"), "conv_id")
    side = lambda k: F.max(F.when(F.col("side") == k, F.struct("t")))
    by_turn = placed.groupBy("pair_id", "turn").agg(side(0).alias("c"), side(1).alias("r"))
    same = F.col("c").isNotNull() & F.col("r").isNotNull() & F.col("c").eqNullSafe(F.col("r"))
    by_turn = by_turn.withColumn("same", same)
    ends = by_turn.groupBy("pair_id").agg(F.min(F.when(~F.col("same"), F.col("turn"))).alias("fork"), F.max(F.col("c").isNotNull()).alias("has_c"), F.max(F.col("r").isNotNull()).alias("has_r"))
    both = by_turn.join(ends.where("has_c AND has_r").hint("merge"), "pair_id")
    shared = F.col("fork").isNull() | (F.col("turn") < F.col("fork"))
    parts = both.select(
        "pair_id", "turn",
        F.explode(F.when(shared, F.array(F.struct(F.lit("prompt").alias("section"), F.col("c.t").alias("t")))).otherwise(F.array(F.struct(F.lit("chosen").alias("section"), F.col("c.t").alias("t")), F.struct(F.lit("rejected").alias("section"), F.col("r.t").alias("t"))))).alias("x"),
    ).select("pair_id", "turn", "x.section", "x.t").where("t IS NOT NULL")
    head, body = render_turn("t.role", "t.text")
    drawn = parts.select("pair_id", "section", F.floor(F.col("turn") / PART).alias("part"), "turn", head.alias("head"), body.alias("body"), ((F.col("section") != "prompt") & F.col("t.role").eqNullSafe("assistant")).alias("learn"))
    rows = drawn.groupBy("pair_id", "section", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "head", "body", "learn"))).alias("ts"))  # at most PART turns
    size = lambda x: F.length(x["head"]) + F.length(x["body"])
    walk = F.aggregate(
        "ts", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + size(x)).alias("at"),
            F.when(x["learn"], F.concat(a["spans"], F.array(F.concat_ws(":", (a["at"] + F.length(x["head"])).cast("string"), (a["at"] + size(x)).cast("string"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return rows.select(
        "pair_id", "section", F.col("part").cast("long").alias("part"), F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", lambda x: F.concat(x["head"], x["body"])), "").alias("text"), F.array_join(walk["spans"], ",").alias("mask"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs of a table that states none: conversations 2k (chosen) and 2k+1 (rejected)."""
    ids = turns.where("conv_id IS NOT NULL").select(F.shiftright("conv_id", 1).alias("pair_id")).distinct()
    return ids.select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))
