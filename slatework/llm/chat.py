"""Chat formatting after a cumulative-snapshot collapse.

Logs often hold a conversation again after every turn.  A rolling hash of the turns so far (two running sums of
hashes of position, role and text) names every prefix; a conversation whose last hash is the hash of a proper prefix
of another one is dropped by an anti-join, and of equal conversations the smallest id stays.  What is left is
rendered.

Turns are ordered by turn number, role and text hash; rows equal in conversation, turn, role and text are one turn.
NULL roles and texts read as ''.  NULL turn numbers come first.  Rows with a NULL conversation id form one
conversation.  Positions and running sums come from range-partitioned rows of hashes, so one conversation may hold any
share of the rows; a rendered row holds at most ``part_turns`` turns, longer conversations have several parts.
Control marks inside texts are broken up.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slatework.llm.common import written
from slatework.operators.ordering import join_on, running_totals, with_positions

# The marks of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_MODULO = (1 << 31) - 1


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` (conv, turn, role, text) as (conv, position, turns, one, two): hashes of all turns up to here."""
    narrow = turns.select("conv", "turn", "role", F.xxhash64("role", "text").alias("said"), F.xxhash64(F.lit("tie"), "text").alias("tie"))
    placed = with_positions(narrow, ["conv"], [F.asc_nulls_first("turn"), F.col("role"), F.col("said"), F.col("tie")], "position", "turns")
    part = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "position", "said", "tie"), F.lit(_MODULO))
    placed = placed.withColumns({"x": part(1), "y": part(2)})
    summed = running_totals(placed, ["conv"], [F.col("position")], {"x": "x", "y": "y"})
    return summed.select(
        "conv", "position", "turns", "turn", "role", "said", "tie", (F.col("before_x") + F.col("x")).alias("one"), (F.col("before_y") + F.col("y")).alias("two")
    )


def render(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = 1000) -> DataFrame:
    """One row per kept conversation and part: conv_id, part, n_turns, n_copies, text."""
    turns = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    ).distinct()
    known = written(prefixes(turns))
    whole = known.where(F.col("position") == F.col("turns") - 1).groupBy("turns", "one", "two").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    inner = known.where(F.col("position") < F.col("turns") - 1).select((F.col("position") + 1).alias("turns"), "one", "two").distinct()
    kept = written(whole.join(inner, ["turns", "one", "two"], "left_anti").select("conv", F.col("turns").alias("n_turns"), "n_copies"))
    hashed = turns.withColumns({"said": F.xxhash64("role", "text"), "tie": F.xxhash64(F.lit("tie"), "text")})
    own = join_on(known.select("conv", "position", "turn", "role", "said", "tie"), kept, ["conv"])
    placed = join_on(hashed, own, ["conv", "turn", "role", "said", "tie"])
    safe = lambda c: F.regexp_replace(c, r"<\|", "< |")
    line = F.concat(F.lit(OPEN), safe("role"), F.lit("\n"), safe("text"), F.lit(CLOSE + "\n"))
    parts = placed.select("conv", "n_turns", "n_copies", F.floor(F.col("position") / part_turns).alias("part"), "position", line.alias("line"))
    joined = parts.groupBy("conv", "part", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("position", "line"))).alias("lines"))
    return joined.select(F.col("conv").alias(conv), "part", "n_turns", "n_copies", F.concat_ws("", F.transform("lines", lambda x: x["line"])).alias("text"))
