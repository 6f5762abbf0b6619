"""Chat formatting: multi-party perspective rotation (DataFrame functions only).

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and all others as named users; ``system`` lines stay
system. The mask lists the character spans to train on, the assistant's lines
with their end mark; everything else is context.

    <|assistant|>\\n...<|end|>\\n   <|user name=bob|>\\n...<|end|>\\n   <|system|>\\n...<|end|>\\n

A conversation is shuffled once. Where a line stands in any rendering follows from
two running sums that don't depend on the perspective, the lengths before it as
others see them and its speaker's own lines before it, so the mask is found before
the lines are gathered and nothing is folded over a dialogue. A dialogue of any
length is one row for each participant, as the format asks; that row is what a
task has to hold.

Semantics: null text is empty; a null or empty role is ``unknown``; lines with
equal turn are ordered by role and text, null turns come first; a line with a null
``conv_id`` belongs to no conversation and is a dialogue of its own, so such lines
never gather; repeated rows are rendered each; a conversation of system lines only
has no perspective and gives no row; the marks ``<|`` and ``|>`` inside texts and
names are written ``<\\u200b|`` and ``|\\u200b>``; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MINE = "<|assistant|>\n"


def _plain(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<|"), F.lit("<​|")), F.lit("|>"), F.lit("|​>"))


def _lines(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, text, and head and body as anyone but the speaker sees them."""
    role = F.coalesce(F.nullif(F.col(role_col), F.lit("")), F.lit("unknown"))
    lines = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    head = F.when(F.col("role") == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), _plain(F.col("role")), F.lit("|>\n")))
    return lines.withColumn("head", head).withColumn("body", F.concat(_plain(F.col("text")), F.lit("<|end|>\n")))


def rotate(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, n_turns, text, mask (array of start, stop): a row a participant."""
    lines = _lines(conversations, conv_col, turn_col, role_col, text_col)
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv_id", "role").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    shown = (F.length("head") + F.length("body")).cast("long")
    placed = lines.filter("conv_id is not null").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    placed = placed.withColumn("at", F.coalesce(F.sum(shown).over(before), F.lit(0)) + F.count("*").over(own) * (F.lit(len(_MINE)) - F.length("head")) + len(_MINE))
    line = F.struct("n", "role", "head", "body", "at")
    talks = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    alone = lines.filter("conv_id is null").select("conv_id", F.array(F.struct(F.lit(1).alias("n"), "role", "head", "body", F.lit(len(_MINE)).cast("long").alias("at"))).alias("lines"))
    talks = talks.union(alone)
    speakers = F.array_except(F.array_distinct(F.transform("lines", lambda x: x["role"])), F.array(F.lit("system")))
    each = talks.select("conv_id", "lines", F.explode(speakers).alias("perspective"))
    mine = lambda x: x["role"] == F.col("perspective")
    return each.select(
        "conv_id",
        "perspective",
        F.size("lines").cast("long").alias("n_turns"),
        F.array_join(F.transform("lines", lambda x: F.concat(F.when(mine(x), F.lit(_MINE)).otherwise(x["head"]), x["body"])), "").alias("text"),
        F.transform(F.filter("lines", mine), lambda x: F.struct(x["at"].alias("start"), (x["at"] + F.length(x["body"])).alias("stop"))).alias("mask"),
    )


def chat_report(conversations: DataFrame) -> DataFrame:
    """Rotated dialogues with the mask as ``start:stop`` text."""
    out = rotate(conversations)
    return out.withColumn("mask", F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["stop"])), ","))
