"""Chat formatting with cumulative-snapshot collapse.

A log often holds a conversation again after each turn. Every turn's rolling prefix hash
stands for the conversation up to it; a conversation whose last hash is the
hash of an inner turn of another is a prefix of it and leaves by an anti-join, as do all but one
of equal conversations. What remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN = "<|im_start|>{role}\n{text}<|im_end|>\n"


def _turn_hash(seed: int) -> Column:
    # null differs from the empty string
    fields = [F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")]
    return F.xxhash64(F.lit(seed), F.col("k"), F.col("role").isNull(), F.length(fields[0]), fields[0], F.col("text").isNull(), fields[1])


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """turns with ``k`` (place from 1 in its conversation), ``last`` and the 128-bit prefix hash ``h1``, ``h2``.

    Hashes of placed turns are combined by exclusive or, so each prefix's hash comes from the one before it.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = turns.withColumn("k", F.row_number().over(order))
    t = t.withColumn("a", _turn_hash(1)).withColumn("b", _turn_hash(2))
    t = t.withColumn("h1", F.bit_xor("a").over(so_far)).withColumn("h2", F.bit_xor("b").over(so_far))
    return t.withColumn("last", F.lead("k").over(order).isNull()).drop("a", "b")


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations to keep: no prefix of a longer one, the smallest id of equal ones."""
    p = prefix_hashes(turns)
    ends = p.where("last").groupBy("k", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    inner = p.where("not last").select("k", "h1", "h2").distinct()
    return ends.join(inner, ["k", "h1", "h2"], "left_anti").select("conv_id", "n_equal", F.col("k").alias("n_turns"))


def format_chats(conversations: DataFrame, template: str = TURN) -> DataFrame:
    """conv_id, n_turns, n_equal, rendered: the maximal conversations of (conv_id, turn, role, text).

    Turns stand in order of turn, ties in order of role and text; repeated rows are turns of their own.
    A null role renders as ``unknown``, null text as nothing, a null turn comes first; rows with
    null conv_id belong to no conversation and are left out. ``n_equal``: conversations that equal it.
    """
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    turns = turns.where("conv_id is not null")
    kept = collapse(turns)
    head, middle, tail = template.replace("{role}", "\0").replace("{text}", "\0").split("\0")
    one = lambda t: F.concat(F.lit(head), F.coalesce(t["role"], F.lit("unknown")), F.lit(middle), F.coalesce(t["text"], F.lit("")), F.lit(tail))
    rows = turns.join(kept.select("conv_id"), "conv_id", "left_semi")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    shown = whole.select("conv_id", F.array_join(F.transform("turns", one), "").alias("rendered"))
    return kept.join(shown, "conv_id").select("conv_id", "n_turns", "n_equal", "rendered")
