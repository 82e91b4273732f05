"""Chat formatting by cumulative-snapshot collapse (operator 4), with DataFrame functions only.

A chat service that logs the whole conversation after every turn leaves, for one conversation, many logs of which each
is a prefix of the next. Only the maximal ones should be rendered.

Turns of a conversation are numbered 1, 2, ... and hashed with their number, role and text (two independent 64-bit
hashes). The rolling XOR of these hashes identifies each prefix, since a number occurs once. A conversation is dropped
if its whole hash is that of a shorter prefix of another one (anti-join); of equal conversations the one with the
smallest id stays (grouped before the join). Prefix hashes are made distinct first, so that a first turn that a third of
all conversations share is one row by the time of the join.

Defined results: turns are ordered by (turn, role, text), nulls first, and repeated rows are turns of their own; a null
role or text is hashed apart from an empty one and rendered as empty; turns without a conv_id belong to no conversation
and are left out; no rows give no rows; only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed format of one rendered turn, and the marks that a text may not forge.
TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>"


def numbered_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n, role, text, h1, h2): turns numbered from 1, with the rolling hashes of the prefix that ends there."""
    t = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("n", F.row_number().over(order))
    said = [F.col("n"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    t = t.withColumn("a", F.xxhash64(F.lit(1), *said)).withColumn("b", F.xxhash64(F.lit("second"), *said))
    rolling = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("conv_id", "n", "role", "text", F.bit_xor("a").over(rolling).alias("h1"), F.bit_xor("b").over(rolling).alias("h2"))


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, same): conversations that neither prefix a longer one nor repeat one with a smaller id.

    ``same`` counts the equal conversations, the kept one included.
    """
    length = prefixes.groupBy("conv_id").agg(F.max("n").alias("n_turns"))
    p = prefixes.select("conv_id", "n", "h1", "h2").join(length, "conv_id")
    whole = p.filter("n = n_turns").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("same"))
    shorter = p.filter("n < n_turns").select("n", "h1", "h2").distinct()
    return whole.join(shorter, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "same")


def collapse_and_render(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, same, text): every maximal conversation rendered in the turn format of TURN_OPEN/TURN_CLOSE."""
    prefixes = numbered_turns(turns, id_col, turn_col, role_col, text_col)
    kept = maximal_conversations(prefixes)
    body = F.coalesce("text", F.lit(""))
    for mark in (TURN_OPEN, TURN_CLOSE):
        body = F.replace(body, F.lit(mark), F.lit(mark.replace("<|", "< |")))
    turn = F.concat(F.lit(TURN_OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), body, F.lit(f"{TURN_CLOSE}\n"))
    said = prefixes.join(kept, "conv_id").select("conv_id", "n_turns", "same", F.struct("n", turn.alias("said")).alias("t"))
    rendered = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["said"]), "")
    return said.groupBy("conv_id", "n_turns", "same").agg(rendered.alias("text"))
