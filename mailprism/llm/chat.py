"""Dialogues of several parties, rendered once from each speaker's side.

For every participant the dialogue is written with that speaker as the assistant and all
others as named users; the spans to train on are the speaker's own messages. Everything is
a DataFrame expression. A dialogue comes in windows of so many turns, so a conversation
that holds a large part of all rows is many rows of bounded length, not one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailprism.llm.common import written

WINDOW_TURNS = 64
# Messages that one window may hold where turns repeat; larger ones come in parts.
WINDOW_MESSAGES = 1024
NARRATOR, NOBODY = "system", "unknown"
END = "<|end|>"


def _plain(value: Column) -> Column:
    """Text cannot open a marker of its own."""
    return F.replace(value, F.lit("<|"), F.lit("< |"))


def _head(role: Column, speaker: Column) -> Column:
    named = F.concat(F.lit("<|user name="), role, F.lit("|>\n"))
    return F.when(role == NARRATOR, F.lit("<|system|>\n")).when(role == speaker, F.lit("<|assistant|>\n")).otherwise(named)


def _in_parts(messages: DataFrame, window_messages: int) -> DataFrame:
    """`messages` with `part`: their place in the order of their window, by so many messages.

    All are sorted over the cluster, so a window may lie in several slots; a place is the
    rank in the slot and the window's counts in the slots before.
    """
    ranged = messages.repartitionByRange(F.col("conv_id"), F.col("window"), F.col("m"))
    ranged = written(ranged.withColumn("slot", F.spark_partition_id()), "ordered")
    key = [F.col("conv_id"), F.col("window")]
    counts = ranged.groupBy("conv_id", "window", "slot").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("conv_id").alias("c"), F.col("window").alias("w"), F.col("slot").alias("s"), before.alias("before"))
    rank = F.row_number().over(Window.partitionBy(*key, "slot").orderBy("m"))
    of = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("window") == F.col("w")) & (F.col("slot") == F.col("s"))
    placed = ranged.withColumn("rank", rank).join(counts, of)
    part = F.floor((F.col("before") + F.col("rank") - 1) / window_messages).cast("int")
    return placed.select("conv_id", "window", "m", part.alias("part"))


def rotate_perspectives(
    turns: DataFrame, window_turns: int = WINDOW_TURNS, window_messages: int = WINDOW_MESSAGES, conv_col: str = "conv_id",
    turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv_id, speaker, window, part, n_messages, text, mask_spans) for every participant.

    `mask_spans` are `start:end` in code points of `text`, comma-joined: the messages of the
    speaker with their end marks. Narration (role `system`) is nobody's side; a
    conversation of narration only gives no row. A NULL role is the speaker `unknown`, a
    NULL text empty, a NULL turn comes first; rows without a conversation id are one
    conversation. Equal rows are one message; messages of equal turn go by role and text.
    A window of more than `window_messages` different messages comes in parts, each a stretch
    of so many in this order.
    """
    turn = F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 62)))
    messages = turns.select(
        F.col(conv_col).alias("conv_id"), F.floor(turn / window_turns).cast("long").alias("window"),
        F.struct(
            turn.alias("turn"), _plain(F.coalesce(F.col(role_col), F.lit(NOBODY))).alias("role"),
            _plain(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
        ).alias("m"),
    )
    # Equal rows are one message before they are counted.
    messages = written(messages.distinct(), "messages")
    counts = messages.groupBy("conv_id", "window").agg(F.count("*").alias("n")).filter(F.col("n") > window_messages)
    large = written(counts.select(F.col("conv_id").alias("c"), F.col("window").alias("w")), "large")
    of = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("window") == F.col("w"))
    ordinary = messages.join(large, of, "left_anti").withColumn("part", F.lit(0))
    windows = ordinary.unionByName(_in_parts(messages.join(large, of, "left_semi"), window_messages)).groupBy(
        "conv_id", "window", "part"
    ).agg(F.sort_array(F.collect_list("m")).alias("messages"))
    speakers = messages.filter(F.col("m.role") != NARRATOR).select(
        F.col("conv_id").alias("c"), F.col("m.role").alias("speaker")
    ).distinct()
    sides = windows.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")))

    speaker = F.col("speaker")
    body = lambda m: F.concat(m["text"], F.lit(END))
    said = F.transform("messages", lambda m: F.concat(_head(m["role"], speaker), body(m), F.lit("\n")))

    def placed(done: Column, m: Column) -> Column:
        start = done["at"] + F.length(_head(m["role"], speaker))
        end = start + F.length(body(m))
        span = F.concat(start.cast("string"), F.lit(":"), end.cast("string"))
        mine = F.when(m["role"] == speaker, F.array(span)).otherwise(F.array().cast("array<string>"))
        return F.struct((end + 1).alias("at"), F.concat(done["spans"], mine).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    spans = F.aggregate("messages", start, placed, lambda done: F.array_join(done["spans"], ","))
    return sides.select(
        "conv_id", "speaker", "window", "part", F.size("messages").cast("long").alias("n_messages"),
        F.array_join(said, "").alias("text"), spans.alias("mask_spans"),
    )
