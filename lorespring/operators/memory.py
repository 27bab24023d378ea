"""Conversation logs: scopes, watermarks, windows, snapshots, pages and names.

Turns have (conv_id, turn, role, text); sequences are per conversation, never by time, so nothing is ever late.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAPSHOT_TURNS, SNAPSHOT_TOKENS = 20, 8192


def in_scope(conv_id: Column, turn: Column, conversations: list | None, current: int | None, before: int | None) -> Column:
    """Turns of the given conversations (None: all), but of the current one only those before a turn."""
    inside = F.lit(True) if conversations is None else conv_id.isin(conversations)
    if current is None or before is None:
        return inside
    return inside & ~((conv_id == current) & (turn >= before))


def last_n(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation; none for n below 1."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    out = turns.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= max(n, 0))
    return out.drop("nth")


def pairs(turns: DataFrame) -> DataFrame:
    """Exchanges: each assistant turn with the last user turn before it, if no other assistant turn lies between."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.struct("turn", "text")), ignorenulls=True).over(order)
    answered = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(order)
    seen = turns.withColumn("asked", asked).withColumn("answered", answered)
    good = (F.col("role") == "assistant") & F.col("asked").isNotNull()
    good &= F.col("answered").isNull() | (F.col("answered") < F.col("asked.turn"))
    return seen.where(good).select(
        "conv_id",
        F.col("asked.turn").alias("user_turn"),
        F.col("turn").alias("assistant_turn"),
        F.col("asked.text").alias("question"),
        F.col("text").alias("answer"),
    )


def snapshots_due(turns: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Per conversation the new turns since its watermark, their tokens, and whether a snapshot is due."""
    fresh = turns.join(watermarks, "conv_id", "left").where(F.col("turn") > F.coalesce("watermark", F.lit(-1)))
    out = fresh.groupBy("conv_id").agg(
        F.count("*").alias("new_turns"), F.floor(F.sum(F.length("text")) / 4).alias("tokens")
    )
    return out.withColumn("due", (F.col("new_turns") >= SNAPSHOT_TURNS) | (F.col("tokens") >= SNAPSHOT_TOKENS))


def window_start(turn: Column, watermark: Column, window: int = 100, overlap: int = 50) -> Column:
    """Where a summary begins: a window and an overlap back, but not past what no summary covers yet."""
    back = F.greatest(F.lit(0), turn - window - overlap)
    return F.greatest(F.lit(0), F.least(back, F.coalesce(watermark, F.lit(-1)) + 1))


def after(cursor: tuple, *keys: str, descending: bool = False) -> Column:
    """Rows beyond a cursor in the order of the keys; all for an empty cursor."""
    beyond, same = F.lit(not cursor), F.lit(True)
    for key, at in zip(keys, cursor):
        beyond |= same & ((F.col(key) < at) if descending else (F.col(key) > at))
        same &= F.col(key) == at
    return beyond


def appended(log: DataFrame, new: DataFrame) -> DataFrame:
    """New turns (conv_id, pos, ...) with contiguous sequence numbers behind each conversation's last."""
    high = log.groupBy("conv_id").agg(F.max("turn").alias("high"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("pos"))
    numbered = new.withColumn("place", place).join(high, "conv_id", "left")
    return numbered.withColumn("turn", F.coalesce("high", F.lit(-1)) + F.col("place")).drop("high", "place")


def batched(turns: DataFrame, most: int, overlap: int) -> DataFrame:
    """Turns of a conversation packed whole into batches of at most ``most`` characters: conv_id, batch, first, last, chars.

    A batch begins with the turns at the end of the one before that fit into ``overlap`` characters; a turn longer than
    a batch is a batch alone. The state is one conversation's open batch.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("turn")
        rows, held = [], []
        for turn, size in zip(group["turn"].tolist(), group["size"].tolist()):
            if held and sum(s for _, s in held) + size > most:
                rows.append((held[0][0], held[-1][0], sum(s for _, s in held)))
                tail: list[tuple[int, int]] = []
                for t in reversed(held):
                    if sum(s for _, s in tail) + t[1] > overlap or sum(s for _, s in tail) + t[1] + size > most:
                        break
                    tail.insert(0, t)
                held = tail
            held.append((turn, size))
        if held:
            rows.append((held[0][0], held[-1][0], sum(s for _, s in held)))
        out = pd.DataFrame(rows, columns=["first", "last", "chars"])
        out.insert(0, "batch", range(1, len(out) + 1))
        out.insert(0, "conv_id", group["conv_id"].iloc[0])
        return out

    sized = turns.select("conv_id", "turn", F.length("text").alias("size"))
    return sized.groupBy("conv_id").applyInPandas(fold, "conv_id long, batch int, first long, last long, chars long")


def first_free(names: DataFrame) -> DataFrame:
    """For each stem (owner, stem, number) the smallest number from 2 on that is not taken; 1 where the stem is free."""
    taken = names.groupBy("owner", "stem").agg(F.collect_set("number").alias("taken"))
    candidates = F.sequence(F.lit(1), F.size("taken") + 1)
    return taken.select("owner", "stem", F.array_min(F.array_except(candidates, "taken")).alias("free"))
