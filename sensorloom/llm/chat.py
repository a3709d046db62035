"""Conversations logged as growing snapshots: keep the maximal ones and render them.

A prefix hash of the first j turns is a running sum of hashes of (position, role, text), three
sums of 40 bits each, so it depends on the order and needs no fold over a conversation. A
conversation is cut into slices of ``SLICE_TURNS`` turn numbers: sums run within a slice, and
slice totals give each slice its start. So one endless conversation spreads over many tasks,
and only hashes are moved until the texts of the kept conversations are rendered, a slice at a
time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sensorloom.scratch import cut_lineage

SLICE_TURNS = 256
_SUMS = ["s0", "s1", "s2"]
_BITS = 1 << 40


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / SLICE_TURNS), F.lit(-(1 << 60))).cast("long").alias("slice"),
    )


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """Each turn's position from 1, the hash of all turns up to it, and whether it is the last."""
    turns = _turns(conversations)
    content = [F.xxhash64("role", "text"), F.xxhash64("text", F.lit(1), "role"), F.xxhash64(F.lit(2), "role", "text")]
    rows = turns.select("conv_id", "slice", "turn", *[h.alias(f"h{i}") for i, h in enumerate(content)])
    rows = rows.groupBy("conv_id", "slice", "turn", "h0", "h1", "h2").agg(F.lit(1).alias("one"))
    within = W.partitionBy("conv_id", "slice").orderBy("turn", "h0", "h1", "h2")
    rows = cut_lineage(rows.drop("one").withColumn("at", F.row_number().over(within).cast("long")), "turns")
    slices = W.partitionBy("conv_id").orderBy("slice")
    before = slices.rowsBetween(W.unboundedPreceding, -1)
    bases = rows.groupBy("conv_id", "slice").agg(F.count("*").alias("n"))
    bases = bases.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bases = bases.withColumn("final", F.lead("slice").over(slices).isNull()).select(
        F.col("conv_id").alias("_c"), F.col("slice").alias("_s"), "n", "base", "final"
    )
    here = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("slice") == F.col("_s"))
    placed = rows.join(bases, here).withColumn("position", F.col("base") + F.col("at"))
    placed = placed.select(
        "conv_id",
        "slice",
        "position",
        (F.col("final") & (F.col("at") == F.col("n"))).alias("last"),
        *[F.pmod(F.xxhash64("position", f"h{i}"), F.lit(_BITS)).alias(s) for i, s in enumerate(_SUMS)],
    )
    placed = cut_lineage(placed, "positions")
    totals = placed.groupBy("conv_id", "slice").agg(*[F.sum(s).alias(s) for s in _SUMS])
    starts = totals.select(
        F.col("conv_id").alias("_c"),
        F.col("slice").alias("_s"),
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"b{s}") for s in _SUMS],
    )
    running = W.partitionBy("conv_id", "slice").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    summed = placed.withColumns({s: F.sum(s).over(running) for s in _SUMS}).join(starts, here)
    return summed.select("conv_id", "position", "last", *[(F.col(s) + F.col(f"b{s}")).alias(s) for s in _SUMS])


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """Ids of the conversations that are no prefix of a longer one; the least id of equal ones."""
    hashes = cut_lineage(prefix_hashes(conversations), "prefixes")
    key = ["position", *_SUMS]
    proper = hashes.filter(~F.col("last")).select(*key).distinct()
    whole = hashes.filter("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    return whole.join(proper, key, "left_anti").select("conv_id")


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), turn["role"], F.lit("\n"), turn["text"], F.lit("<|im_end|>\n"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Rendered maximal conversations: ``conv_id, part, turns, text``.

    Turns are ordered by number (null first), then role and text; turns that agree in all of
    these count once. Null roles and texts are empty, rows with a null id form one conversation. A
    conversation comes in parts of up to ``SLICE_TURNS`` turn numbers, numbered from 0, whose
    texts join to the whole; nearly all have one part. An empty table gives an empty result.
    """
    kept = maximal_conversations(conversations).withColumnRenamed("conv_id", "_kept")
    turns = _turns(conversations).join(kept, F.col("conv_id").eqNullSafe(F.col("_kept")), "left_semi")
    # A null turn number sorts first within the struct, as it does in the window above.
    parts = turns.groupBy("conv_id", "slice").agg(
        F.array_sort(F.collect_set(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "role", "text"))).alias("list")
    )
    return parts.select(
        "conv_id",
        (F.row_number().over(W.partitionBy("conv_id").orderBy("slice")) - 1).alias("part"),
        F.size("list").alias("turns"),
        F.array_join(F.transform("list", _rendered), "").alias("text"),
    )
