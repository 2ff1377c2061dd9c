"""Shards by jump consistent hashing (Lamping and Veach, 2014), in SQL expressions.

A key alone decides its shard for a number of shards; with one shard more, a key either stays or goes to the new one.
The generator of the paper multiplies modulo 2**64. SQL's multiplication raises on overflow, so the product is put
together from parts that fit.

Edge cases: a null key hashes as 0; rows with equal keys share a shard and get slots of their own; a null text has no
bytes. No rows in, no rows out. Of a text of any length only size and checksum are looked at. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACTOR = 2862933555777941757  # fixed value of the published generator
LOW = 0xFFFFFFFF

#: Parts of a shard whose rows are numbered apart. A parameter of the slots' order alone.
BLOCKS = 256
#: What a row takes besides its text.
ROW_BYTES = 16


def _next_state(state: Column) -> Column:
    """``state * FACTOR + 1`` modulo 2**64."""
    low, high = state.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(state, 32)
    factor_low, factor_high = FACTOR & LOW, FACTOR >> 32
    first = low.bitwiseAND(F.lit(0xFFFF)) * factor_low + 1
    second = F.shiftrightunsigned(low, 16) * factor_low
    below = first + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16)
    above = (
        F.shiftrightunsigned(below, 32)
        + F.shiftrightunsigned(second, 16)
        + low * factor_high
        + high.bitwiseAND(F.lit(0xFFFF)) * factor_low
        + F.shiftleft((F.shiftrightunsigned(high, 16) * factor_low).bitwiseAND(F.lit(0xFFFF)), 16)
    )
    return F.shiftleft(above.bitwiseAND(F.lit(LOW)), 32).bitwiseOR(below.bitwiseAND(F.lit(LOW)))


def jump_shards(key: Column, shards: int) -> Column:
    """``struct(shard, grown)``: the shard among ``shards``, and among ``shards + 1``. Each jump goes at least one
    shard on, so ``shards + 1`` steps always suffice."""
    start = F.struct(
        F.lit(0).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("grown"),
        F.lit(0).cast("long").alias("jump"),
        F.coalesce(key.cast("long"), F.lit(0).cast("long")).alias("state"),
    )

    def step(at: Column, _: Column) -> Column:
        state = _next_state(at["state"])
        ahead = (at["jump"] + 1) * (F.lit(2147483648.0) / (F.shiftrightunsigned(state, 33) + 1).cast("double"))
        moved = F.struct(
            F.when(at["jump"] < shards, at["jump"]).otherwise(at["shard"]).alias("shard"),
            at["jump"].alias("grown"),
            F.floor(ahead).cast("long").alias("jump"),
            state.alias("state"),
        )
        return F.when(at["jump"] <= shards, moved).otherwise(at)

    steps = F.sequence(F.lit(0), F.lit(shards))
    return F.aggregate(steps, start, step, lambda at: F.struct(at["shard"].cast("int").alias("shard"), at["grown"].cast("int").alias("grown")))


def assign_shards(docs: DataFrame, shards: int = 40, id: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """One row per document: ``(id, size, text_crc32, law, shard, slot, grown_shard)``. Slots count from 0 within a
    shard. They are numbered in blocks, so no task holds a shard; the counts before each block are at most
    ``shards * blocks`` rows, which bounds the broadcast."""
    at = jump_shards(F.col(id), shards)
    block = F.pmod(F.xxhash64(F.coalesce(F.col(id).cast("long"), F.lit(0).cast("long"))), F.lit(blocks)).cast("int")
    placed = docs.select(
        F.col(id).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        at.alias("at"),
        block.alias("block"),
    )
    before = (
        docs.select(at["shard"].alias("shard"), block.alias("block"))
        .groupBy("shard", "block")
        .agg(F.count("*").alias("n"))
        .select(
            "shard",
            "block",
            (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"),
        )
    )
    within = Window.partitionBy("shard", "block").orderBy("id", "text_crc32", "size")
    return (
        placed.select("*", F.col("at.shard").alias("shard"), F.col("at.grown").alias("grown_shard"))
        .withColumn("place", F.row_number().over(within))
        .join(F.broadcast(before), ["shard", "block"])
        .select(
            F.col("id").alias(id),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("before") + F.col("place") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )
