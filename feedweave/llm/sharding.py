"""Shards by jump consistent hashing (Lamping and Veach, 2014), in column expressions only.

A key jumps from shard to shard: each step draws from the key's own random sequence the shard count at which
it would move next, and it stays where that count exceeds the number of shards. No ring table is needed, and
one more shard takes rows only into itself. Slots inside the shards come from a running sum over counts of
SLOT_BINS bins a shard, so no shard is ever numbered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedweave.llm.common import plain_text

#: The generator of the published algorithm.
MULTIPLIER = 2862933555777941757
SLOT_BINS = 4096  # bins of a shard; their counts (shards x bins rows at most) are broadcast


WIDE = "decimal(38,0)"  # a product of two 64-bit numbers, which is to wrap at 2**64 and not fail


def _number(n: int) -> Column:
    return F.expr(f"cast({n}BD as {WIDE})")


def _advance(k: Column) -> Column:
    """The next number of a key's sequence."""
    return ((k * _number(MULTIPLIER) + _number(1)) % _number(1 << 64)).cast(WIDE)


def _first_draw(key: Column) -> Column:
    start = F.coalesce(key.cast("long"), F.lit(0)).cast(WIDE)
    return _advance(F.when(start < 0, start + _number(1 << 64)).otherwise(start).cast(WIDE))


def _bin(key: Column, bins: int) -> Column:
    """A bin of a key, by bits of its first draw that no jump looks at."""
    return F.pmod(F.call_function("div", _first_draw(key), _number(1 << 20)), F.lit(bins))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key, 0 to shards - 1; a null key is taken as 0.

    The shard rises with every jump, so `shards` steps always do.
    """
    state = F.struct(_first_draw(key).alias("k"), F.lit(0).cast("long").alias("shard"))

    def step(s: Column, _: Column) -> Column:
        draw = F.call_function("div", s["k"], _number(1 << 33)).cast("double")
        goal = F.floor((s["shard"] + 1) * (F.lit(float(1 << 31)) / (draw + 1))).cast("long")
        return F.when(goal < shards, F.struct(_advance(s["k"]).alias("k"), goal.alias("shard"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, step, lambda s: s["shard"].cast("int"))


def shard_documents(docs: DataFrame, shards: int, bins: int = SLOT_BINS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `key`: doc_id and the number of shards alone decide; grown_shard is the shard with one more. A null
    doc_id goes as key 0. size is the UTF-8 length of the text (null: 0) plus 1. Slots run from 0 without a
    gap, in the order of (bin, doc_id); rows that repeat a doc_id go to one shard and have a slot each. Other columns are not looked at.
    """
    text = plain_text("text").cast("binary")
    bin_of = _bin(F.col("doc_id"), bins)
    keyed = docs.select("doc_id", jump_shard(F.col("doc_id"), shards).alias("shard"), bin_of.alias("bin"))
    counts = keyed.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
        bin_of.alias("bin"),
    )
    in_bin = W.partitionBy("shard", "bin").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.join(F.broadcast(bases), ["shard", "bin"])  # shards x bins rows at most
        .withColumn("slot", F.row_number().over(in_bin) - 1 + F.col("base"))
        .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    )
