"""Exact duplicates by two passes over a Bloom filter.

Pass 1 counts, in a filter of fixed size, how often each bit is set (none, once, more often; counts of
parts add up in any order). A hash all of whose bits were set more than once is possibly repeated; every
hash that occurs twice is. Pass 2 looks each row up in the filter, which is broadcast: its size is fixed by
FILTER_BITS, whatever the input. Only rows possibly repeated are grouped, by their full SHA-256; all others
pass straight through, each a group of its own. False alarms of the filter cost a shuffled row of 50 bytes
and nothing else, so the result is exact at any load of the filter.

Only (doc_id, hashes) is moved, never the text. A text that a third of all rows share is counted before the
shuffle and answered from the fixed-size table of the heaviest keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from feedweave.llm.common import plain_text, stored
from feedweave.operators.skew import lookup_by_key

#: Bits of the filter: 2**25 bits are a broadcast of at most 4 MB (8 MB as rows); 8 bits a document serve
#: 4 million documents well, more only send more rows into pass 2.
FILTER_BITS = 1 << 25
BLOCK_BITS = 1024
RANGES = 64  # pieces of the filter that are summed apart


def exact_groups(docs: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (null counts as empty) the row with the largest doc_id stays. Rows without doc_id count in
    group_size and stay only if no row of the group has one. Rows that repeat a doc_id together with its text
    are one document: all of them have the same verdict. Other columns are not looked at; an empty table gives
    an empty result.
    """
    text = plain_text("text")
    hashes = docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.xxhash64(text).alias("print"))
    hashes = stored(hashes, "exact-hashes")
    marked = maybe_in(hashes, "print", filter_of(hashes, "print", filter_bits, 2), filter_bits)
    possible = marked.filter("__maybe").select("doc_id", "text_sha256")
    groups = possible.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    settled = lookup_by_key(possible, groups, "text_sha256", "group_size", "doc_id")
    alone = marked.filter("not __maybe").select(
        "doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    return settled.select(alone.columns).unionByName(alone).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def distinct_texts(docs: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of `docs`, all columns as they are, one for each text (null counts as empty).

    Of the rows of a text the one with the largest doc_id stays, of equal ones that with the largest other values;
    a row without doc_id stays only if no row of the text has one. Texts that share a doc_id are judged each for
    itself. Rows whose text is surely unique stay where they are; the others meet by SHA-256, reduced to one row a
    text before they are moved. An empty table gives an empty result.
    """
    prints = docs.select(F.xxhash64(plain_text("text")).alias("print"))
    hashed = docs.withColumn("__print", F.xxhash64(plain_text("text")))
    marked = maybe_in(hashed, "__print", filter_of(prints, "print", filter_bits, 2), filter_bits)
    rest = [f.name for f in docs.schema if isinstance(f.dataType, AtomicType) and f.name not in ("doc_id", "text")]
    row, order = F.struct(*docs.columns), F.struct("doc_id", *rest, F.col("text").isNotNull())
    again = marked.filter("__maybe").groupBy(F.sha2(plain_text("text").cast("binary"), 256).alias("__sha")).agg(F.max_by(row, order).alias("__row"))
    return marked.filter("not __maybe").select(*docs.columns).unionByName(again.select("__row.*"))


def filter_of(hashes: DataFrame, column: str, filter_bits: int, least: int) -> DataFrame:
    """Rows (block, words): the bits that were set `least` (1 or 2) times or more, 1024 a block; blocks without any are left out."""
    per_range = filter_bits // RANGES

    def bits_of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = bit_positions(batch.column(0).to_numpy(zero_copy_only=False), filter_bits)
            at, times = np.unique(np.concatenate((first, second[second != first])), return_counts=True)
            cuts = np.searchsorted(at, np.arange(RANGES + 1) * per_range)
            found = [r for r in range(RANGES) if cuts[r] < cuts[r + 1]]
            piece = lambda r, keep: at[cuts[r] : cuts[r + 1]][keep(times[cuts[r] : cuts[r + 1]])].astype("<u4").tobytes()
            yield pa.record_batch(
                {
                    "part": pa.array(found, pa.int32()),
                    "once": pa.array([piece(r, lambda t: t == 1) for r in found], pa.binary()),
                    "more": pa.array([piece(r, lambda t: t > 1) for r in found], pa.binary()),
                }
            )

    def sums_of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have = counts.setdefault(part, np.zeros(per_range, np.uint8))
                at = np.frombuffer(once, "<u4") - np.uint32(part * per_range)
                have[at] = np.minimum(have[at] + 1, 2)
                have[np.frombuffer(more, "<u4") - np.uint32(part * per_range)] = 2
        for part, have in counts.items():
            words = np.packbits(have.reshape(-1, BLOCK_BITS) >= least, axis=1, bitorder="little").view("<i8")
            some = np.flatnonzero(words.any(axis=1))
            yield pa.record_batch(
                {
                    "block": pa.array(some + part * (per_range // BLOCK_BITS), pa.int64()),
                    "words": pa.array(list(words[some]), pa.list_(pa.int64())),
                }
            )

    parts = hashes.select(column).mapInArrow(bits_of_part, "part int, once binary, more binary")
    return parts.repartition(RANGES, "part").mapInArrow(sums_of_ranges, "block long, words array<bigint>")


def bit_positions(prints: np.ndarray, filter_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash, both in one block, as maybe_in finds them."""
    h = prints.astype(np.int64)
    block = (h & (filter_bits // BLOCK_BITS - 1)) * BLOCK_BITS
    return block + ((h >> 40) & (BLOCK_BITS - 1)), block + ((h >> 52) & (BLOCK_BITS - 1))


def maybe_in(rows: DataFrame, column: str, blocks: DataFrame, filter_bits: int) -> DataFrame:
    """Adds __maybe: whether the hash in `column` has both its bits in the filter; the filter is broadcast, its size is fixed."""
    bit = lambda shift: f"coalesce(shiftright(get(__words, cast((shiftright({column}, {shift}) & 1023) div 64 as int)), cast(shiftright({column}, {shift}) & 63 as int)) & 1, 0) = 1"
    at = rows.withColumn("__block", F.col(column).bitwiseAND(filter_bits // BLOCK_BITS - 1))
    named = blocks.select(F.col("block").alias("__block"), F.col("words").alias("__words"))
    return at.join(F.broadcast(named), "__block", "left").withColumn("__maybe", F.expr(f"{bit(40)} and {bit(52)}")).drop("__block", "__words")
