"""Dropping repeats that follow too soon: exact for keys of any size.

An event is kept when the last *kept* event of its key is at least `gap` old. That is a chain over the whole
key, but a piece of a key is a function: it takes the event kept before it to the event kept last in it. As a
step function it is a short table of rows (start, leave): who has to begin at a time up to `start` leaves with
`leave`. Functions compose, so the pieces of a key are a prefix scan. The events are cut into pieces by range;
only the first and the last key of a piece can go on in another one. The tables of neighbouring pieces are
composed pairwise, level by level; then the event kept before each pair is handed down, to the left half as it is
and to the right half through the left one's table. Every level is one window and one join over rows of
(key, pair), so no task reads more than the tables of two neighbours, and pieces need 2 log n levels. All
pieces are then folded in parallel, every piece of a partition at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedweave.operators import ordering
from feedweave.operators.ordering import PIECE, ROW
from feedweave.session import checkpoint


def piece_exits(ms: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """(first kept event, last kept event) for every possible first kept event of a piece.

    Neighbouring starts that end on the same event are merged into the latest of them.
    """
    follow = np.searchsorted(ms, ms + gap)
    last = ms.copy()
    for i in range(len(ms) - 1, -1, -1):
        if follow[i] < len(ms):
            last[i] = last[follow[i]]
    # What was kept before lies before the piece, so it forbids less than a gap from the first event on.
    n = min(len(ms), int(np.searchsorted(ms, ms[0] + gap)) + 1)
    return [(int(ms[i]), int(last[i])) for i in range(n) if i == n - 1 or last[i] != last[i + 1]]


def kept_in_piece(ms: np.ndarray, entry: float | None, gap: int) -> np.ndarray:
    """Positions of the events that pass, given the event kept before the piece."""
    before = np.array([np.nan if entry is None else entry])
    return np.flatnonzero(kept_rows(np.zeros(len(ms), np.int64), ms, before, gap))


def kept_rows(segment: np.ndarray, ms: np.ndarray, entry: np.ndarray, gap: int) -> np.ndarray:
    """Which events pass. Events are in order of segment (0, 1, ...) and time; entry: the time kept before each segment, or nan.

    The chains of all segments are walked side by side, so many short ones cost no more than one long one.
    """
    kept = np.zeros(len(ms), bool)
    if not len(ms):
        return kept
    starts = np.searchsorted(segment, np.arange(len(entry)))
    least = int(ms.min())
    span = int(ms.max()) - least + gap + 1
    # Python integers keep the line of all segments exact where 64 bits would not hold it.
    line = segment * span + (ms - least) if len(entry) * span < 2**62 else segment.astype(object) * span + (ms - least)
    follow = np.searchsorted(line, line + gap)
    begin = np.where(np.isnan(entry), least, entry + gap).astype(np.int64) - least
    at = np.maximum(starts, np.searchsorted(line, np.arange(len(entry)).astype(line.dtype) * span + np.clip(begin, 0, span - 1)))
    end = np.append(starts[1:], len(ms))
    at, end = at[at < end], end[at < end]
    while len(at) > 8:
        kept[at] = True
        at = follow[at]
        at, end = at[at < end], end[at < end]
    for i, stop in zip(at.tolist(), end.tolist()):
        while i < stop:
            kept[i] = True
            i = int(follow[i])
    return kept


def _segments(batches: Iterator[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table | None, np.ndarray]:
    """All rows of a partition, and the number of the run of equal keys that each is in."""
    table = pa.Table.from_batches(batches := list(batches)).combine_chunks() if batches else None
    if table is None or not len(table):
        return None, np.empty(0, np.int64)
    new = np.zeros(len(table), bool)
    for c in keys:
        column = table[c].combine_chunks()
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return table, np.cumsum(new)


def _border_exits(gap: int, keys: list[str]):
    """The exit tables of the first and the last key of each partition; others end where they begin."""

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, segment = _segments(batches, keys)
        for one in {0, segment[-1]} if table is not None else ():
            here = np.flatnonzero(segment == one)
            ms = table["ms"].to_numpy()[here]
            rows = piece_exits(ms, gap)
            columns = {c: table[c].combine_chunks().take(pa.array(np.full(len(rows), here[0]))) for c in keys}
            yield pa.record_batch({**columns, "begin": pa.array([int(ms[0])] * len(rows)), "start": pa.array([s for s, _ in rows]), "leave": pa.array([e for _, e in rows])})

    return exits


def _fold(gap: int, keys: list[str]):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, segment = _segments(batches, keys)
        if table is not None:
            first = np.searchsorted(segment, np.arange(segment[-1] + 1))
            entry = table["entry"].cast(pa.float64()).to_numpy()[first]  # below 2**53 for any date
            kept = kept_rows(segment, table["ms"].to_numpy(), entry, gap)
            yield pa.record_batch({"tie": table["tie"].combine_chunks().filter(pa.array(kept))})

    return fold


def compose_pairs(tables: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Tables of nodes 2n and 2n + 1 as one table of node n; columns: keys, node, begin (first event), start, leave."""
    pair = [*keys, "pair"]
    halves = tables.withColumns({"pair": F.shiftright("node", 1), "right": F.col("node") % 2 == 1})
    # Who leaves the left half at `leave` begins in the right half at leave + gap: the first row there that starts so late.
    asked = halves.withColumns({"_at": F.when(F.col("right"), F.col("start")).otherwise(F.col("leave") + gap), "_then": F.when(F.col("right"), F.col("leave"))})
    later = Window.partitionBy(*pair).orderBy("_at", "right").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*pair)
    joined = asked.select(
        *pair, "start", F.min("begin").over(whole).alias("begin"),
        F.when(F.col("right"), F.col("leave")).otherwise(F.coalesce(F.first("_then", ignorenulls=True).over(later), "leave")).alias("leave"),
    )
    # Neighbouring starts that end on the same event are merged into the latest of them.
    after = F.lead("leave").over(Window.partitionBy(*pair).orderBy("start"))
    merged = joined.withColumn("_after", after).filter(F.col("_after").isNull() | (F.col("_after") != F.col("leave")))
    # What was kept before lies before the pair, so it forbids less than a gap from the first event on.
    last = F.min(F.when(F.col("start") >= F.col("begin") + gap, F.col("start"))).over(whole)
    needed = merged.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col("start") <= F.col("_last")))
    return needed.select(*keys, F.col("pair").alias("node"), "begin", "start", "leave")


def entries_of(tables: DataFrame, keys: list[str], gap: int, pieces: int) -> DataFrame:
    """keys, node, entry: the event kept before each piece, for keys that lie in several of `pieces` pieces."""
    node = [*keys, "node"]
    several = tables.groupBy(*keys).agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select(*keys)
    levels = [checkpoint(tables.join(several, keys, "left_semi"))]
    while pieces > 1 << len(levels):
        levels.append(checkpoint(compose_pairs(levels[-1], keys, gap)))
    known = levels[-1].select(*keys, F.shiftright("node", 1).alias("node")).distinct().withColumn("entry", F.lit(None).cast("long"))
    for level in reversed(levels):
        there = level.select(*node).distinct().withColumn("pair", F.shiftright("node", 1))
        given = known.withColumnRenamed("node", "pair")
        halves = there.join(given, [*keys, "pair"])
        # Through the left half: its first row that starts late enough, or nothing changes.
        left = level.filter("node % 2 = 0").withColumn("pair", F.shiftright("node", 1)).join(given, [*keys, "pair"])
        fits = left.filter(F.col("entry").isNull() | (F.col("start") >= F.col("entry") + gap))
        through = fits.groupBy(*keys, "pair").agg(F.min_by("leave", "start").alias("through"))
        halves = halves.join(through, [*keys, "pair"], "left")
        entry = F.when(F.col("node") % 2 == 1, F.coalesce("through", "entry")).otherwise(F.col("entry"))
        known = halves.select(*keys, "node", entry.alias("entry"))
    return known


def throttle_ids(events: DataFrame, keys: list[str], gap_ms: int, at: str = "at", tie: str = "event_id") -> DataFrame:
    """Ids (`tie`) of the events that pass; `keys` may be empty (one chain for all)."""
    k = [f"_k{i}" for i in range(max(1, len(keys)))]
    # A missing part of a key is a value of its own.
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(n) for c, n in zip(keys, k)] or [F.lit("").alias("_k0")]
    keyed = events.select(*parts, F.unix_millis(at).alias("ms"), F.col(tie).cast("bigint").alias("tie"))
    # Of the events of one millisecond only the first can pass.
    first = keyed.filter("ms is not null").groupBy(*k, "ms").agg(F.min("tie").alias("tie"))
    placed = ordering.pieces(first, k, [F.col("ms")]).drop(ROW)
    names = ", ".join(f"{c} string" for c in k)
    tables = placed.select(*k, PIECE, "ms").mapInArrow(_border_exits(gap_ms, [*k, PIECE]), f"{names}, {PIECE} long, begin long, start long, leave long")
    tables = checkpoint(tables.withColumnRenamed(PIECE, "node"))
    pieces = tables.agg(F.max("node")).first()[0]
    entries = entries_of(tables, k, gap_ms, (pieces or 0) + 1).withColumnRenamed("node", PIECE)
    # Two keys of a piece at most have an entry: a broadcast of two rows a piece, which leaves every piece where it is.
    known = placed.join(F.broadcast(entries), [*k, PIECE], "left").select(*k, PIECE, "ms", "tie", "entry")
    return known.mapInArrow(_fold(gap_ms, [*k, PIECE]), "tie long").select(F.col("tie").alias(tie))


def throttle_events(events: DataFrame, keys: list[str], gap_ms: int = 10_000, at: str = "at", tie: str = "event_id") -> DataFrame:
    """Drops an event when one with the same key was kept less than `gap_ms` before."""
    return events.join(throttle_ids(events, keys, gap_ms, at, tie), tie, "left_semi")


def rate_limit(events: DataFrame, gap_ms: int = 12_000, keys: tuple = (), at: str = "at", tie: str = "event_id") -> DataFrame:
    """At most one event per `gap_ms` in all (or per value of `keys`)."""
    return throttle_events(events, list(keys), gap_ms, at, tie)


def collapse_repeated_errors(events: DataFrame, session: list[str], key: list[str], gap_ms: int = 10_000, at: str = "at", tie: str = "event_id") -> DataFrame:
    """Drops an error that repeats the last kept one within `gap_ms`; any other error in between resets."""
    slim = events.select(*session, at, tie, F.xxhash64(*key).alias("_h"), F.struct(*key).alias("_key"))
    placed = ordering.neighbours(ordering.pieces(slim, session, [F.col(at), F.col(tie)]), session, ["_key"], before="_prev")
    changed = F.when(F.col("_prev._key").eqNullSafe(F.col("_key")) & F.col("_prev").isNotNull(), 0).otherwise(1)
    runs = ordering.running(placed.withColumn("_changed", changed), session, {"_run": ("sum", F.col("_changed"))})
    return events.join(throttle_ids(runs, [*session, "_run"], gap_ms, at, tie), tie, "left_semi")
