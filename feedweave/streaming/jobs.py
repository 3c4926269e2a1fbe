"""Streaming forms of the event operators and the incremental run.

State, watermarks and late rows are the engine's: keyed state with event-time timers for throttling and
recent lists, session windows for vitals. Rows that arrive later than the allowed delay are dropped by the
engine, which counts them (numRowsDroppedByWatermark). Outputs are written exactly once, by the file sink or by
batch number, so a replayed batch gives the same files again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DataType, IntegralType, StructField, StructType, TimestampType

from feedweave.config import Settings
from feedweave.functions import scores
from feedweave.operators import events, merge, throttle
from feedweave.plans.sync import POST_COLUMNS, StoredRun, sync_days
from feedweave.sources import feeds

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs the RocksDB store; a query keeps the store it began with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _key(keys: list[str]) -> Column:
    """All parts of the key in one text; without parts there is one chain for all events."""
    return F.to_json(F.struct(*keys)) if keys else F.lit("")


def _to_files(out: DataFrame, folder: str, name: str):
    """Appends to <folder>/<name> until all that is there has been read."""
    query = (
        out.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/{name}")
        .option("checkpointLocation", f"{folder}/checkpoint-{name}").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def read_output(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


class _Throttle(StatefulProcessor):
    """Holds the time of each key's last kept event until no later event can be too close to it.

    The keys of a bucket are one group: a batch's chains of all of them are walked side by side.
    """

    def __init__(self, gap_ms: int, columns: list[str]):
        self.gap, self.columns = gap_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "key string", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        segment, names = pd.factorize(batch["state_key"])
        ms = batch["at"].to_numpy("datetime64[us]").astype("int64") // 1000
        order = np.lexsort((batch["event_id"], ms, segment))
        segment, ms = segment[order], ms[order]
        held = [(self.last.getValue((name,)) or (np.nan,)) if self.last.containsKey((name,)) else (np.nan,) for name in names]
        kept = throttle.kept_rows(segment, ms, np.array([h[0] for h in held], float), self.gap)
        newest = pd.Series(ms[kept]).groupby(segment[kept]).max()
        for at, value in newest.items():
            self.last.updateValue((names[at],), (int(value),))
        if len(newest):
            self.handle.registerTimer(int(newest.max()) + self.gap)
        yield batch[self.columns].iloc[order[kept]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = expiredTimerInfo.getExpiryTimeInMs() - self.gap
        for name in [name for name, (ms,) in self.last.iterator() if ms <= over]:
            self.last.removeKey(name)
        yield from ()

    def close(self) -> None:
        pass


def throttle_stream(stream: DataFrame, keys: list[str], folder: str, gap_ms: int = 10_000, delay_ms: int = 60_000, buckets: int = 256):
    """throttle_events over a stream (event_id, at, keys ...); kept events go to <folder>/kept.

    An event on time but older than its key's last kept one comes after it all the same: it is dropped. Keys are
    dealt to `buckets` groups of state. Gives the finished query, whose progress counts the late rows.
    """
    bucket = F.pmod(F.xxhash64("state_key"), F.lit(buckets)).alias("state_bucket")
    timed = stream.filter("at is not null").withWatermark("at", f"{delay_ms} milliseconds").withColumn("state_key", _key(keys)).select("*", bucket)
    kept = timed.groupBy("state_bucket").transformWithStateInPandas(_Throttle(gap_ms, stream.columns), outputStructType=stream.schema, outputMode="Append", timeMode="EventTime")
    with _rocks(stream.sparkSession):
        return _to_files(kept, folder, "kept")


class _Recent(StatefulProcessor):
    """Holds the newest n events of each store, and gives its list anew whenever it has changed.

    The stores of a bucket are one group: a batch costs one call for all of them, and each changed store one read and one write.
    """

    ROWS = 100_000  # rows of lists that are given out at once, about

    def __init__(self, n: int, schema: StructType):
        self.n, self.schema = n, schema
        self.at, self.event_id = (schema.names.index(c) for c in ("at", "event_id"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getMapState("newest", "key string", StructType([StructField("rows", ArrayType(self.schema))]))

    def _order(self, row: tuple) -> tuple:
        known = row[self.event_id] is not None
        return row[self.at], known, row[self.event_id] if known else 0

    def _values(self, column: pd.Series, kind: DataType) -> list:
        made = int if isinstance(kind, IntegralType) else pd.Timestamp.to_pydatetime if isinstance(kind, TimestampType) else lambda v: v
        return [made(v) if known else None for v, known in zip(column, column.notna())]

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.schema.names, dtype="object")
        return out.assign(**{f.name: pd.to_datetime(out[f.name]) for f in self.schema if isinstance(f.dataType, TimestampType)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[str, list[tuple]] = {}
        for part in rows:
            columns = [self._values(part[f.name], f.dataType) for f in self.schema]
            for name, *row in zip(part["state_key"], *columns):
                fresh.setdefault(name, []).append(tuple(row))
        lists: list[tuple] = []
        for name, new in fresh.items():
            held = self.newest.getValue((name,)) if self.newest.containsKey((name,)) else ([],)
            newest = sorted(new + [tuple(r) for r in held[0]], key=self._order, reverse=True)[: self.n]
            self.newest.updateValue((name,), (newest,))
            lists += newest
            if len(lists) >= self.ROWS:
                yield self._frame(lists)
                lists = []
        if lists:
            yield self._frame(lists)

    def close(self) -> None:
        pass


def recent_stream(stream: DataFrame, store: list[str], folder: str, n: int = 800, buckets: int = 256) -> None:
    """Keeps the newest n events of each store; each batch writes the lists that it changed to <folder>/recent.

    Stores are dealt to `buckets` groups of state.
    """
    bucket = F.pmod(F.xxhash64("state_key"), F.lit(buckets)).alias("state_bucket")
    keyed = stream.filter("at is not null").withColumn("state_key", _key(store)).select("*", bucket)
    lists = keyed.groupBy("state_bucket").transformWithStateInPandas(_Recent(n, stream.schema), outputStructType=stream.schema, outputMode="Update", timeMode="None")
    with _rocks(stream.sparkSession):
        run_available(lists, folder, lambda batch, number: emit(batch, folder, "recent", number), "Update")


def recent_lists(spark: SparkSession, folder: str, store: list[str]) -> DataFrame:
    """The current list of each store: that of the last batch that changed it."""
    every = read_output(spark, folder, "recent")
    last = every.groupBy(*store).agg(F.max("batch").alias("batch"))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"l.{c}")) for c in [*store, "batch"]]
    return every.alias("e").join(last.alias("l"), same).select("e.*").drop("batch")


def vitals_stream(stream: DataFrame, folder: str, idle_ms: int = 30 * 60_000, delay_ms: int = 60_000, sample_gap_ms: int = 8000, keep: int = 60):
    """session_vitals once per visit, when it has been idle for idle_ms; rows go to <folder>/vitals.

    A session that wakes up after being idle counts as a new one (`session_start` tells them apart). Visits are
    session windows; the state holds the long tasks and interactions of open visits and sums of the rest. Gives the
    finished query, whose progress counts the late rows.
    """
    visits = stream.withWatermark("at", f"{delay_ms} milliseconds").groupBy("session", F.session_window("at", f"{idle_ms} milliseconds").alias("visit"))
    value, of = F.col("value"), lambda kind: F.when(F.col("kind") == kind, F.col("value"))
    shown = (F.col("kind") == "interaction") & (F.coalesce("interaction_id", F.lit(0)) != 0) & (value > 0) & F.coalesce("name", F.lit("")).isin("", *events.INTERACTIONS)
    order = [F.unix_millis("at").alias("ms"), F.col("event_id").alias("tie")]
    summed = visits.agg(
        F.max(of("lcp")).alias("lcp"), F.sum(F.when(~F.coalesce("recent_input", F.lit(False)), of("shift"))).alias("cls"), F.max(of("navigation")).alias("ttfb"),
        F.count_if(F.col("kind").isin("lcp", "shift", "navigation")).alias("others"),
        F.collect_list(F.when(F.col("kind") == "longtask", F.struct(*order, value.cast("double").alias("value")))).alias("tasks"),
        F.collect_list(F.when(shown, F.struct(F.struct("at", "event_id").alias("first"), F.col("interaction_id").alias("id"), value.alias("value")))).alias("shown"),
    )
    tasks = F.aggregate(
        F.array_sort("tasks"), F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("most")),
        lambda s, t: F.when(
            s["last"].isNull() | (t["ms"] - s["last"] >= sample_gap_ms),
            F.struct(t["ms"].alias("last"), (s["n"] + F.when(t["value"] > 0, 1).otherwise(0)).alias("n"), F.greatest(s["most"], t["value"]).alias("most")),
        ).otherwise(s),
    )
    # The last interactions in order of first appearance, each with its slowest event; the nearest-rank p98 of these.
    ids = F.slice(F.reverse(F.array_distinct(F.transform(F.array_sort("shown"), lambda x: x["id"]))), 1, keep)
    slowest = F.array_sort(F.transform(ids, lambda i: F.array_max(F.transform(F.filter("shown", lambda x: x["id"] == i), lambda x: x["value"]))))
    done = summed.select(F.col("session").cast("string").alias("session"), F.col("visit.start").alias("session_start"), "lcp", "cls", "ttfb", "others", tasks.alias("t"), slowest.alias("d"), F.size("tasks").alias("seen"))
    rank = F.ceil(F.size("d") * F.lit(98) / 100).cast("int")
    inp = F.when(F.size("d") > 0, F.element_at("d", F.greatest(rank, F.lit(1))))
    plus = lambda c: F.when(c > 0, c)
    rounded = lambda c: scores.round_half_up(plus(c))
    out = done.filter((F.col("others") > 0) | (F.col("seen") > 0) | (F.size("d") > 0)).select(
        "session", rounded(F.col("lcp")).alias("lcp_ms"), plus(F.floor(F.col("cls") * 1000 + 0.5) / 1000).alias("cls"), rounded(F.col("ttfb")).alias("ttfb_ms"),
        rounded(inp).alias("inp_ms"), plus(F.col("t.n")).alias("long_task_count"), rounded(F.col("t.most")).alias("long_task_max_ms"), "session_start",
    )
    return _to_files(out, folder, "vitals")


def session_starts(entries: DataFrame, idle_ms: int) -> DataFrame:
    """Adds `started`: the first time of the visit an entry belongs to (a pause of idle_ms ends a visit).

    Visits are found on a small table with one row per session and minute (so idle_ms is at
    least a minute) and joined back, so no session's entries are gathered in one place.
    """
    minute = F.date_trunc("minute", "at")
    minutes = entries.groupBy("session", minute.alias("_minute")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    by_time = Window.partitionBy("session").orderBy("_minute")
    gap = F.unix_millis("lo") - F.unix_millis(F.lag("hi").over(by_time))
    fresh = F.when(F.coalesce(gap < idle_ms, F.lit(False)), F.lit(None)).otherwise(F.col("lo"))
    starts = minutes.withColumn("started", F.last(fresh, ignorenulls=True).over(by_time)).select("session", "_minute", "started")
    return entries.withColumn("_minute", minute).join(starts, ["session", "_minute"]).drop("_minute")


def vitals_of(entries: DataFrame, sample_gap_ms: int, keep: int) -> DataFrame:
    """session_vitals per visit."""
    visit = F.concat_ws("|", "session", F.unix_micros("started").cast("string"))
    out = events.session_vitals(entries.withColumn("session", visit), sample_gap_ms, keep)
    parts = F.split("session", r"\|")
    return out.withColumn("session_start", F.timestamp_micros(parts[1].cast("bigint"))).withColumn("session", parts[0])


def emit(df: DataFrame, folder: str, name: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")


def run_available(stream: DataFrame, folder: str, step: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Processes everything available now in micro-batches, then stops."""
    query = (
        stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def ingest_stream(stream: DataFrame, sources: DataFrame, folder: str, settings: Settings = Settings(), rules: dict = feeds.LISTING_RULES) -> None:
    """Every micro-batch of fetched bodies is one run on top of what is published in `folder`.

    stream: source_id, body_no, body, http_status, fetch_ok, parse_error, duration_ms, fetched_at. The run's
    clock is the newest fetched_at. Items are published by day, and a run rewrites only the days that it changes
    (plans.sync.sync_days); status rows go to <folder>/runs, run summaries to <folder>/history. A replayed batch
    sees what was published before its clock, so it writes the same again.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            clock = batch.agg(F.max("fetched_at")).first()[0]
            if clock is None:
                return
            now = F.lit(clock).cast("timestamp")
            meta = F.struct("http_status", "fetch_ok", "parse_error", "duration_ms", "fetched_at")
            fetched = batch.groupBy("source_id").agg(F.max_by(meta, F.struct("fetched_at", "body_no")).alias("m"), F.count(F.lit(1)).alias("attempts")).select("source_id", "m.*", "attempts")
            sync_days(StoredRun(batch.sparkSession, folder, batch_id), batch.select("source_id", "body_no", "body"), fetched, sources, now, settings, rules)
        finally:
            batch.unpersist()

    run_available(stream, folder, step)
