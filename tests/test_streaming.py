"""Streams give what the batch operators give on the same rows in order."""

import datetime
import os
import tempfile
import types

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedweave.config import Settings
from feedweave.operators import events, throttle
from feedweave.plans.sync import POST_SCHEMA, RUN_STATE, StoredRun, sync, sync_days
from feedweave.sources import dimension
from feedweave.streaming import jobs
from feedweave.streaming.jobs import read_output
from verification import adapters as a
from verification.cases_events import entries

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def as_stream(spark, df, order, parts):
    """One micro-batch per file, in order."""
    path = folder()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df.repartitionByRange(parts, order).sortWithinPartitions(order).write.mode("overwrite").parquet(path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for i, f in enumerate(sorted(f for f in os.listdir(path) if f.endswith(".parquet"))):
        os.utime(f"{path}/{f}", (1e9 + i * 100,) * 2)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def ids(df):
    return {r.event_id for r in df.select("event_id").collect()}


def test_throttle_stream_equals_batch(spark):
    t, out, keys = a.telemetry(spark, SF), folder(), ["type", "path", "lang", "device"]
    jobs.throttle_stream(as_stream(spark, t, "at", 3), keys, out, HOUR)
    assert ids(read_output(spark, out, "kept")) == ids(throttle.throttle_events(t, keys, HOUR))


def test_late_rows_are_dropped_and_counted(spark):
    base = datetime.datetime(2026, 1, 1)
    at = lambda m: base + datetime.timedelta(minutes=m)
    rows = [(0, at(0), "k", 0), (1, at(120), "k", 0), (2, at(180), "k", 1), (3, at(240), "k", 2), (4, at(1), "k", 3), (5, at(1), "new", 3), (6, at(241), "k", 3)]
    df = spark.createDataFrame(rows, "event_id bigint, at timestamp, type string, part int")
    out = folder()
    query = jobs.throttle_stream(as_stream(spark, df, "part", 4), ["type"], out, 10_000, delay_ms=60_000)
    assert ids(read_output(spark, out, "kept")) == {0, 1, 2, 3, 6}
    progress = query.recentProgress
    assert sum(s.numRowsDroppedByWatermark for p in progress for s in p.stateOperators) == 2
    assert len([p for p in progress if p.numInputRows]) > 2
    assert progress[-1].stateOperators[0].numRowsTotal <= 2  # keys that can suppress nothing more are forgotten


def test_rows_within_the_delay_may_be_out_of_order(spark):
    base = datetime.datetime(2026, 1, 1)
    rows = [(i, base + datetime.timedelta(seconds=s), "k", part) for i, (s, part) in enumerate([(5, 0), (0, 0), (30, 0), (20, 1), (39, 1), (40, 1), (41, 2), (50, 2)])]
    df = spark.createDataFrame(rows, "event_id bigint, at timestamp, type string, part int")
    out = folder()
    jobs.throttle_stream(as_stream(spark, df, "part", 3), ["type"], out, 10_000, delay_ms=60_000)
    assert ids(read_output(spark, out, "kept")) == {1, 2, 5, 7}  # 3 is older than the kept 2, 4 and 6 follow too soon


def test_recent_stream_equals_batch(spark):
    t, out = a.telemetry(spark, SF), folder()
    jobs.recent_stream(as_stream(spark, t, "at", 3), ["session"], out, 4)
    assert len(os.listdir(f"{out}/recent")) >= 3
    assert sorted(map(repr, jobs.recent_lists(spark, out, ["session"]).collect())) == sorted(map(repr, events.recent_events(t, ["session"], 4).collect()))


class Held(dict):
    """A map of state; counts what is read and written."""

    asked = 0

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        self.asked += 1
        return self[key]

    def updateValue(self, key, value):
        self.asked += 1
        self[key] = value


def test_recent_lists_of_a_bucket_are_one_group():
    """One call for all stores of a bucket, and one read and write for each store of the batch; values stay as they are."""
    schema = StructType.fromDDL("event_id bigint, at timestamp, session bigint, value double")
    held, big, at = Held(), 2**60 + 1, lambda s: datetime.datetime(2026, 1, 1, 0, 0, s)
    keeper = jobs._Recent(2, schema)
    keeper.init(types.SimpleNamespace(getMapState=lambda *_: held))

    def batch(*rows):
        made = pd.DataFrame([(*r, str(r[2])) for r in rows], columns=[*schema.names, "state_key"]).astype({"at": "datetime64[us]"})
        return {tuple(None if pd.isna(v) else v for v in r) for part in keeper.handleInputRows((0,), iter([made[:2], made[2:]]), None) for r in part.itertuples(index=False)}

    assert batch((1, at(5), 1, 0.5), (2, at(1), 1, 0.5), (3, at(9), 1, 0.5), (big, at(2), 2, None)) == {(3, at(9), 1, 0.5), (1, at(5), 1, 0.5), (big, at(2), 2, None)}
    assert held.asked == 2
    assert batch((4, at(7), 1, None), (5, at(2), 3, 1.0)) == {(3, at(9), 1, 0.5), (4, at(7), 1, None), (5, at(2), 3, 1.0)}
    assert held.asked == 2 + 3 and len(held) == 3


def test_vitals_stream_gives_closed_visits(spark):
    e, out, idle = entries(spark, SF), folder(), 48 * HOUR
    jobs.vitals_stream(as_stream(spark, e, "at", 3), out, idle_ms=idle, delay_ms=0, sample_gap_ms=HOUR)
    got = read_output(spark, out, "vitals")
    batch = jobs.vitals_of(jobs.session_starts(e, idle), HOUR, 60)
    closed = e.groupBy("session").agg(F.max("at").alias("last")).join(e.agg(F.max("at").alias("end")), F.expr("last < end - interval 48 hours"))
    rows = {tuple(r) for r in got.collect()}
    every = {tuple(r) for r in batch.select(*got.columns).collect()}
    assert rows and rows <= every
    assert {str(r.session) for r in closed.collect()} <= {r.session for r in got.collect()}


RSS = "<rss><channel>{}</channel></rss>"
ITEM = "<item><title>T{0}</title><link>https://e.com/{0}</link><pubDate>2026-01-0{1}</pubDate></item>"


def test_ingest_stream_carries_state(spark):
    sources = dimension.load_sources(spark, [
        {"id": s, "name": s, "kind": "feed", "url": f"https://{s}.e.com/feed", "category": "anime"} for s in ("a", "b")
    ])
    t = lambda h: datetime.datetime(2026, 1, 8, h)
    rows = [
        ("a", 0, RSS.format(ITEM.format("1", 1) + ITEM.format("2", 2)), 200, True, None, 5, t(1)), ("b", 0, RSS.format(ITEM.format("3", 3)), 200, True, None, 5, t(1)),
        ("a", 1, RSS.format(ITEM.format("4", 4)), 200, True, None, 5, t(2)), ("b", 1, None, 503, False, None, 5, t(2)),
        ("a", 2, None, 304, True, None, 5, t(3)), ("b", 2, None, 500, False, None, 5, t(3)),
    ]
    df = spark.createDataFrame(rows, "source_id string, body_no int, body string, http_status int, fetch_ok boolean, parse_error string, duration_ms int, fetched_at timestamp")
    out = folder()
    jobs.ingest_stream(as_stream(spark, df, "fetched_at", 3), sources, out)
    stored = StoredRun(spark, out, 3)
    assert {(r.title, r.day.day, r.first_run.hour) for r in stored.posts().collect()} == {("T1", 1, 1), ("T2", 2, 1), ("T3", 3, 1), ("T4", 4, 2)}
    history = {r.generated_at.hour: (r.total_sources, r.err_sources, r.total_items, r.total_new_items) for r in stored.history().collect()}
    assert history == {1: (2, 0, 3, 3), 2: (2, 1, 2, 1), 3: (2, 1, 4, 0)}
    assert [r.generated_at.hour for r in stored.history(1).collect()] == [3]
    runs = {(r.run_ts.hour, r.source_id): (r.used, r.consecutive_fails, r.new_item_count) for r in read_output(spark, out, "runs").collect()}
    assert runs == {
        (1, "a"): ("fetched", 0, 2), (1, "b"): ("fetched", 0, 1), (2, "a"): ("fetched", 0, 1), (2, "b"): ("fallback", 1, 0),
        (3, "a"): ("cached", 0, 0), (3, "b"): ("fallback", 2, 0),
    }


def test_rate_limit_stream_without_keys(spark):
    t, out = a.telemetry(spark, SF).filter("type = 'error'"), folder()
    jobs.throttle_stream(as_stream(spark, t, "at", 2), [], out, 2 * HOUR)
    assert ids(read_output(spark, out, "kept")) == ids(throttle.rate_limit(t, 2 * HOUR))


def posts_of(stored):
    return sorted((r.title, str(r.published_at), r.summary) for r in stored.posts().collect())


def test_run_by_days_publishes_what_sync_does_and_repeats(spark):
    """Replaced items that change their day, a source that goes, a window that moves; each run is done twice."""
    make = lambda names: dimension.load_sources(spark, [{"id": s, "name": s, "kind": "feed", "url": f"https://{s}.e.com/feed", "category": "anime"} for s in names])
    item = "<item><title>{0}</title><link>https://e.com/{0}</link><pubDate>2026-01-{1:02d}</pubDate><description>{2}</description></item>"
    runs = [
        ("ab", 10, {"a": [("x", 3, "s"), ("y", 9, "s"), ("z", 2, "s")], "b": [("q", 8, "s"), ("r", 4, "s")]}),
        ("ab", 11, {"a": [("x", 5, "longer"), ("y", 9, ""), ("n", 11, "s")], "b": []}),
        ("a", 13, {"a": [("m", 12, "s"), ("y", 1, "a much longer text of an old day")]}),
    ]
    out, settings = folder(), Settings(days=7)
    schema = "source_id string, body_no int, body string"
    full, status = spark.createDataFrame([], POST_SCHEMA), spark.createDataFrame([], RUN_STATE)
    for number, (names, hour, found) in enumerate(runs):
        sources, now = make(names), F.lit(datetime.datetime(2026, 1, hour)).cast("timestamp")
        bodies = spark.createDataFrame([(s, 0, RSS.format("".join(item.format(*i) for i in items))) for s, items in found.items()], schema)
        fetched = spark.createDataFrame([(s, 200, True, None, 5) for s in found], "source_id string, http_status int, fetch_ok boolean, parse_error string, duration_ms int")
        stored = StoredRun(spark, out, number)
        files = lambda: {d: sorted(os.listdir(f"{out}/posts/{d}")) for d in os.listdir(f"{out}/posts") if d.startswith("day=")}
        before = files() if number else {}
        sync_days(stored, bodies, fetched, sources, now, settings)
        result = sync(bodies, fetched, sources, full, status, None, now, settings)
        want = sorted((r.title, str(r.published_at), r.summary) for r in result.posts.collect())
        assert posts_of(stored) == want
        compare = ("source_id", "used", "consecutive_fails", "item_count", "new_item_count", "visible_items")
        rows = lambda t: sorted(map(tuple, t.select(*compare).collect()))
        first = rows(spark.read.parquet(f"{out}/runs/batch={number}"))
        assert first == rows(result.runs)
        same = {d for d in before if before[d] == files().get(d)}
        sync_days(stored, bodies, fetched, sources, now, settings)
        assert posts_of(stored) == want and rows(spark.read.parquet(f"{out}/runs/batch={number}")) == first
        full, status = result.posts, result.runs.selectExpr("source_id", "ok", "cast(consecutive_fails as int) as consecutive_fails")
        if number == 1:
            assert "day=2026-01-08" in same  # nothing new fell on that day
