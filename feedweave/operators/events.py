"""Usage events: recent lists, session vitals, request health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions import scores
from feedweave.operators import ordering, throttle

INTERACTIONS = ("click", "keydown", "pointerdown", "pointerup")


def recent_events(events: DataFrame, store: list[str], n: int = 800) -> DataFrame:
    """The newest n events of each store (the rank filter is applied before the shuffle too)."""
    rank = F.row_number().over(Window.partitionBy(*store).orderBy(F.col("at").desc(), F.col("event_id").desc()))
    return events.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def session_vitals(entries: DataFrame, sample_gap_ms: int = 8000, keep: int = 60) -> DataFrame:
    """One row per session: LCP, CLS, TTFB, long tasks and INP.

    entries: session, at, event_id, kind (lcp / shift / longtask / interaction /
    navigation), name, value, recent_input, interaction_id. Long tasks are
    sampled; INP is the nearest-rank p98 of the slowest event of each of the
    last `keep` interactions (in order of first appearance).
    """
    tasks = throttle.rate_limit(entries.filter("kind = 'longtask'"), sample_gap_ms, ("session",))
    rest = entries.filter("kind in ('lcp', 'shift', 'navigation')")
    value = F.col("value")
    of = lambda kind: F.when(F.col("kind") == kind, value)
    base = rest.unionByName(tasks).groupBy("session").agg(
        F.max(of("lcp")).alias("lcp"),
        F.sum(F.when(~F.coalesce("recent_input", F.lit(False)), of("shift"))).alias("cls"),
        F.max(of("navigation")).alias("ttfb"),
        F.count(F.when(value > 0, of("longtask"))).alias("tasks"),
        F.max(of("longtask")).alias("task_max"),
    )
    named = F.coalesce("name", F.lit("")).isin("", *INTERACTIONS)
    shown = entries.filter((F.col("kind") == "interaction") & (F.coalesce("interaction_id", F.lit(0)) != 0) & (value > 0) & named)
    per = shown.groupBy("session", "interaction_id").agg(F.max("value").alias("d"), F.min(F.struct("at", "event_id")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.col("first").desc()))
    last = per.withColumn("_rank", rank).filter(F.col("_rank") <= keep)
    inp = last.groupBy("session").agg(F.expr("percentile_disc(0.98) within group (order by d)").alias("inp"))
    t = base.join(inp, "session", "full")
    rounded = lambda c: scores.round_half_up(_positive(F.col(c)))
    return t.select(
        "session", rounded("lcp").alias("lcp_ms"), _positive(F.floor(F.col("cls") * 1000 + 0.5) / 1000).alias("cls"),
        rounded("ttfb").alias("ttfb_ms"), rounded("inp").alias("inp_ms"),
        _positive(F.col("tasks")).alias("long_task_count"), rounded("task_max").alias("long_task_max_ms"),
    )


def request_health(requests: DataFrame, slow_ms: int = 1800, hold_ms: int = 4500) -> DataFrame:
    """State after every request event of a session.

    requests: session, at, event_id, phase (start / end), duration_ms, ok, url.
    `active` never falls below 0: it is the running balance minus its lowest
    value so far. `slow` holds for `hold_ms` after the last slow end.
    """
    ms = F.unix_millis("at")
    ended = F.col("phase") == "end"
    t = requests.withColumn("_d", F.when(ended, -1).otherwise(1)).withColumn("_ms", ms)
    t = t.withColumn("_slow_at", F.when(ended & (F.col("duration_ms") >= slow_ms), F.col("_ms")))
    failed = ended & ~F.coalesce("ok", F.lit(False))
    t = t.withColumn("_err", F.when(failed, F.struct("at", "event_id", F.coalesce("url", F.lit("")).alias("url"))))
    t = t.select("session", "at", "event_id", "phase", "_d", "_ms", "_slow_at", "_err")
    cut = ordering.pieces(t, ["session"], [F.col("at"), F.col("event_id")])
    cut = ordering.running(cut, ["session"], {"_sum": ("sum", F.col("_d")), "_slow": ("max", F.col("_slow_at")), "_last": ("max", F.col("_err"))})
    cut = ordering.running(cut, ["session"], {"_low": ("min", F.col("_sum"))})
    return cut.select(
        "session", "event_id", "at", "phase",
        (F.col("_sum") - F.least(F.lit(0), F.col("_low"))).alias("active"),
        F.coalesce(F.col("_ms") - F.col("_slow") < hold_ms, F.lit(False)).alias("slow"),
        F.col("_last.at").alias("last_error_at"), F.col("_last.url").alias("last_error_url"),
    )
