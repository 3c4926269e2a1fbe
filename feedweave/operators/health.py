"""Source health, run summaries and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions import scores


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest status row of each source."""
    return runs.groupBy("source_id").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "source_id"]), "run_ts").alias("r")).select("source_id", "r.*")


def source_health(runs: DataFrame) -> DataFrame:
    level = scores.health_level(F.col("ok"), F.col("used"), F.col("consecutive_fails"), F.col("duration_ms"))
    return runs.select("source_id", level.alias("source_health")).withColumn(
        "source_health_score", scores.health_score(F.col("source_health"))
    )


def attach_health(posts: DataFrame, health: DataFrame) -> DataFrame:
    """Left join; a source without status has null level and score 0."""
    by_source = health.select("source_id", "source_health", "source_health_score")
    out = posts.join(by_source, "source_id", "left")
    return out.withColumn("source_health_score", F.coalesce("source_health_score", F.lit(0)))


def _count(cond: Column, name: str) -> Column:
    return F.count_if(cond).alias(name)


def health_summary(sources: DataFrame, health: DataFrame) -> DataFrame:
    """Counts per level; a source without status counts as good."""
    level = F.coalesce("source_health", F.lit("good"))
    t = sources.select("source_id").join(health, "source_id", "left").select(level.alias("lv"))
    names = ("excellent", "good", "warn", "down")
    total = t.agg(
        F.count(F.lit(1)).alias("total"),
        *[_count(F.col("lv") == n, n) for n in names],
        _count(scores.is_stable(F.col("lv")), "stable"),
    )
    ratio = scores.round_half_up(F.col("stable") * 100.0 / F.col("total"))
    return total.withColumn("stable_ratio", F.when(F.col("total") > 0, ratio).otherwise(F.lit(0)).cast("int"))


def _is_stale(stale_after: int) -> Column:
    hours = scores.stale_hours(F.col("latest_published_at"), F.col("run_ts"))
    return F.coalesce(hours >= stale_after, F.lit(False))


def _error_has(text: str) -> Column:
    return F.lower(F.coalesce("error", F.lit(""))).contains(text)


def summarize_run(runs: DataFrame, stale_after: int = 72) -> DataFrame:
    """One history row per run."""
    ok = F.coalesce("ok", F.lit(False))
    return runs.groupBy("run_ts").agg(
        F.count(F.lit(1)).alias("total_sources"),
        _count(ok, "ok_sources"),
        _count(~ok, "err_sources"),
        F.sum(F.coalesce("item_count", F.lit(0))).alias("total_items"),
        F.sum(F.coalesce("new_item_count", F.lit(0))).alias("total_new_items"),
        _count(F.col("consecutive_fails") >= 3, "flaky_sources"),
        _count(_is_stale(stale_after), "stale_sources"),
        _count(_error_has("parse_empty"), "parse_empty"),
        _count(_error_has("parse_drop"), "parse_drop"),
    )


def run_report(runs: DataFrame) -> DataFrame:
    ok = F.coalesce("ok", F.lit(False))
    return runs.groupBy("run_ts").agg(
        F.count(F.lit(1)).alias("total_sources"),
        _count(ok, "ok_sources"),
        _count(~ok, "err_sources"),
        F.sum(F.coalesce("item_count", F.lit(0))).alias("total_items"),
        F.sum(F.coalesce("visible_item_count", F.lit(0))).alias("visible_items"),
        F.sum(F.coalesce("new_item_count", F.lit(0))).alias("new_items"),
        *[_count(F.col("used") == u, u) for u in ("fetched", "cached", "fallback")],
    )


def problem_sources(runs: DataFrame) -> DataFrame:
    """Per run: the first 18 failed sources, 12 flakiest and 8 slowest."""
    failed = ~F.coalesce("ok", F.lit(False))
    flaky = failed & (F.col("consecutive_fails") >= 3)
    lists = (
        ("failed", failed, [F.col("source_id")], 18),
        ("flaky", flaky, [F.col("consecutive_fails").desc(), F.col("source_id")], 12),
        ("slowest", F.lit(True), [F.col("duration_ms").desc(), F.col("source_id")], 8),
    )
    out = None
    for name, cond, order, k in lists:
        rank = F.row_number().over(Window.partitionBy("run_ts").orderBy(*order))
        part = (
            runs.filter(cond).withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("run_ts", F.lit(name).alias("list"), "rank", "source_id", "duration_ms", "consecutive_fails")
        )
        out = part if out is None else out.unionByName(part)
    return out


def success_pct(ok: Column, total: Column) -> Column:
    pct = F.greatest(F.lit(0), F.least(F.lit(100), scores.round_half_up(ok * 100.0 / F.nullif(total, F.lit(0)))))
    return F.when(total > 0, pct).otherwise(F.lit(0)).cast("int")


def history_trend(history: DataFrame, n: int = 30) -> DataFrame:
    """The last n runs as a trend; nothing unless there are at least two runs."""
    last = history.orderBy(F.col("run_ts").desc()).limit(max(n, 2))
    runs = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))  # max(n, 2) rows at most
    last = last.withColumn("_runs", runs).filter("_runs >= 2")
    return last.orderBy(F.col("run_ts").desc()).limit(n).select(
        "run_ts",
        success_pct(F.col("ok_sources"), F.col("total_sources")).alias("success_pct"),
        F.col("err_sources").alias("errors"),
        F.col("total_new_items").alias("new_items"),
    )


def sparkline_points(series: DataFrame, w: float = 120, h: float = 40, pad: float = 2) -> DataFrame:
    """Points of each series (series, seq, value) scaled into a w x h box.

    A series is a trend of a few dozen points (history_trend bounds it).
    """
    whole = Window.partitionBy("series")
    lo, hi = F.min("value").over(whole), F.max("value").over(whole)
    span = F.when(hi - lo == 0, F.lit(1.0)).otherwise((hi - lo).cast("double"))
    i = F.row_number().over(whole.orderBy("seq")) - 1
    n = F.count(F.lit(1)).over(whole)
    inner_w, inner_h = max(1.0, w - pad * 2), max(1.0, h - pad * 2)
    step = F.when(n > 1, F.lit(inner_w) / (n - 1)).otherwise(F.lit(0.0))
    return series.select(
        "series", "seq",
        F.round(F.lit(float(pad)) + step * i, 2).alias("x"),
        F.round(F.lit(float(pad)) + F.lit(inner_h) * (1 - (F.col("value") - lo) / span), 2).alias("y"),
    )
