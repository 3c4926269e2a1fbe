"""Merging one run with what was published before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.config import Settings
from feedweave.functions import dates


def merge_snapshots(previous: DataFrame, chosen: DataFrame) -> DataFrame:
    """Previous items then this run's items; `arrival` keeps that order.

    `phase` is 0 for previous and 1 for new rows, and arrival becomes the pair
    (phase, arrival), so no global numbering is needed.
    """
    a = previous.withColumn("arrival", F.struct(F.lit(0).alias("phase"), F.col("arrival").alias("seq")))
    b = chosen.withColumn("arrival", F.struct(F.lit(1).alias("phase"), F.col("arrival").alias("seq")))
    return a.unionByName(b, allowMissingColumns=True)


def keep_known_sources(posts: DataFrame, sources: DataFrame) -> DataFrame:
    return posts.join(sources.select("source_id").distinct(), "source_id", "left_semi")


def dedupe_by_url(posts: DataFrame) -> DataFrame:
    """One item per URL (case ignored): longest summary plus 20 for a cover; later arrival wins ties.

    `first_arrival` is where the URL was first seen, the tie-break of the newest-first order.
    """
    score = F.length(F.coalesce("summary", F.lit(""))) + F.when(
        F.coalesce("cover", F.lit("")) != "", F.lit(20)
    ).otherwise(F.lit(0))
    best = F.max_by(F.struct(*posts.columns), F.struct(score, F.col("arrival"))).alias("best")
    grouped = posts.groupBy(F.lower("url").alias("_key")).agg(best, F.min("arrival").alias("first_arrival"))
    return grouped.select("best.*", "first_arrival")


def newest_first() -> list[Column]:
    return [F.col("published_at").desc(), F.col("first_arrival")]


def within_days(posts: DataFrame, days: int, now: Column) -> DataFrame:
    return posts.filter(dates.within_days(F.col("published_at"), days, now))


def latest(posts: DataFrame, n: int, tie: str = "arrival") -> DataFrame:
    return posts.orderBy(F.col("published_at").desc(), F.col(tie)).limit(n)


def items_by_source(posts: DataFrame) -> DataFrame:
    return posts.groupBy("source_id").agg(F.count(F.lit(1)).alias("items"))


def source_visibility(posts: DataFrame) -> DataFrame:
    return posts.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("visible_items"), F.max("published_at").alias("latest_published_at")
    )


def with_visibility(runs: DataFrame, posts: DataFrame) -> DataFrame:
    seen = source_visibility(posts)
    out = runs.drop("visible_items", "latest_published_at").join(seen, "source_id", "left")
    return out.withColumn("visible_items", F.coalesce("visible_items", F.lit(0)))


def count_new_items(current: DataFrame, previous: DataFrame) -> DataFrame:
    """New ids per source; sources with nothing new get 0."""
    old = previous.select("source_id", "id").distinct().withColumn("_old", F.lit(True))
    marked = current.select("source_id", "id").join(old, ["source_id", "id"], "left")
    return marked.groupBy("source_id").agg(F.count_if(F.col("_old").isNull()).alias("new_items"))


def carry_fail_streak(runs: DataFrame, previous: DataFrame) -> DataFrame:
    """Failures in a row, continued from the previous run's status table."""
    prev = previous.select(
        "source_id", F.col("consecutive_fails").alias("_fails"), F.col("ok").alias("_ok")
    )
    before = F.coalesce(F.col("_fails"), F.when(F.col("_ok") == F.lit(False), F.lit(1)).otherwise(F.lit(0)))
    out = runs.drop("consecutive_fails").join(prev, "source_id", "left")
    return out.withColumn("consecutive_fails", F.when(F.col("ok"), F.lit(0)).otherwise(before + 1)).drop("_fails", "_ok")


def fail_streaks(runs: DataFrame) -> DataFrame:
    """Failures in a row for every run of the whole history.

    A window per source holds one row per run, so its size is the number of runs, not of items.
    """
    by_time = Window.partitionBy("source_id").orderBy("run_ts")
    island = F.sum(F.col("ok").cast("int")).over(by_time)
    marked = runs.withColumn("_island", island)
    rank = F.row_number().over(Window.partitionBy("source_id", "_island").orderBy("run_ts"))
    starts_ok = F.max(F.col("ok")).over(Window.partitionBy("source_id", "_island"))
    fails = F.when(F.col("ok"), F.lit(0)).otherwise(rank - starts_ok.cast("int"))
    return marked.withColumn("consecutive_fails", fails.cast("int")).drop("_island")


def fallback_decisions(fetched: DataFrame, raw_counts: DataFrame, previous: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per source: which items to publish and why.

    fetched: source_id, http_status, fetch_ok, parse_error; raw_counts: source_id, raw_items
    (before the include filter); previous: published items.
    """
    prev = previous.groupBy("source_id").agg(F.count(F.lit(1)).alias("prev_items"))
    t = fetched.join(raw_counts, "source_id", "left").join(prev, "source_id", "left")
    t = t.withColumn("raw_items", F.coalesce("raw_items", F.lit(0)))
    t = t.withColumn("prev_items", F.coalesce("prev_items", F.lit(0)))
    floor = F.greatest(F.lit(settings.drop_min_keep), F.floor(F.col("prev_items") * settings.drop_ratio))
    shrunk = (F.col("prev_items") >= settings.drop_min_prev) & (F.col("raw_items") < floor)
    cached = F.col("fetch_ok") & (F.col("http_status") == 304)
    reason = (
        F.when(cached, F.lit(None).cast("string"))
        .when(~F.col("fetch_ok"), F.lit("fetch_error"))
        .when(F.col("parse_error").isNotNull(), F.col("parse_error"))
        .when(F.col("raw_items") == 0, F.lit("parse_empty"))
        .when(shrunk, F.lit("parse_drop"))
    )
    used = F.when(cached, F.lit("cached")).when(reason.isNotNull(), F.lit("fallback")).otherwise(F.lit("fetched"))
    return t.select(
        "source_id", "http_status", "raw_items", "prev_items",
        used.alias("used"), (used != "fallback").alias("ok"), reason.alias("error"),
    )


def apply_source_fallback(items: DataFrame, previous: DataFrame, decisions: DataFrame) -> DataFrame:
    """This run's items for fetched sources, previous items for the others."""
    fetched = decisions.filter(F.col("used") == "fetched").select("source_id")
    kept = decisions.filter(F.col("used") != "fetched").select("source_id")
    return items.join(fetched, "source_id", "left_semi").unionByName(
        previous.join(kept, "source_id", "left_semi"), allowMissingColumns=True
    )


def merge_history(old: DataFrame, new: DataFrame, keep: int = 0) -> DataFrame:
    """Union of run summaries; the later appended row wins a time stamp; the newest `keep` stay (0 = all)."""
    both = old.withColumn("_phase", F.lit(0)).unionByName(new.withColumn("_phase", F.lit(1)))
    latest_row = F.max_by(F.struct(*old.columns), F.struct("_phase", "arrival"))
    merged = both.groupBy("generated_at").agg(latest_row.alias("best")).select("best.*")
    return merged.orderBy(F.col("generated_at").desc()).limit(keep) if keep > 0 else merged


def missing_sources(configured: DataFrame, seen: DataFrame) -> DataFrame:
    """Configured but not seen, and seen but not configured."""
    a = configured.select("source_id").distinct()
    b = seen.select("source_id").distinct()
    return a.join(b, "source_id", "left_anti").withColumn("problem", F.lit("not_seen")).unionByName(
        b.join(a, "source_id", "left_anti").withColumn("problem", F.lit("not_configured"))
    )
