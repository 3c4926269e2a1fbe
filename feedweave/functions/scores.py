"""Ranking and health columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions.dates import HOUR_MS

HEALTH_SCORES = {"excellent": 4, "good": 3, "warn": 1, "down": 0}
HEALTH_BOOST = {"excellent": 8.0, "good": 4.0, "warn": 0.0, "down": -8.0}


def _lookup(level: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(level == name, F.lit(value)).otherwise(out)
    return out


def round_half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def health_level(ok: Column, used: Column, fails: Column, duration_ms: Column) -> Column:
    fails = F.coalesce(fails, F.lit(0))
    fast = (fails == 0) & (used == "fetched") & (duration_ms > 0) & (duration_ms <= 1200)
    return (
        F.when(~F.coalesce(ok, F.lit(False)), F.lit("down"))
        .when((fails >= 2) | F.coalesce(used == "fallback", F.lit(False)), F.lit("warn"))
        .when(F.coalesce(fast, F.lit(False)), F.lit("excellent"))
        .otherwise(F.lit("good"))
    )


def health_score(level: Column) -> Column:
    return _lookup(level, HEALTH_SCORES, 0)


def is_stable(level: Column) -> Column:
    return F.coalesce(level.isin("excellent", "good"), F.lit(False))


def pulse_score(at: Column, tags: Column, cover: Column, summary: Column, preview: Column, health: Column, now: Column) -> Column:
    age = (F.unix_millis(now) - F.unix_millis(at)) / F.lit(float(HOUR_MS))
    # greatest() ignores nulls, so an unknown date is handled first
    age = F.when(age.isNull(), F.lit(999.0)).otherwise(F.greatest(F.lit(0.0), age))
    recency = F.greatest(F.lit(0.0), F.lit(100.0) - age * 4)
    tag_boost = F.least(F.lit(18), F.coalesce(F.size(tags), F.lit(0)) * 3)
    cover_boost = F.when(F.coalesce(cover, F.lit("")) != "", F.lit(6)).otherwise(F.lit(0))
    length = F.length(F.coalesce(summary, preview, F.lit("")))
    text_boost = F.when(length >= 160, F.lit(6)).when(length >= 80, F.lit(3)).otherwise(F.lit(0))
    raw = round_half_up(recency + tag_boost + cover_boost + text_boost + _lookup(health, HEALTH_BOOST, 0.0))
    return F.greatest(F.lit(0), F.least(F.lit(120), raw)).cast("int")


def stale_hours(latest: Column, run_at: Column) -> Column:
    gap = F.unix_millis(run_at) - F.unix_millis(latest)
    return F.greatest(F.lit(0), gap) / F.when(gap.isNotNull(), F.lit(float(HOUR_MS)))


def diagnose_source(ok: Column, stale: Column, fails: Column, status: Column, error: Column, stale_after: int = 72) -> Column:
    """Cause code of a source's state; null when nothing is wrong."""
    err = F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(ok & F.coalesce(stale >= stale_after, F.lit(False)), F.lit("stale"))
        .when(ok, F.lit(None).cast("string"))
        .when(F.coalesce(fails >= 3, F.lit(False)), F.lit("failing_repeatedly"))
        .when(F.coalesce(status == 429, F.lit(False)), F.lit("rate_limited"))
        .when(F.coalesce(status.isin(401, 403), F.lit(False)), F.lit("blocked"))
        .when(F.coalesce(status == 404, F.lit(False)), F.lit("moved"))
        .when(err.contains("parse_empty") | err.contains("parse_drop"), F.lit("parse_problem"))
        .when(err.contains("timeout") | err.contains("aborted"), F.lit("timeout"))
        .otherwise(F.lit("other"))
    )
