"""Enrichment of items with everything the boards rank by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from feedweave.operators import boards, health


def enrich_metrics(posts: DataFrame, latest_runs: DataFrame, now: Column) -> DataFrame:
    """Health, duplicate counts, reading time and pulse score of every item."""
    with_health = health.attach_health(posts, health.source_health(latest_runs))
    return boards.with_scores(boards.with_duplicate_counts(with_health), now)
