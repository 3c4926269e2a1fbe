"""Search rows built from items, repaired from stored rows, and the slim display copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions.text import WS, normalize_text

TEXTS = ("title", "title_zh", "title_ja", "summary", "summary_zh", "summary_ja", "preview", "preview_zh", "preview_ja")


def _clean_tags(c: Column) -> Column:
    tags = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: normalize_text(F.coalesce(t, F.lit(""))))
    return F.filter(tags, lambda t: t != "")


def build_search_index(posts: DataFrame) -> DataFrame:
    """One search row per item, keyed by item id: normalized haystack and facets."""
    rows = posts.select(
        "id", *[F.coalesce(t, F.lit("")).alias(t) for t in TEXTS],
        F.coalesce("source_id", F.lit("")).alias("source_id"),
        _clean_tags(F.col("tags")).alias("tags"),
        normalize_text(F.coalesce("source_name", F.lit(""))).alias("source_name"),
        normalize_text(F.coalesce("source_id", F.lit(""))).alias("source_id_norm"),
        normalize_text(F.coalesce("category", F.lit(""))).alias("category"),
        F.unix_millis("published_at").alias("published_ms"),
    )
    words = [F.col(t) for t in TEXTS] + [F.array_join("tags", " "), F.col("source_name"), F.col("source_id_norm"), F.col("category")]
    return rows.select(
        "id", normalize_text(F.concat_ws(" ", *words)).alias("hay"), "tags",
        "source_name", "source_id", "source_id_norm", "category", "published_ms",
    )


def slim_search_posts(posts: DataFrame) -> DataFrame:
    """Display columns only; a missing summary is replaced by the preview."""
    return posts.select(
        "id", "title", "title_zh", "title_ja",
        F.coalesce("summary", "preview").alias("summary"),
        F.coalesce("summary_zh", "preview_zh").alias("summary_zh"),
        F.coalesce("summary_ja", "preview_ja").alias("summary_ja"),
        "url", "published_at", "cover", "category", "tags", "source_id", "source_name", "source_url",
    )


# A text that is more than white space and marks without width, so that something is left of it when it is normalized.
SHOWS = rf"[^{WS[1:-1]}\u200b-\u200d]"


def repair_rows(index: DataFrame) -> DataFrame:
    """Normalizes stored rows again and drops rows without id or haystack."""
    rows = index.filter((F.coalesce("id", F.lit("")) != "") & F.col("hay").rlike(SHOWS))
    return rows.select(
        "id", normalize_text(F.col("hay")).alias("hay"), _clean_tags(F.col("tags")).alias("tags"),
        normalize_text(F.coalesce("source_name", F.lit(""))).alias("source_name"),
        F.coalesce("source_id", F.lit("")).alias("source_id"),
        normalize_text(F.coalesce("source_id_norm", "source_id", F.lit(""))).alias("source_id_norm"),
        normalize_text(F.coalesce("category", F.lit(""))).alias("category"), "published_ms",
    )


def repair_search_index(index: DataFrame, posts: DataFrame) -> DataFrame:
    """The repaired stored rows of the items, and fresh rows for the items that have none."""
    repaired = repair_rows(index)
    fresh = build_search_index(posts.join(repaired.select("id"), "id", "left_anti"))  # of the stored rows only the ids are read
    return repaired.join(posts.select("id"), "id", "left_semi").unionByName(fresh)
