"""Ranked lists and counts shown on boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions import scores, text
from feedweave.functions.dates import DAY_MS, HOUR_MS
from feedweave.operators.skew import lookup_by_key


def best_title() -> Column:
    return F.coalesce("title_zh", "title_ja", "title", F.lit(""))


def with_duplicate_counts(posts: DataFrame) -> DataFrame:
    """Duplicate key of the best title (id when empty) and how many items share it."""
    key = text.dedup_key(best_title())
    keyed = posts.withColumn("dedup_key", text.bind(key, lambda k: F.coalesce(F.nullif(k, F.lit("")), F.col("id"))))
    counts = keyed.groupBy("dedup_key").agg(F.count(F.lit(1)).alias("duplicate_count"))
    return lookup_by_key(keyed, counts, "dedup_key", "duplicate_count", "id")


def with_scores(posts: DataFrame, now: Column) -> DataFrame:
    """Reading time (kept when present) and pulse score; needs source_health."""
    body = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", "preview", F.lit("")))
    minutes = text.read_minutes(body)
    if "read_minutes" in posts.columns:
        minutes = F.coalesce("read_minutes", minutes)
    pulse = scores.pulse_score(*[F.col(c) for c in ("published_at", "tags", "cover", "summary", "preview", "source_health")], now)
    return posts.withColumn("read_minutes", minutes).withColumn("pulse_score", pulse)


def recent(posts: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Not older than the window; future rows stay."""
    return posts.filter(F.unix_millis("published_at") >= F.unix_millis(now) - F.lit(hours * HOUR_MS))


def top_tags(posts: DataFrame, now: Column, n: int = 12) -> DataFrame:
    """Most used tags of the last day, with where each was first seen; ties keep that order."""
    tags = recent(posts, now).select("arrival", F.posexplode("tags").alias("at", "tag"))
    counted = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("arrival", "at")).alias("first"))
    return counted.orderBy(F.col("count").desc(), "first").limit(n)


def hot_tags(posts: DataFrame, now: Column, n: int = 12) -> DataFrame:
    return top_tags(posts, now, n).select("tag", "count")


def category_counts(posts: DataFrame, categories: DataFrame, now: Column) -> DataFrame:
    """Last-day items of every configured category, zero included."""
    counted = recent(posts, now).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return categories.select("category").join(counted, "category", "left").select(
        "category", F.coalesce("n", F.lit(0)).alias("items")
    )


def _age_ms(now: Column) -> Column:
    return F.unix_millis(now) - F.unix_millis("published_at")


def _lens(now: Column) -> list[Column]:
    age = _age_ms(now)
    return [F.count_if((age >= 0) & (age <= h * HOUR_MS)).alias(f"h{h}") for h in (2, 6, 24)]


def time_lens_counts(posts: DataFrame, now: Column) -> DataFrame:
    """Items of the last 2, 6, 24 hours; future and undated rows count nowhere."""
    return posts.agg(*_lens(now))


def category_overview(posts: DataFrame, now: Column) -> DataFrame:
    """Per category: size, recency counts, best pulse, share of stable sources."""
    by_source = posts.groupBy("category", "source_id").agg(
        F.count(F.lit(1)).alias("n"),
        *_lens(now),
        F.max(F.coalesce("pulse_score", F.lit(0))).alias("p"),
        F.max(scores.is_stable(F.col("source_health")).cast("int")).alias("stable"),
    )
    has_source = F.coalesce("source_id", F.lit("")) != ""
    ratio = scores.round_half_up(F.col("stable_sources") * 100.0 / F.nullif("sources", F.lit(0)))
    return (
        by_source.groupBy("category").agg(
            F.sum("n").alias("total"),
            *[F.sum(c).alias(c) for c in ("h2", "h6", "h24")],
            F.greatest(F.lit(0), F.max("p")).alias("top_pulse"),
            F.count_if(has_source).alias("sources"),
            F.count_if(has_source & (F.col("stable") == 1)).alias("stable_sources"),
        )
        .withColumn("stable_ratio", F.coalesce(ratio, F.lit(0)).cast("int"))
    )


def top_token(tokens: DataFrame) -> DataFrame:
    """Most frequent token (token, seen); ties: longer, then first seen."""
    counted = tokens.filter(F.col("token") != "").groupBy("token").agg(
        F.count(F.lit(1)).alias("count"), F.min("seen").alias("first")
    )
    return counted.orderBy(F.col("count").desc(), F.length("token").desc(), "first").limit(1).select("token", "count")


def tag_tokens(posts: DataFrame) -> DataFrame:
    exploded = posts.select("arrival", F.posexplode("tags").alias("at", "tag"))
    return exploded.select(text.normalize_text(F.col("tag")).alias("token"), F.struct("arrival", "at").alias("seen"))


def source_tokens(posts: DataFrame) -> DataFrame:
    return posts.select(
        text.normalize_text(F.col("source_name")).alias("token"), F.struct("arrival", F.lit(0).alias("at")).alias("seen")
    )


def pulse_top(posts: DataFrame, now: Column, n: int = 6) -> DataFrame:
    return recent(posts, now).orderBy(F.col("pulse_score").desc(), "arrival").limit(n)


def spotlight(posts: DataFrame, now: Column, n: int = 6) -> DataFrame:
    covered = F.coalesce("cover", F.lit("")) != ""
    return recent(posts, now).orderBy(covered.desc(), F.col("pulse_score").desc(), "arrival").limit(n)


def random_pick(posts: DataFrame, k: int = 200, seed: int = 0) -> DataFrame:
    """One row of the newest k, chosen by a seeded hash so that reruns agree."""
    newest = posts.orderBy(F.col("published_at").desc(), "arrival").limit(k)
    return newest.orderBy(F.sha1(F.concat(F.lit(f"{seed}:"), "id"))).limit(1)


def sort_posts(posts: DataFrame, mode: str = "latest") -> DataFrame:
    if mode == "pulse":
        return posts.orderBy(F.col("pulse_score").desc(), F.col("published_at").desc(), "arrival")
    return posts.orderBy("arrival")


def brief_lines(posts: DataFrame, lang: str, now: Column, n: int = 10, bullet: bool = False) -> DataFrame:
    """Numbered (or bulleted) digest lines of the first n recent items in list order."""
    top = recent(posts, now).orderBy(F.col("published_at").desc(), "arrival").limit(n)
    rows = F.sort_array(F.collect_list(F.struct((-F.unix_millis("published_at")).alias("o"), "arrival", text.pick_localized("title", lang).alias("t"))))
    lines = top.agg(rows.alias("rows")).select(F.posexplode("rows").alias("i", "r"))  # n rows at most
    label = F.lit("- ") if bullet else F.concat((F.col("i") + 1).cast("string"), F.lit(". "))
    return lines.select((F.col("i") + 1).alias("line_no"), F.concat(label, F.col("r.t")).alias("line"))
