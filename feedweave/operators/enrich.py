"""Covers and previews: which pages to read, and what to take from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.config import Settings
from feedweave.functions import text, urls
from feedweave.functions.dates import HOUR_MS


def _blank(name: str) -> Column:
    return F.coalesce(name, F.lit("")) == ""


def with_wants(posts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds what an item lacks: a usable cover, a text long enough to show."""
    no_cover = _blank("cover") | urls.is_non_cover_image(F.col("cover"))
    short = _blank("summary") | (F.length("summary") < settings.preview_min_len)
    return posts.withColumn("lacks_cover", no_cover).withColumn("want_preview", _blank("preview") & short).withColumn(
        "want_cover", no_cover & ~urls.is_blocked_cover(F.col("cover"))
    )


def _recent_miss(missed: str, now: Column, hours: int) -> Column:
    age = F.unix_millis(now) - F.unix_millis(missed)
    return F.coalesce((age >= 0) & (age < hours * HOUR_MS), F.lit(False)) if hours > 0 else F.lit(False)


def drop_recent_misses(candidates: DataFrame, fetch_state: DataFrame, now: Column, settings: Settings = Settings()) -> DataFrame:
    """Skips an item when everything it wants was missing on its page not long ago."""
    state = fetch_state.select("url", "cover_miss_at", "preview_miss_at")
    c = candidates.join(state, "url", "left")
    cover = ~F.col("want_cover") | _recent_miss("cover_miss_at", now, settings.cover_miss_hours)
    preview = ~F.col("want_preview") | _recent_miss("preview_miss_at", now, settings.preview_miss_hours)
    return c.filter(~(cover & preview)).drop("cover_miss_at", "preview_miss_at")


def cap_per_source(candidates: DataFrame, per_source: int = 0, total: int = 0) -> DataFrame:
    """At most per_source items of a source and total items (0: all): missing covers first, then newest.

    The rank filter also runs before the shuffle, so no source is gathered whole.
    """
    order = [F.col("lacks_cover").desc(), F.col("published_at").desc_nulls_last(), F.col("arrival")]
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(*order))
    if per_source > 0:
        candidates = candidates.withColumn("_rank", rank).filter(F.col("_rank") <= per_source).drop("_rank")
    return candidates.orderBy(*order).limit(total) if total > 0 else candidates


def page_candidates(posts: DataFrame, fetch_state: DataFrame, now: Column, settings: Settings = Settings()) -> DataFrame:
    """Items whose pages should be read this run."""
    wants = with_wants(posts, settings).filter("lacks_cover or want_preview")
    return cap_per_source(drop_recent_misses(wants, fetch_state, now, settings), settings.enrich_per_source, settings.enrich_max)


def join_page_fields(posts: DataFrame, fields: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Takes cover and preview found on a page (url, page_cover, page_preview) where the item lacks them."""
    f = fields.groupBy("url").agg(F.first("page_cover", True).alias("page_cover"), F.first("page_preview", True).alias("page_preview"))
    p = with_wants(posts, settings).join(f, "url", "left")
    preview = text.strip_truncate(F.col("page_preview"), settings.preview_max_len)
    return (
        p.withColumn("cover", F.when(F.col("want_cover"), F.coalesce("page_cover", "cover")).otherwise(F.col("cover")))
        .withColumn("preview", F.when(F.col("want_preview"), F.coalesce(preview, F.col("preview"))).otherwise(F.col("preview")))
        .drop("page_cover", "page_preview", "lacks_cover", "want_cover", "want_preview")
    )


def update_fetch_state(fetch_state: DataFrame, tried: DataFrame, fields: DataFrame, now: Column) -> DataFrame:
    """Records hits and misses of this run's pages (tried: url, want_cover, want_preview)."""
    f = fields.select("url", "page_cover", "page_preview")
    t = tried.select("url", "want_cover", "want_preview").join(f, "url")
    new = t.select(
        "url", *[
            c for kind in ("cover", "preview") for c in (
                F.when(F.col(f"want_{kind}") & F.col(f"page_{kind}").isNull(), now).alias(f"_{kind}_miss"),
                F.when(F.col(f"want_{kind}") & F.col(f"page_{kind}").isNotNull(), now).alias(f"_{kind}_ok"),
            )
        ],
    )
    s = fetch_state.join(new, "url", "full")
    kept = [c for c in fetch_state.columns if c not in ("url", "cover_miss_at", "preview_miss_at", "cover_ok_at", "preview_ok_at")]
    out = [F.col("url"), *kept]
    for kind in ("cover", "preview"):
        out.append(F.when(F.col(f"_{kind}_ok").isNull(), F.coalesce(f"_{kind}_miss", f"{kind}_miss_at")).alias(f"{kind}_miss_at"))
        out.append(F.coalesce(f"_{kind}_ok", f"{kind}_ok_at").alias(f"{kind}_ok_at"))
    return s.select(*out)


def reset_missing_assets(posts: DataFrame, assets: DataFrame, folder: str = "/covers/") -> DataFrame:
    """A local cover whose file is gone goes back to its original address, or to nothing."""
    have = assets.filter("size > 0").select(F.col("path").alias("cover")).distinct().withColumn("_have", F.lit(True))
    p = posts.join(have, "cover", "left")
    lost = F.coalesce(F.col("cover").startswith(folder), F.lit(False)) & F.col("_have").isNull()
    back = F.when(urls.is_http(F.col("cover_original")), F.col("cover_original"))
    return p.withColumn("cover", F.when(lost, back).otherwise(F.col("cover"))).drop("_have")


def cover_candidates(posts: DataFrame, n: int = 260) -> DataFrame:
    """Newest items with a remote cover that may be copied."""
    usable = urls.is_http(F.col("cover")) & ~urls.is_blocked_cover(F.col("cover"))
    return posts.filter(usable).orderBy(F.col("published_at").desc(), "arrival").limit(n)
