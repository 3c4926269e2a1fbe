"""Neighbouring and related items of a category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions.dates import DAY_MS
from feedweave.operators import ordering

RADIUS = 40
BLOCK = 512  # rows per window group, so no group grows with the category


def _ordered(posts: DataFrame, columns: list[str]) -> DataFrame:
    """List order inside a category: newest first, then arrival."""
    slim = posts.select("category", "arrival", "published_at", *columns)
    return ordering.pieces(slim, ["category"], [F.col("published_at").desc(), F.col("arrival")])


def adjacent_posts(posts: DataFrame) -> DataFrame:
    """Ids of the next newer and next older item of the category."""
    out = ordering.neighbours(_ordered(posts, ["id"]), ["category"], ["id"], "newer", "older")
    return out.select("id", "category", F.col("newer.id").alias("newer_id"), F.col("older.id").alias("older_id"))


def related_posts(posts: DataFrame, now: Column, limit: int = 6, radius: int = RADIUS) -> DataFrame:
    """The best `limit` of the items within `radius` list positions in the same category.

    Positions are cut into blocks; rows near a cut are copied to the next block,
    so each block answers its own rows with one bounded window frame. No pair
    is ever shuffled.
    """
    lowered = F.transform(F.filter(F.col("tags"), lambda t: t.isNotNull() & (t != "")), F.lower)
    slim = posts.withColumn("tags", F.coalesce(lowered, F.array().cast("array<string>")))
    slim = slim.withColumn("has_cover", F.coalesce("cover", F.lit("")) != "")
    slim = slim.withColumn("has_summary", F.coalesce("summary", F.lit("")) != "")
    placed = ordering.positions(_ordered(slim, ["id", "source_id", "tags", "has_cover", "has_summary"]), ["category"])
    home = F.floor(F.col("pos") / BLOCK)
    offset = F.col("pos") - home * BLOCK
    copies = F.array_compact(
        F.array(home, F.when((offset < radius) & (home > 0), home - 1), F.when(offset >= BLOCK - radius, home + 1))
    )
    spread = placed.withColumn("_home", home).withColumn("_block", F.explode(copies))
    frame = Window.partitionBy("category", "_block").orderBy("pos").rowsBetween(-radius, radius)
    near = F.collect_list(F.struct("pos", "id", "source_id", "published_at", "tags", "has_cover", "has_summary"))
    framed = spread.withColumn("_near", near.over(frame)).filter(F.col("_home") == F.col("_block"))

    def score(p: Column) -> Column:
        age_days = (F.unix_millis(now) - F.unix_millis(p["published_at"])) / F.lit(float(DAY_MS))
        fresh = F.greatest(F.lit(0.0), F.lit(1.2) - F.greatest(F.lit(0.0), age_days) / 10)
        fresh = F.when(p["published_at"].isNull(), F.lit(0.0)).otherwise(fresh)
        shared = F.size(F.filter(p["tags"], lambda t: F.array_contains(F.col("tags"), t)))
        value = (
            F.when(p["source_id"] == F.col("source_id"), F.lit(4.0)).otherwise(F.lit(0.0))
            + F.when(p["has_cover"], F.lit(0.8)).otherwise(F.lit(0.0))
            + F.when(p["has_summary"], F.lit(0.2)).otherwise(F.lit(0.0))
            + shared
            + fresh
        )
        return F.round(value, 9)

    others = F.filter(F.col("_near"), lambda p: p["id"] != F.col("id"))
    ranked = F.array_sort(
        F.transform(
            others,
            lambda p: F.struct(
                (-score(p)).alias("s"), (-F.unix_millis(p["published_at"])).alias("t"), p["pos"].alias("pos"), p["id"].alias("id")
            ),
        )
    )
    top = framed.select("id", F.posexplode(F.slice(ranked, 1, limit)).alias("i", "r"))
    return top.select("id", (F.col("i") + 1).alias("rank"), F.col("r.id").alias("related_id"), (-F.col("r.s")).alias("score"))
