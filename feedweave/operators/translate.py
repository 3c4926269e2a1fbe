"""Which texts still need translating, and putting finished translations back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave import config
from feedweave.functions import text

LIMITS = {"title": 180, "summary": 420, "preview": 520}  # longest translated text per field


def cache_key(target: Column, source: Column) -> Column:
    return F.sha1(F.concat(target, F.lit("::"), text.trim_ws(source)))


def _languages(sources: DataFrame) -> DataFrame:
    return sources.select("source_id", F.col("lang").alias("_lang"))


def wanted_texts(posts: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, field, target, text) for every field that lacks a language it needs."""
    p = posts.join(_languages(sources), "source_id", "left")
    wants = [
        F.when(
            text.needs_translation(F.col("_lang"), F.col(f), F.col(f"{f}_{t}"), t),
            F.struct(F.lit(f).alias("field"), F.lit(t).alias("target"), F.col(f).alias("text")),
        )
        for f in LIMITS
        for t in config.OUTPUT_LANGS
    ]
    return p.select("id", F.explode(F.array_compact(F.array(*wants))).alias("w")).select("id", "w.*")


def translation_candidates(posts: DataFrame, sources: DataFrame, n: int = 0) -> DataFrame:
    """The first n items (0: all), in list order, that need any translation."""
    p = posts.join(_languages(sources), "source_id", "left")
    found = p.filter(text.post_needs_translation(F.col("_lang"))).drop("_lang")
    return found.orderBy("arrival").limit(n) if n > 0 else found


def translation_worklist(posts: DataFrame, sources: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct (key, target, text) not in the cache. Blank cached texts do not count."""
    wanted = wanted_texts(posts, sources)
    keyed = wanted.select(cache_key(F.col("target"), F.col("text")).alias("key"), "target", text.trim_ws(F.col("text")).alias("text"))
    have = cache.filter(text.trim_ws(F.coalesce("text", F.lit(""))) != "").select("key")
    # Equal keys carry equal texts, so the aggregate removes copies before the shuffle.
    work = keyed.filter("text <> ''").groupBy("key").agg(F.first("target").alias("target"), F.first("text").alias("text"))
    return work.join(have, "key", "left_anti")


def run_provider(worklist: DataFrame, translate: Callable[[list[str], str], list[str]]) -> DataFrame:
    """Applies a user's function (texts, target) -> texts to the work list, batch by batch."""

    def batches(frames):
        for pdf in frames:
            out = pdf[["key", "target"]].copy()
            out["text"] = ""
            for target, part in pdf.groupby("target"):
                out.loc[part.index, "text"] = translate(list(part["text"]), target)
            yield out

    return worklist.mapInPandas(batches, "key string, target string, text string")


def apply_translations(posts: DataFrame, sources: DataFrame, cache: DataFrame) -> DataFrame:
    """Fills the translated columns from the cache; a text equal to its source is not applied."""
    wanted = wanted_texts(posts, sources).withColumn("key", cache_key(F.col("target"), F.col("text")))
    found = wanted.join(cache.select("key", F.col("text").alias("done")), "key")
    good = found.filter((text.trim_ws(F.coalesce("done", F.lit(""))) != "") & (F.col("done") != F.col("text")))
    cells = [
        F.max(F.when((F.col("field") == f) & (F.col("target") == t), text.strip_truncate(F.col("done"), n))).alias(f"_{f}_{t}")
        for f, n in LIMITS.items()
        for t in config.OUTPUT_LANGS
    ]
    out = posts.join(good.groupBy("id").agg(*cells), "id", "left")
    for f in LIMITS:
        for t in config.OUTPUT_LANGS:
            out = out.withColumn(f"{f}_{t}", F.coalesce(f"{f}_{t}", f"_{f}_{t}")).drop(f"_{f}_{t}")
    return out
