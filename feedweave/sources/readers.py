"""Readers of published JSON documents. Bad values never fail a read: they drop a row or become null.

Each `parse_*` works on a table with JSON text (column `json`); the `read_*`
functions apply it to files, one document per file or one record per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave import config
from feedweave.functions.dates import parse_published
from feedweave.functions.text import trim_ws

POST_TEXTS = (
    "title", "titleZh", "titleJa", "summary", "summaryZh", "summaryJa", "preview", "previewZh", "previewJa",
    "url", "cover", "coverOriginal", "sourceId", "sourceName", "sourceUrl",
)
REQUIRED_TEXTS = ("title", "url", "sourceId", "sourceName", "sourceUrl")


def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _text(v: Column, path: str) -> Column:
    """The value only if it is JSON text."""
    return F.when(F.schema_of_variant(_at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def _number(v: Column, path: str) -> Column:
    """The value only if it is a JSON number."""
    is_number = F.schema_of_variant(_at(v, path)).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.when(is_number, F.try_variant_get(v, path, "double"))


def _version_is(v: Column, path: str, n: int) -> Column:
    return F.coalesce(_number(v, path) == n, F.lit(False))


def _items(docs: DataFrame, path: str, version: str | None = None) -> DataFrame:
    """Explodes the array at `path`; documents with another version or shape give no rows."""
    doc = docs.withColumn("doc", F.try_parse_json("json"))
    if version:
        doc = doc.filter(_version_is(F.col("doc"), version, 1))
    items = F.try_variant_get("doc", path, "array<variant>")
    return doc.withColumn("v", F.explode(items)).drop("json")


def parse_posts(docs: DataFrame, layout: str = "lines", categories: tuple = config.CATEGORIES) -> DataFrame:
    """Item records. Rows without a text id vanish; an unknown category becomes the first one."""
    rows = _items(docs, "$") if layout == "array" else docs.withColumn("v", F.try_parse_json("json"))
    v = F.col("v")
    texts = []
    for name in POST_TEXTS:
        value = _text(v, f"$.{name}")
        texts.append((F.coalesce(value, F.lit("")) if name in REQUIRED_TEXTS else value).alias(snake(name)))
    tags = F.try_variant_get(v, "$.tags", "array<variant>")
    texts_only = F.filter(tags, lambda t: F.schema_of_variant(t) == "STRING")
    category = _text(v, "$.category")
    return rows.select(
        _text(v, "$.id").alias("id"), *texts, _text(v, "$.publishedAt").alias("published_raw"),
        parse_published(_text(v, "$.publishedAt")).alias("published_at"),
        F.when(category.isin(*categories), category).otherwise(F.lit(categories[0])).alias("category"),
        F.coalesce(F.transform(texts_only, lambda t: F.variant_get(t, "$", "string")), F.array().cast("array<string>")).alias("tags"),
    ).filter(F.coalesce("id", F.lit("")) != "")


RUN_DEFAULT_ZERO = ("durationMs", "itemCount")
RUN_NUMBERS = ("newItemCount", "visibleItemCount", "httpStatus", "attempts", "waitMs", "consecutiveFails", "rawItemCount", "filteredItemCount")


def parse_source_runs(docs: DataFrame) -> DataFrame:
    """Status documents, one row per source and run."""
    rows, v = _items(docs, "$.sources"), F.col("v")
    used = _text(v, "$.used")
    return rows.select(
        parse_published(_text(F.col("doc"), "$.generatedAt")).alias("run_ts"),
        F.coalesce(_text(v, "$.id"), F.lit("")).alias("source_id"),
        F.coalesce(_text(v, "$.name"), F.lit("")).alias("name"),
        F.coalesce(_text(v, "$.kind"), F.lit("")).alias("kind"),
        _text(v, "$.url").alias("url"),
        F.coalesce(F.try_variant_get(v, "$.ok", "boolean"), F.lit(False)).alias("ok"),
        *[F.coalesce(_number(v, f"$.{n}"), F.lit(0.0)).cast("bigint").alias(snake(n)) for n in RUN_DEFAULT_ZERO],
        *[_number(v, f"$.{n}").cast("bigint").alias(snake(n)) for n in RUN_NUMBERS],
        parse_published(_text(v, "$.latestPublishedAt")).alias("latest_published_at"),
        F.when(used.isin("fetched", "cached", "fallback"), used).alias("used"),
        _text(v, "$.error").alias("error"),
    )


HISTORY_NUMBERS = (
    "durationMs", "totalSources", "okSources", "errSources", "totalItems", "totalNewItems",
    "flakySources", "staleSources", "parseEmpty", "parseDrop",
)


def parse_run_history(docs: DataFrame) -> DataFrame:
    """Version 1 history entries whose time stamp and ten numbers are all there."""
    rows, v = _items(docs, "$.entries", "$.v"), F.col("v")
    out = rows.select(_text(v, "$.generatedAt").alias("generated_at"), *[_number(v, f"$.{n}").alias(snake(n)) for n in HISTORY_NUMBERS])
    complete = F.coalesce("generated_at", F.lit("")) != ""
    for n in HISTORY_NUMBERS:
        complete = complete & F.col(snake(n)).isNotNull()
    return out.filter(complete)


def parse_telemetry(docs: DataFrame) -> DataFrame:
    """Version 1 event stores; events without type or time are dropped."""
    rows, v = _items(docs, "$.events", "$.version"), F.col("v")
    out = rows.select(
        *[_text(v, f"$.{n}").alias(n) for n in ("type", "at")], F.coalesce(_text(v, "$.path"), F.lit("")).alias("path"),
        *[_text(v, f"$.{n}").alias(n) for n in ("lang", "device")],
        F.when(F.schema_of_variant(_at(v, "$.data")).startswith("OBJECT"), F.to_json(_at(v, "$.data"))).alias("data"),
    )
    return out.filter((F.coalesce("type", F.lit("")) != "") & (F.coalesce("at", F.lit("")) != ""))


def parse_bookmarks(docs: DataFrame) -> DataFrame:
    """Bookmark files: a bare array of ids or an object with `ids`; other values are ignored."""
    doc = F.try_parse_json("json")
    ids = F.coalesce(F.try_variant_get(doc, "$.ids", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"))
    t = docs.withColumn("v", F.explode(ids))
    return t.filter(F.schema_of_variant("v") == "STRING").select(*[c for c in docs.columns if c != "json"], F.variant_get("v", "$", "string").alias("post_id"))


def merge_bookmarks(current: DataFrame, imported: DataFrame) -> DataFrame:
    """Set union of (user_id, post_id); `added` marks the ids that were not there before."""
    keys = ["user_id", "post_id"]
    both = current.select(*keys, F.lit(0).alias("n")).unionByName(imported.select(*keys, F.lit(1).alias("n")))
    return both.groupBy(*keys).agg((F.min("n") == 1).alias("added"))


def parse_saved_views(docs: DataFrame) -> DataFrame:
    """Version 1 saved views with a short hint of what they show."""
    rows, v = _items(docs, "$.presets", "$.version"), F.col("v")
    rows = rows.filter(_version_is(v, "$.version", 1))
    snap_type = F.schema_of_variant(_at(v, "$.snapshot"))
    query = trim_ws(F.coalesce(_text(v, "$.snapshot.q"), F.lit("")))
    lens, sort = _text(v, "$.snapshot.filters.timeLens"), _text(v, "$.snapshot.filters.sortMode")
    has_filters = F.coalesce(F.schema_of_variant(_at(v, "$.snapshot.filters")).startswith("OBJECT"), F.lit(False))
    short = F.when(F.length(query) > 72, F.concat(F.substring(query, 1, 72), F.lit("…"))).otherwise(query)
    choice = F.concat_ws(
        " · ",
        F.when(lens.isin("2h", "6h", "24h", "all"), lens).otherwise(F.lit("all")),
        F.when(sort.isin("pulse", "latest"), sort).otherwise(F.lit("latest")),
    )
    out = rows.select(
        _text(v, "$.id").alias("id"), _text(v, "$.name").alias("name"), _number(v, "$.createdAt").cast("bigint").alias("created_at"),
        F.when(query != "", short).when(has_filters, choice).otherwise(F.lit("")).alias("hint"), snap_type.startswith("OBJECT").alias("_snap"),
    )
    good = (F.coalesce("id", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "") & (F.coalesce("created_at", F.lit(0)) != 0)
    return out.filter(good & F.coalesce("_snap", F.lit(False))).drop("_snap")


def _documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.text(path, wholetext=not lines).withColumnRenamed("value", "json")


def read_posts(spark: SparkSession, path: str, layout: str = "lines", categories: tuple = config.CATEGORIES) -> DataFrame:
    return parse_posts(_documents(spark, path, layout == "lines"), layout, categories)


def read_source_runs(spark: SparkSession, path: str) -> DataFrame:
    return parse_source_runs(_documents(spark, path))


def read_run_history(spark: SparkSession, path: str) -> DataFrame:
    return parse_run_history(_documents(spark, path))


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return parse_telemetry(_documents(spark, path))


def read_saved_views(spark: SparkSession, path: str) -> DataFrame:
    return parse_saved_views(_documents(spark, path)).orderBy(F.col("created_at").desc(), "id")
