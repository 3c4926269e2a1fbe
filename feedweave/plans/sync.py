"""One run: fetched bodies plus what was published before give the next published tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.config import Settings
from feedweave.functions import dates, text, urls
from feedweave.operators import enrich, health, merge, pages
from feedweave.session import checkpoint
from feedweave.sources import feeds, search_index
from feedweave.sources.dimension import include_filter

POST_COLUMNS = (
    "id", "title", "title_zh", "title_ja", "summary", "summary_zh", "summary_ja", "preview", "preview_zh", "preview_ja",
    "url", "published_at", "cover", "cover_original", "category", "tags", "source_id", "source_name", "source_url", "arrival",
)


def raw_items(bodies: DataFrame, sources: DataFrame, rules: dict = feeds.LISTING_RULES) -> DataFrame:
    """Items of all bodies (source_id, body_no, body), by the kind of their source."""
    kinds = sources.select("source_id", "kind")
    b = bodies.join(kinds, "source_id").filter("body is not null")
    from_feeds = feeds.project_feed_items(feeds.parse_feeds(b.filter("kind = 'feed'").drop("kind")), sources)
    from_pages = feeds.parse_listing(b.filter("kind = 'html'").drop("kind"), rules)
    return from_feeds.unionByName(from_pages)


def build_posts(items: DataFrame, sources: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Raw items to posts: include rule, canonical URL, stable id, cut texts, tags, source columns."""
    kept = include_filter(items, sources)
    s = sources.selectExpr(
        "source_id", "name as source_name", "category", "coalesce(homepage, url) as _home", "url as _feed"
    )
    t = kept.withColumn("url", urls.normalize_url(F.col("url"))).filter("url is not null").join(s, "source_id")
    t = t.withColumn("title", text.strip_truncate(F.col("title"), 180)).withColumn("summary", F.nullif(text.strip_truncate(F.col("summary"), 360), F.lit("")))
    tags = text.derive_tags(F.col("title"), F.col("summary"), F.col("category"), settings.tag_rules)
    out = t.select(
        F.sha1("url").alias("id"), "title", "summary", "url", "published_at", "cover", "category", tags.alias("tags"), "source_id", "source_name",
        F.coalesce(urls.normalize_url(F.col("_home")), F.col("_feed")).alias("source_url"),
        F.struct(F.col("body_no").cast("bigint").alias("body_no"), F.col("item_no").cast("bigint").alias("item_no")).alias("arrival"),
    )
    for name in POST_COLUMNS:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
    return out.select(*POST_COLUMNS)


@dataclass(frozen=True)
class SyncResult:
    posts: DataFrame
    runs: DataFrame
    history: DataFrame
    search_rows: DataFrame  # the search index of the snapshot
    search_posts: DataFrame  # its slim display copy


def published_order(posts: DataFrame) -> DataFrame:
    """Arrival of published items in the next run: newest first, then by id."""
    order = F.struct((-F.unix_millis("published_at")).alias("body_no"), F.xxhash64("id").alias("item_no"))
    return posts.withColumn("arrival", order).select(*POST_COLUMNS)


def _decided(bodies: DataFrame, fetched: DataFrame, sources: DataFrame, known: DataFrame, settings: Settings, rules: dict) -> tuple[DataFrame, DataFrame]:
    """This run's posts, and a row per source saying whether they are used. Items feed both, so they are parsed once."""
    items = checkpoint(raw_items(bodies, sources, rules))
    raw_counts = items.groupBy("source_id").agg(F.count(F.lit(1)).alias("raw_items"))
    # One row per source, read by the joins that follow.
    return build_posts(items, sources, settings), checkpoint(merge.fallback_decisions(fetched, raw_counts, known, settings))


def _status_rows(decisions: DataFrame, fetched: DataFrame, sources: DataFrame, built: DataFrame, known: DataFrame, previous_runs: DataFrame, now: Column) -> DataFrame:
    """Status rows of a run but for what is visible after it: a source's items are this run's or its previous ones."""
    counted = built.groupBy("source_id").agg(F.count(F.lit(1)).alias("_built"))
    new = merge.count_new_items(built, known).withColumnRenamed("new_items", "_new")
    about = [c for c in ("duration_ms", "fetched_at", "attempts") if c in fetched.columns]
    runs = decisions.join(counted, "source_id", "left").join(new, "source_id", "left").join(fetched.select("source_id", *about), "source_id", "left")
    used = F.col("used") == "fetched"
    runs = runs.join(sources.select("source_id", "name", "kind", "url"), "source_id", "left").select(
        now.alias("run_ts"), "source_id", "name", "kind", "url", "http_status", *about, "used", "ok", "error", "raw_items", "prev_items",
        F.when(used, F.coalesce("_built", F.lit(0))).otherwise(F.col("prev_items")).alias("item_count"), F.when(used, F.coalesce("_new", F.lit(0))).otherwise(F.lit(0)).alias("new_item_count"),
    )
    return merge.carry_fail_streak(runs, previous_runs)


def _summary(runs: DataFrame, settings: Settings) -> DataFrame:
    entry = health.summarize_run(runs, settings.stale_hours).withColumnRenamed("run_ts", "generated_at")
    return entry.withColumn("arrival", F.unix_millis("generated_at"))


def sync(
    bodies: DataFrame, fetched: DataFrame, sources: DataFrame, previous: DataFrame, previous_runs: DataFrame,
    history: DataFrame | None, now: Column, settings: Settings = Settings(), rules: dict = feeds.LISTING_RULES,
) -> SyncResult:
    """All that a run publishes: the next snapshot, status rows, history and both search tables.

    bodies: source_id, body_no, body; fetched: source_id, http_status, fetch_ok,
    parse_error, duration_ms (and fetched_at, attempts for the status rows); previous: published posts (arrival
    as in POST_COLUMNS).
    """
    known = merge.keep_known_sources(previous, sources).select(*POST_COLUMNS)
    built, decisions = _decided(bodies, fetched, sources, known, settings, rules)
    chosen = merge.apply_source_fallback(built, known, decisions)
    merged = merge.dedupe_by_url(merge.merge_snapshots(known, chosen))
    recent = merge.within_days(merged, settings.days, now)
    # The snapshot is published and also feeds the status rows, so it is computed once.
    if settings.snapshot_limit > 0:
        recent = recent.orderBy(*merge.newest_first()).limit(settings.snapshot_limit)
    posts = checkpoint(published_order(recent))
    runs = merge.with_visibility(_status_rows(decisions, fetched, sources, built, known, previous_runs, now), posts)
    entry = _summary(runs, settings)
    merged_history = entry if history is None else merge.merge_history(history, entry, settings.history_max)
    return SyncResult(posts, runs, merged_history, search_index.build_search_index(posts), search_index.slim_search_posts(posts))


_TYPES = {"published_at": "timestamp", "tags": "array<string>", "arrival": "struct<body_no:bigint,item_no:bigint>"}
POST_SCHEMA = ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in POST_COLUMNS)
STORED_SCHEMA = f"{POST_SCHEMA}, first_run timestamp, day date"
RUN_STATE = "source_id string, ok boolean, consecutive_fails int"


@dataclass(frozen=True)
class StoredRun:
    """What a run with number `number` finds and leaves in `folder`: posts by day, status rows and summaries by run."""

    spark: SparkSession
    folder: str
    number: int

    def _there(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def posts(self) -> DataFrame:
        """All that is published."""
        return self.spark.read.schema(STORED_SCHEMA).parquet(f"{self.folder}/posts") if self._there("posts") else self.spark.createDataFrame([], STORED_SCHEMA)

    def status(self) -> DataFrame:
        """The last status row of each source before this run."""
        if not self._there("runs"):
            return self.spark.createDataFrame([], RUN_STATE)
        earlier = self.spark.read.parquet(f"{self.folder}/runs").filter(F.col("batch") < self.number)
        last = earlier.groupBy("source_id").agg(F.max_by(F.struct("ok", "consecutive_fails"), "batch").alias("r"))
        return last.select("source_id", "r.ok", F.col("r.consecutive_fails").cast("int").alias("consecutive_fails"))

    def write(self, name: str, table: DataFrame) -> None:
        table.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={self.number}")

    def written(self, name: str) -> DataFrame | None:
        """What this run wrote there before it was repeated, if it got so far."""
        return self.spark.read.parquet(f"{self.folder}/{name}/batch={self.number}") if self._there(f"{name}/batch={self.number}/_SUCCESS") else None

    def write_days(self, posts: DataFrame) -> None:
        """Replaces the days that `posts` has rows of, and no other."""
        posts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.folder}/posts")

    def drop_days(self, days: list) -> None:
        for day in days:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/posts/day={day}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def history(self, keep: int = 0) -> DataFrame:
        """Run summaries so far; a later run wins a time stamp, the newest `keep` stay (0 = all)."""
        every = self.spark.read.parquet(f"{self.folder}/history")
        last = every.groupBy("generated_at").agg(F.max_by(F.struct(*every.columns), "batch").alias("r")).select("r.*").drop("batch")
        return last.orderBy(F.col("generated_at").desc()).limit(keep) if keep > 0 else last


def sync_days(
    stored: StoredRun, bodies: DataFrame, fetched: DataFrame, sources: DataFrame, now: Column, settings: Settings = Settings(), rules: dict = feeds.LISTING_RULES
) -> None:
    """One run on posts stored by day: what sync() publishes, but only days that change are written.

    These are the days that new items fall on or take an item from, that of the window's end, and those with items of
    sources no longer configured; days before the window are deleted. An item of an unused or unchanged source
    stays as it is. Each row knows the run that first had it: a run that is repeated sees what was there before its
    clock, and days, status rows and summary come out the same.
    """
    there = stored.posts()
    end = F.to_date(now - F.expr(f"interval {settings.days} days"))
    known = merge.keep_known_sources(there.filter(F.col("first_run") < now), sources)
    built, decisions = _decided(bodies, fetched, sources, known, settings, rules)
    fresh = built.join(decisions.filter("used = 'fetched'").select("source_id"), "source_id", "left_semi")
    keys = fresh.select(F.lower("url").alias("_key")).distinct()
    taken = known.select(F.lower("url").alias("_key"), "day").join(keys, "_key", "left_semi").select("day")
    strange = there.join(sources.select("source_id"), "source_id", "left_anti").select("day")
    touched = fresh.select(F.to_date("published_at").alias("day")).union(taken).union(strange).union(sources.limit(1).select(end.alias("day")))
    touched = checkpoint(touched.distinct())  # a row for each day of the window at most
    old = checkpoint(known.join(touched, "day", "left_semi"))
    winners = merge.within_days(merge.dedupe_by_url(merge.merge_snapshots(old.select(*POST_COLUMNS), fresh)), settings.days, now)
    first = old.select(F.lower("url").alias("_key"), "first_run")
    winners = published_order(winners).withColumns({"_key": F.lower("url"), "day": F.to_date("published_at")}).join(first, "_key", "left")
    winners = checkpoint(winners.select(*POST_COLUMNS, F.coalesce("first_run", now).alias("first_run"), "day"))
    gone = touched.join(winners.select("day").distinct(), "day", "left_anti").union(there.filter(F.col("day") < end).select("day")).distinct().collect()
    # What was new is told before the days change: an item that a later one took out of the window is not there any more.
    if stored.written("counts") is None:
        stored.write("counts", _status_rows(decisions, fetched, sources, built, known, stored.status(), now))
    stored.write_days(winners)
    stored.drop_days([r.day for r in gone])
    runs = merge.with_visibility(stored.written("counts"), stored.posts())
    stored.write("runs", runs)
    stored.write("history", _summary(stored.written("runs"), settings))


def enrich_from_pages(posts: DataFrame, fetch_state: DataFrame, fetched_pages: DataFrame, now: Column, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Fills covers and previews of this run's candidates from their pages (url, html).

    Returns the posts and the updated fetch state. Only candidate pages are
    parsed, and they are parsed once: at most settings.enrich_max of them if that is set.
    """
    tried = enrich.page_candidates(posts, fetch_state, now, settings).select("id", "url", "want_cover", "want_preview")
    found = fetched_pages.join(tried.select("url"), "url", "left_semi").withColumn("_key", F.col("url"))
    fields = checkpoint(pages.page_fields(found, "_key", settings.preview_max_len).select("url", "page_cover", "page_preview"))
    return enrich.join_page_fields(posts, fields, settings), enrich.update_fetch_state(fetch_state, tried, fields, now)
