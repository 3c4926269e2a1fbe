"""Joins, merges, run health and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweave.operators import boards, health, merge
from feedweave.plans.metrics import enrich_metrics
from verification import adapters as a
from verification.adapters import NOW, POSTS, PREVIOUS, RUNS, SOURCES, with_ctes

QUERIES, SQL = {}, {}


def case(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def day(c="run_ts"):
    return F.date_format(c, "yyyy-MM-dd").alias("day")


SMALL_SOURCES = "known_fx AS (SELECT source_id FROM sources_fx WHERE kind = 'feed')"


@case("include_filter", with_ctes(POSTS, SOURCES, body=r"""
SELECT id FROM posts_fx JOIN sources_fx s USING (source_id)
WHERE s.pattern IS NULL OR regexp_matches(title || chr(10) || coalesce(summary, ''), s.pattern)"""))
def _(spark, sf):
    from feedweave.sources.dimension import include_filter

    return include_filter(a.posts(spark, sf), a.sources(spark, sf)).select("id")


@case("keep_known_sources", with_ctes(POSTS, SOURCES, SMALL_SOURCES, body="SELECT id FROM posts_fx WHERE source_id IN (SELECT source_id FROM known_fx)"))
def _(spark, sf):
    return merge.keep_known_sources(a.posts(spark, sf), a.sources(spark, sf).filter("kind = 'feed'")).select("id")


@case("attach_health", with_ctes(*a.ALL_POSTS, body="SELECT id, source_health, source_health_score FROM enriched_fx"))
def _(spark, sf):
    h = health.source_health(health.latest_runs(a.history_runs(spark, sf)))
    return health.attach_health(a.posts(spark, sf), h).select("id", "source_health", "source_health_score")


@case("count_new_items", with_ctes(POSTS, PREVIOUS, body="""
SELECT source_id, count(*) FILTER (id NOT IN (SELECT id FROM previous_fx)) AS new_items FROM posts_fx GROUP BY source_id"""))
def _(spark, sf):
    return merge.count_new_items(a.posts(spark, sf), a.previous(spark, sf))


@case("carry_fail_streak", with_ctes(RUNS, body="""
SELECT source_id, strftime(n.run_ts, '%Y-%m-%d') AS day, CASE WHEN n.ok THEN 0 ELSE coalesce(p.consecutive_fails, 0) + 1 END AS consecutive_fails
FROM (SELECT * FROM runs_fx WHERE run_ts = TIMESTAMP '2024-01-20') n
LEFT JOIN (SELECT * FROM streaks_fx WHERE run_ts = TIMESTAMP '2024-01-19') p USING (source_id)"""))
def _(spark, sf):
    r = a.history_runs(spark, sf)
    current = r.filter("run_ts = timestamp'2024-01-20'")
    return merge.carry_fail_streak(current, r.filter("run_ts = timestamp'2024-01-19'")).select("source_id", day(), "consecutive_fails")


# One run per source: the newest status row says how the fetch went; the number of
# raw items of a source comes from the documents dated after the previous snapshot.
FETCH_CTES = (POSTS, PREVIOUS, SOURCES, RUNS, """
raw_fx AS (SELECT * FROM posts_fx WHERE published_at >= TIMESTAMP '2024-01-21'),
fetched_fx AS (SELECT s.source_id, CASE WHEN l.used = 'cached' THEN 304 ELSE l.http_status END AS http_status, coalesce(l.ok, true) AS fetch_ok,
  CASE WHEN l.duration_ms % 7 = 0 THEN 'parse_error' END AS parse_error FROM sources_fx s LEFT JOIN latest_fx l USING (source_id)),
decided_fx AS (SELECT source_id, http_status, raw_items, prev_items,
    CASE WHEN cached THEN 'cached' WHEN error IS NOT NULL THEN 'fallback' ELSE 'fetched' END AS used, error
  FROM (SELECT *, fetch_ok AND http_status = 304 AS cached, CASE WHEN fetch_ok AND http_status = 304 THEN NULL WHEN NOT fetch_ok THEN 'fetch_error' WHEN parse_error IS NOT NULL THEN parse_error
      WHEN raw_items = 0 THEN 'parse_empty' WHEN prev_items >= 12 AND raw_items < greatest(3, floor(prev_items * 0.15)) THEN 'parse_drop' END AS error
    FROM (SELECT f.*, (SELECT count(*) FROM raw_fx r WHERE r.source_id = f.source_id) AS raw_items,
      (SELECT count(*) FROM previous_fx p WHERE p.source_id = f.source_id) AS prev_items FROM fetched_fx f)))""")


def _fetch(spark, sf):
    raw = a.posts(spark, sf).filter("published_at >= timestamp'2024-01-21'")
    last = health.latest_runs(a.history_runs(spark, sf)).selectExpr(
        "source_id", "if(used = 'cached', 304, http_status) as http_status", "ok", "if(duration_ms % 7 = 0, 'parse_error', null) as parse_error"
    )
    fetched = a.sources(spark, sf).select("source_id").join(last, "source_id", "left")
    fetched = fetched.withColumn("fetch_ok", F.coalesce("ok", F.lit(True)))
    raw_counts = raw.groupBy("source_id").agg(F.count(F.lit(1)).alias("raw_items"))
    return raw, merge.fallback_decisions(fetched, raw_counts, a.previous(spark, sf))


@case("fallback_decisions", with_ctes(*FETCH_CTES, body="SELECT source_id, http_status, raw_items, prev_items, used, used <> 'fallback' AS ok, error FROM decided_fx"))
def _(spark, sf):
    return _fetch(spark, sf)[1]


@case("apply_source_fallback", with_ctes(*FETCH_CTES, body="""
SELECT id, 'new' AS part FROM raw_fx WHERE source_id IN (SELECT source_id FROM decided_fx WHERE used = 'fetched')
UNION ALL SELECT id, 'old' FROM previous_fx WHERE source_id IN (SELECT source_id FROM decided_fx WHERE used <> 'fetched')"""))
def _(spark, sf):
    raw, decisions = _fetch(spark, sf)
    old = a.previous(spark, sf).withColumn("part", F.lit("old"))
    return merge.apply_source_fallback(raw.withColumn("part", F.lit("new")), old, decisions).select("id", "part")


# Pages play the arrivals: the same address arrives with and without a trailing mark.
ARRIVALS = r"""
arrivals_fx AS (SELECT page_id AS arrival, regexp_replace(regexp_extract(url, '^https?://([^/]*)', 1), '[0-9]', '', 'g') AS url,
  html AS summary, CASE WHEN length(html) % 4 = 0 THEN 'c' END AS cover,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(length(html) AS INT)) AS published_at FROM pages)"""


def arrivals(spark, sf):
    return a.table(spark, sf, "pages").selectExpr(
        "page_id as arrival", "regexp_replace(regexp_extract(url, '^https?://([^/]*)', 1), '[0-9]', '') as url",
        "html as summary", "if(length(html) % 4 = 0, 'c', null) as cover",
        "timestampadd(MINUTE, length(html), timestamp'2024-01-01') as published_at",
    )


@case("dedupe_by_url", with_ctes(ARRIVALS, body="""
SELECT lower(url) AS key, arrival, summary, cover, first_arrival FROM (SELECT *, min(arrival) OVER (PARTITION BY lower(url)) AS first_arrival,
  row_number() OVER (PARTITION BY lower(url) ORDER BY length(summary) + CASE WHEN cover IS NOT NULL THEN 20 ELSE 0 END DESC, arrival DESC) AS rn FROM arrivals_fx) WHERE rn = 1"""))
def _(spark, sf):
    out = merge.dedupe_by_url(arrivals(spark, sf))
    return out.select(F.lower("url").alias("key"), "arrival", "summary", "cover", "first_arrival")


@case("merge_snapshots", with_ctes(POSTS, PREVIOUS, body="""
SELECT id, phase, count(*) AS n FROM (SELECT id, 0 AS phase FROM previous_fx UNION ALL SELECT id, 1 FROM posts_fx) GROUP BY ALL"""))
def _(spark, sf):
    both = merge.merge_snapshots(a.previous(spark, sf), a.posts(spark, sf))
    return both.groupBy("id", F.col("arrival.phase").alias("phase")).agg(F.count(F.lit(1)).alias("n"))


@case("items_by_source", with_ctes(POSTS, body="SELECT source_id, count(*) AS items FROM posts_fx GROUP BY 1"))
def _(spark, sf):
    return merge.items_by_source(a.posts(spark, sf))


@case("source_visibility", with_ctes(POSTS, RUNS, body="""
SELECT l.source_id, coalesce(v.n, 0) AS visible_items, strftime(v.latest, '%Y-%m-%d %H:%M:%S') AS latest
FROM latest_fx l LEFT JOIN (SELECT source_id, count(*) AS n, max(published_at) AS latest FROM posts_fx GROUP BY 1) v USING (source_id)"""))
def _(spark, sf):
    out = merge.with_visibility(health.latest_runs(a.history_runs(spark, sf)), a.posts(spark, sf))
    return out.select("source_id", "visible_items", F.date_format("latest_published_at", "yyyy-MM-dd HH:mm:ss").alias("latest"))


@case("with_duplicate_counts", with_ctes(POSTS, a.KEYED, body="SELECT id, dedup_key, count(*) OVER (PARTITION BY dedup_key) AS duplicate_count FROM keyed_fx"))
def _(spark, sf):
    return boards.with_duplicate_counts(a.posts(spark, sf)).select("id", "dedup_key", "duplicate_count")


@case("enrich_metrics", with_ctes(*a.ALL_POSTS, body="""
SELECT id, dedup_key, duplicate_count, source_health, source_health_score, read_minutes, pulse_score FROM enriched_fx"""))
def _(spark, sf):
    return enriched(spark, sf).select("id", "dedup_key", "duplicate_count", "source_health", "source_health_score", "read_minutes", "pulse_score")


def enriched(spark, sf):
    return enrich_metrics(a.posts(spark, sf), health.latest_runs(a.history_runs(spark, sf)), a.now())


SUMMARY = """
summary_fx AS (SELECT run_ts, count(*) AS total_sources, count(*) FILTER (ok) AS ok_sources, count(*) FILTER (NOT ok) AS err_sources,
  CAST(sum(item_count) AS BIGINT) AS total_items, CAST(sum(new_item_count) AS BIGINT) AS total_new_items, count(*) FILTER (consecutive_fails >= 3) AS flaky_sources,
  count(*) FILTER (greatest(0, epoch_us(run_ts + INTERVAL 1 DAY) - epoch_us(latest_published_at)) / 3600000000.0 >= 6) AS stale_sources,
  count(*) FILTER (lower(error) LIKE '%parse_empty%') AS parse_empty, count(*) FILTER (lower(error) LIKE '%parse_drop%') AS parse_drop
  FROM streaks_fx GROUP BY run_ts)"""


def _summaries(spark, sf):
    """Runs are stamped at the end of their day."""
    r = a.history_runs(spark, sf).withColumn("run_ts", F.expr("run_ts + interval 1 day"))
    return health.summarize_run(r, 6).withColumn("run_ts", F.expr("run_ts - interval 1 day"))


@case("summarize_run", with_ctes(RUNS, SUMMARY, body="SELECT * EXCLUDE (run_ts), strftime(run_ts, '%Y-%m-%d') AS day FROM summary_fx"))
def _(spark, sf):
    return _summaries(spark, sf).select("*", day()).drop("run_ts")


@case("run_report", with_ctes(RUNS, body="""
SELECT strftime(run_ts, '%Y-%m-%d') AS day, count(*) AS total_sources, count(*) FILTER (ok) AS ok_sources, count(*) FILTER (NOT ok) AS err_sources,
  CAST(sum(item_count) AS BIGINT) AS total_items, CAST(sum(visible_item_count) AS BIGINT) AS visible_items, CAST(sum(new_item_count) AS BIGINT) AS new_items,
  count(*) FILTER (used = 'fetched') AS fetched, count(*) FILTER (used = 'cached') AS cached, count(*) FILTER (used = 'fallback') AS fallback
FROM runs_fx GROUP BY run_ts"""))
def _(spark, sf):
    return health.run_report(a.runs(spark, sf)).select("*", day()).drop("run_ts")


@case("health_summary", with_ctes(SOURCES, RUNS, body="""
SELECT *, CAST(floor(stable * 100.0 / total + 0.5) AS INT) AS stable_ratio FROM (SELECT count(*) AS total, count(*) FILTER (h = 'excellent') AS excellent, count(*) FILTER (h = 'good') AS good,
  count(*) FILTER (h = 'warn') AS warn, count(*) FILTER (h = 'down') AS down, count(*) FILTER (h IN ('excellent', 'good')) AS stable
  FROM (SELECT coalesce(source_health, 'good') AS h FROM sources_fx LEFT JOIN health_fx USING (source_id)))"""))
def _(spark, sf):
    return health.health_summary(a.sources(spark, sf), health.source_health(health.latest_runs(a.history_runs(spark, sf))))


@case("merge_history", with_ctes(RUNS, SUMMARY, body="""
SELECT strftime(run_ts, '%Y-%m-%d') AS day, total_items + CASE WHEN run_ts >= TIMESTAMP '2024-01-15' THEN 1000 ELSE 0 END AS total_items
FROM summary_fx ORDER BY run_ts DESC LIMIT 20"""))
def _(spark, sf):
    s = _summaries(spark, sf).select(F.col("run_ts").alias("generated_at"), "total_items", F.unix_millis("run_ts").alias("arrival"))
    again = s.filter("generated_at >= timestamp'2024-01-15'").withColumn("total_items", F.col("total_items") + 1000)
    return merge.merge_history(s, again, 20).select(day("generated_at"), "total_items")


TREND = """
trend_fx AS (SELECT run_ts, CAST(floor(ok_sources * 100.0 / total_sources + 0.5) AS INT) AS success_pct, err_sources AS errors, total_new_items AS new_items
  FROM summary_fx ORDER BY run_ts DESC LIMIT 30)"""


@case("history_trend", with_ctes(RUNS, SUMMARY, TREND, body="SELECT * EXCLUDE (run_ts), strftime(run_ts, '%Y-%m-%d') AS day FROM trend_fx"))
def _(spark, sf):
    return health.history_trend(_summaries(spark, sf)).select("*", day()).drop("run_ts")


@case("sparkline_points", with_ctes(RUNS, SUMMARY, TREND, body="""
SELECT series, seq, round(2.0 + 116.0 / nullif(n - 1, 0) * (i - 1), 2) AS x, round(2.0 + 36.0 * (1 - (value - lo) / CASE WHEN hi = lo THEN 1.0 ELSE CAST(hi - lo AS DOUBLE) END), 2) AS y
FROM (SELECT series, seq, value, min(value) OVER w AS lo, max(value) OVER w AS hi, count(*) OVER w AS n, row_number() OVER (PARTITION BY series ORDER BY seq) AS i
  FROM (SELECT 'success' AS series, epoch_ms(run_ts) AS seq, CAST(success_pct AS DOUBLE) AS value FROM trend_fx UNION ALL SELECT 'new', epoch_ms(run_ts), new_items FROM trend_fx)
  WINDOW w AS (PARTITION BY series))"""))
def _(spark, sf):
    t = health.history_trend(_summaries(spark, sf)).withColumn("seq", F.unix_millis("run_ts"))
    series = t.select(F.lit("success").alias("series"), "seq", F.col("success_pct").cast("double").alias("value")).unionByName(
        t.select(F.lit("new").alias("series"), "seq", F.col("new_items").cast("double").alias("value"))
    )
    return health.sparkline_points(series)


@case("fail_streaks", with_ctes(RUNS, body="SELECT source_id, strftime(run_ts, '%Y-%m-%d') AS day, consecutive_fails FROM streaks_fx"))
def _(spark, sf):
    return a.history_runs(spark, sf).select("source_id", day(), "consecutive_fails")


@case("problem_sources", with_ctes(RUNS, body="""
SELECT strftime(run_ts, '%Y-%m-%d') AS day, list, rank, source_id, duration_ms, consecutive_fails FROM (
SELECT *, 'failed' AS list, row_number() OVER (PARTITION BY run_ts ORDER BY source_id) AS rank FROM streaks_fx WHERE NOT ok QUALIFY rank <= 18
UNION ALL SELECT *, 'flaky', row_number() OVER (PARTITION BY run_ts ORDER BY consecutive_fails DESC, source_id) AS rank FROM streaks_fx WHERE NOT ok AND consecutive_fails >= 3 QUALIFY rank <= 12
UNION ALL SELECT *, 'slowest', row_number() OVER (PARTITION BY run_ts ORDER BY duration_ms DESC, source_id) AS rank FROM streaks_fx QUALIFY rank <= 8)"""))
def _(spark, sf):
    return health.problem_sources(a.history_runs(spark, sf)).select("*", day()).drop("run_ts")


@case("missing_sources", with_ctes(SOURCES, RUNS, body="""
SELECT source_id, 'not_seen' AS problem FROM sources_fx WHERE kind = 'feed' AND source_id NOT IN (SELECT source_id FROM runs_fx WHERE errors > 2)
UNION ALL SELECT DISTINCT source_id, 'not_configured' FROM runs_fx WHERE errors > 2 AND source_id NOT IN (SELECT source_id FROM sources_fx WHERE kind = 'feed')"""))
def _(spark, sf):
    return merge.missing_sources(a.sources(spark, sf).filter("kind = 'feed'"), a.runs(spark, sf).filter("errors > 2"))
