"""The driver's tables seen as feed data, once for Spark and once as SQL for the checker.

Each Spark function and the SQL text of the same name describe the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.operators import merge
from feedweave.session import prepare

NOW = "2024-01-31 00:00:00"
BEFORE = "2024-01-21 00:00:00"  # clock of the previous snapshot


WHOLE_TEXTS = {"documents": "doc_id", "pages": "page_id"}  # tables of long texts, and what their rows are dealt by


def now():
    return F.lit(NOW).cast("timestamp")


def stored(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table as it lies in its files."""
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table. Whole texts are dealt to all cores: a file of one row group is read by one task, however heavy the work on its rows."""
    rows = stored(spark, sf, name)
    return rows.repartition(F.col(WHOLE_TEXTS[name])) if name in WHOLE_TEXTS else rows


def posts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").selectExpr(
        "*",
        r"trim(regexp_replace(text, '[\\t\\r\\n\\f][ \\t\\r\\n\\f]*| [ \\t\\r\\n\\f]+', ' ')) as compact",
        r"trim(regexp_replace(split_part(text, '\n', 1), '[\\t\\r\\f][ \\t\\r\\f]*| [ \\t\\r\\f]+', ' ')) as line",
        "concat('https://', source, '.example.com/', lang, '/', doc_id) as u",
    )
    return d.selectExpr(
        "sha1(u) as id", "doc_id as arrival", "u as url",
        "line as title",
        "if(lang = 'en', concat('译 ', line), null) as title_zh",
        "if(lang = 'fr', concat('訳 ', line), null) as title_ja",
        "if(lang <> 'de', compact, null) as summary",
        "cast(null as string) as summary_zh", "cast(null as string) as summary_ja",
        "if(lang = 'de', compact, null) as preview",
        "cast(null as string) as preview_zh", "cast(null as string) as preview_ja",
        "timestampadd(MINUTE, cast((doc_id * 2591) % 43200 as int), timestamp'2024-01-01') as published_at",
        "lang as category", "source as source_id", "concat('Source ', source) as source_name",
        "concat('https://', source, '.example.com/') as source_url",
        "if(doc_id % 3 = 0, concat('https://img.example.com/', doc_id, '.jpg'), null) as cover",
        "cast(null as string) as cover_original",
        "array_compact(array(if(text rlike '[0-9]', 'digits', null), if(contains(text, '@'), 'mail', null), "
        "if(n_chars > 2000, 'long', null))) as tags",
    )


POSTS = r"""
docs_fx AS (SELECT *, trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g')) AS compact,
  trim(regexp_replace(split_part(text, chr(10), 1), '[ \t\r\f]+', ' ', 'g')) AS line,
  'https://' || source || '.example.com/' || lang || '/' || doc_id AS u FROM documents),
posts_fx AS (SELECT sha1(u) AS id, doc_id AS arrival, u AS url, line AS title,
  CASE WHEN lang = 'en' THEN '译 ' || line END AS title_zh,
  CASE WHEN lang = 'fr' THEN '訳 ' || line END AS title_ja,
  CASE WHEN lang <> 'de' THEN compact END AS summary,
  CAST(NULL AS VARCHAR) AS summary_zh, CAST(NULL AS VARCHAR) AS summary_ja,
  CASE WHEN lang = 'de' THEN compact END AS preview,
  CAST(NULL AS VARCHAR) AS preview_zh, CAST(NULL AS VARCHAR) AS preview_ja,
  TIMESTAMP '2024-01-01' + to_minutes(CAST((doc_id * 2591) % 43200 AS INT)) AS published_at,
  lang AS category, source AS source_id, 'Source ' || source AS source_name,
  'https://' || source || '.example.com/' AS source_url,
  CASE WHEN doc_id % 3 = 0 THEN 'https://img.example.com/' || doc_id || '.jpg' END AS cover,
  CAST(NULL AS VARCHAR) AS cover_original,
  list_filter([CASE WHEN regexp_matches(text, '[0-9]') THEN 'digits' END, CASE WHEN contains(text, '@') THEN 'mail' END,
    CASE WHEN n_chars > 2000 THEN 'long' END], lambda x: x IS NOT NULL) AS tags
  FROM docs_fx)"""


def previous(spark: SparkSession, sf: str) -> DataFrame:
    """What the previous run had published: everything dated before its clock."""
    return posts(spark, sf).filter(F.col("published_at") < F.lit(BEFORE).cast("timestamp"))


PREVIOUS = f"previous_fx AS (SELECT * FROM posts_fx WHERE published_at < TIMESTAMP '{BEFORE}')"


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """Source dimension from the documents: one row per source."""
    d = table(spark, sf, "documents").groupBy("source").agg(F.min("lang").alias("category"))
    return d.selectExpr(
        "source as source_id", "concat('Source ', source) as name",
        "if(length(source) = 4, 'feed', 'html') as kind",
        "case when category = 'de' then 'ja' else category end as lang",
        "concat('https://', source, '.example.com/feed') as url",
        "if(length(source) = 4, concat('https://', source, '.example.com/'), null) as homepage",
        "category", "if(length(source) = 4, null, '[0-9]|THE') as pattern",
    )


SOURCES = """
sources_fx AS (SELECT source AS source_id, 'Source ' || source AS name,
  CASE WHEN length(source) = 4 THEN 'feed' ELSE 'html' END AS kind,
  CASE WHEN min(lang) = 'de' THEN 'ja' ELSE min(lang) END AS lang,
  'https://' || source || '.example.com/feed' AS url,
  CASE WHEN length(source) = 4 THEN 'https://' || source || '.example.com/' END AS homepage,
  min(lang) AS category, CASE WHEN length(source) = 4 THEN NULL ELSE '[0-9]|THE' END AS pattern
  FROM documents GROUP BY source)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Daily status rows per source, from the events."""
    e = table(spark, sf, "events").selectExpr(
        "cast(date_trunc('day', ts) as timestamp) as run_ts", "concat('src', user_id % 20) as source_id",
        "event_type", "value", "cast(ts as timestamp) as ts",
    )
    g = e.groupBy("run_ts", "source_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_if(F.col("event_type") == "signup").alias("new_item_count"),
        F.count_if(F.col("event_type") == "view").alias("visible_item_count"),
        F.floor(F.max("value") * 100).cast("bigint").alias("duration_ms"),
        F.max("ts").alias("latest_published_at"),
    )
    g = g.withColumn("ok", F.expr("errors * 4 <= item_count"))
    return g.selectExpr(
        "*", "if(ok, 200, case item_count % 4 when 0 then 429 when 1 then 404 when 2 then 403 else 500 end) as http_status",
        "case when ok and item_count % 5 = 0 then 'cached' when ok then 'fetched' else 'fallback' end as used",
        "case when ok then null when item_count % 3 = 0 then 'parse_empty' when item_count % 3 = 1 then 'PARSE_DROP' "
        "else 'timeout' end as error",
    )


RUNS = """
runs_fx AS (SELECT *, CASE WHEN ok THEN 200 ELSE CASE item_count % 4 WHEN 0 THEN 429 WHEN 1 THEN 404 WHEN 2 THEN 403 ELSE 500 END END AS http_status,
  CASE WHEN ok AND item_count % 5 = 0 THEN 'cached' WHEN ok THEN 'fetched' ELSE 'fallback' END AS used,
  CASE WHEN ok THEN NULL WHEN item_count % 3 = 0 THEN 'parse_empty' WHEN item_count % 3 = 1 THEN 'PARSE_DROP' ELSE 'timeout' END AS error
  FROM (SELECT *, errors * 4 <= item_count AS ok FROM (
    SELECT date_trunc('day', ts) AS run_ts, 'src' || (user_id % 20) AS source_id, count(*) AS item_count,
      count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS new_item_count,
      count(*) FILTER (event_type = 'view') AS visible_item_count,
      CAST(floor(max(value) * 100) AS BIGINT) AS duration_ms, max(ts) AS latest_published_at
    FROM events GROUP BY ALL))),
streaks_fx AS (SELECT *, CASE WHEN ok THEN 0 ELSE rn - CAST(max(ok) OVER (PARTITION BY source_id, isl) AS INT) END AS consecutive_fails
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id, isl ORDER BY run_ts) AS rn
    FROM (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY source_id ORDER BY run_ts) AS isl FROM runs_fx))),
latest_fx AS (SELECT * FROM streaks_fx QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY run_ts DESC) = 1),
health_fx AS (SELECT source_id, CASE WHEN NOT ok THEN 'down' WHEN consecutive_fails >= 2 OR used = 'fallback' THEN 'warn'
    WHEN consecutive_fails = 0 AND used = 'fetched' AND duration_ms > 0 AND duration_ms <= 1200 THEN 'excellent' ELSE 'good' END AS source_health,
  run_ts, ok FROM latest_fx)"""


def history_runs(spark: SparkSession, sf: str) -> DataFrame:
    return merge.fail_streaks(runs(spark, sf))


TELEMETRY = """
telemetry_fx AS (SELECT event_id, ts AS at, event_type AS type, '/' || event_type AS path,
  CASE WHEN user_id % 3 = 0 THEN 'ja' WHEN user_id % 3 = 1 THEN 'zh' END AS lang,
  CASE WHEN user_id % 2 = 0 THEN 'phone' ELSE 'desktop' END AS device, user_id AS session, props AS data, value FROM events)"""


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return as_telemetry(table(spark, sf, "events"))


def as_telemetry(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id", "cast(ts as timestamp) as at", "event_type as type", "concat('/', event_type) as path",
        "case when user_id % 3 = 0 then 'ja' when user_id % 3 = 1 then 'zh' end as lang",
        "if(user_id % 2 = 0, 'phone', 'desktop') as device", "user_id as session", "props as data", "value",
    )


def user_items(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """(user_id, post_id): a view marks an item read, a click bookmarks it."""
    docs = table(spark, sf, "documents").selectExpr(
        "doc_id", "sha1(concat('https://', source, '.example.com/', lang, '/', doc_id)) as post_id"
    )
    e = table(spark, sf, "events").filter(F.col("event_type") == kind)
    e = e.selectExpr("user_id", "value", "cast(floor(value * 100) as bigint) as doc_id")
    return e.join(docs, "doc_id").select("user_id", "post_id").distinct()


def user_items_sql(name: str, kind: str) -> str:
    return f"""
{name} AS (SELECT DISTINCT user_id, sha1('https://' || source || '.example.com/' || lang || '/' || doc_id) AS post_id
  FROM events JOIN documents ON doc_id = CAST(floor(value * 100) AS BIGINT) WHERE event_type = '{kind}')"""


def user_sources(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, source_id): a purchase follows a source."""
    e = table(spark, sf, "events").filter("event_type = 'purchase'")
    return e.selectExpr("user_id", "concat('src', event_id % 20) as source_id").distinct()


USER_SOURCES = """
user_sources_fx AS (SELECT DISTINCT user_id, 'src' || (event_id % 20) AS source_id FROM events WHERE event_type = 'purchase')"""


def dedup_key_sql(c: str) -> str:
    """SQL of the duplicate key."""
    base = rf"lower(trim(regexp_replace(regexp_replace(coalesce({c}, ''), '[\[\]【】()（）「」『』《》〈〉〔〕\x{{3000}}]', ' ', 'g'), '[^A-Za-z0-9\x{{3040}}-\x{{30ff}}\x{{4e00}}-\x{{9fff}}]+', ' ', 'g')))"
    words = f"list_filter(string_split({base}, ' '), lambda w: w <> '')"
    kept = f"list_filter({words}, lambda w: w NOT IN ('新作', '特報'))"
    return f"array_to_string(list_slice(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {words} END, 1, 12), '-')"


def read_minutes_sql(c: str) -> str:
    cjk = rf"len(regexp_extract_all({c}, '[\x{{3040}}-\x{{30ff}}\x{{4e00}}-\x{{9fff}}]'))"
    latin = f"len(regexp_extract_all({c}, '[A-Za-z0-9]+'))"
    return (
        f"CASE WHEN trim({c}) = '' THEN 1 ELSE CAST(least(20, greatest(1, ceil(greatest({cjk} / 420.0, {latin} / 200.0, 0.6)))) AS INT) END"
    )


def pulse_sql(health: str) -> str:
    age = f"greatest(0.0, (epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(published_at)) / 3600000.0)"
    return f"""CAST(greatest(0, least(120, floor(greatest(0.0, 100.0 - {age} * 4) + least(18, len(tags) * 3)
  + CASE WHEN coalesce(cover, '') <> '' THEN 6 ELSE 0 END
  + CASE WHEN length(coalesce(summary, preview, '')) >= 160 THEN 6 WHEN length(coalesce(summary, preview, '')) >= 80 THEN 3 ELSE 0 END
  + CASE {health} WHEN 'excellent' THEN 8 WHEN 'good' THEN 4 WHEN 'down' THEN -8 ELSE 0 END + 0.5))) AS INT)"""


KEYED = f"""
keyed_fx AS (SELECT *, coalesce(nullif({dedup_key_sql("coalesce(title_zh, title_ja, title, '')")}, ''), id) AS dedup_key FROM posts_fx)"""

ENRICHED = f"""
enriched_fx AS (SELECT k.*, count(*) OVER (PARTITION BY dedup_key) AS duplicate_count, h.source_health,
  CASE h.source_health WHEN 'excellent' THEN 4 WHEN 'good' THEN 3 WHEN 'warn' THEN 1 ELSE 0 END AS source_health_score,
  {read_minutes_sql("title || ' ' || coalesce(summary, preview, '')")} AS read_minutes,
  {pulse_sql("h.source_health")} AS pulse_score
  FROM keyed_fx k LEFT JOIN health_fx h USING (source_id))"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()


ALL_POSTS = (POSTS, RUNS, KEYED, ENRICHED)
