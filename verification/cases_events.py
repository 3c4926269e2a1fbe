"""Event operators, translation, enrichment, checks and published forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedweave.functions import text
from feedweave.operators import enrich, events, quality, throttle, translate
from feedweave.sources import publish, readers, search_index
from verification import adapters as a
from verification.adapters import NOW, POSTS, PREVIOUS, RUNS, SOURCES, TELEMETRY, with_ctes

QUERIES, SQL = {}, {}


def case(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


HOUR = 3_600_000


def chain(key: str, where: str = "true", gap: int = HOUR, source: str = "telemetry_fx", name: str = "kept_fx") -> str:
    """SQL of the throttle: walk from each kept event to the first one a gap later."""
    return f"""
t_{name} AS (SELECT event_id, {key} AS key, epoch_us("at") // 1000 AS ms FROM {source} WHERE {where}),
f_{name} AS (SELECT key, ms, min(event_id) AS event_id FROM t_{name} GROUP BY key, ms),
n_{name} AS (SELECT p.key, p.ms, p.event_id, (SELECT min(q.ms) FROM f_{name} q WHERE q.key = p.key AND q.ms >= p.ms + {gap}) AS nxt FROM f_{name} p),
w_{name} AS (SELECT key, min(ms) AS ms FROM f_{name} GROUP BY key UNION ALL SELECT w.key, n.nxt FROM w_{name} w JOIN n_{name} n ON n.key = w.key AND n.ms = w.ms WHERE n.nxt IS NOT NULL),
{name} AS (SELECT f.event_id, f.key FROM w_{name} w JOIN f_{name} f ON f.key = w.key AND f.ms = w.ms)"""


@case("throttle_events", with_ctes(TELEMETRY, chain("concat_ws('|', type, path, coalesce(lang, ''), device, coalesce(data, ''))"), body="SELECT event_id FROM kept_fx"))
def _(spark, sf):
    return throttle.throttle_events(a.telemetry(spark, sf), ["type", "path", "lang", "device", "data"], HOUR).select("event_id")


@case("rate_limit", with_ctes(TELEMETRY, chain("1", "type = 'error'", 2 * HOUR), body="SELECT event_id FROM kept_fx"))
def _(spark, sf):
    return throttle.rate_limit(a.telemetry(spark, sf).filter("type = 'error'"), 2 * HOUR).select("event_id")


# Errors of a session group carry one of four keys; a change of key resets.
RUN_CTES = """
errors_fx AS (SELECT *, session % 3 AS page, CAST(floor(value) AS BIGINT) % 2 AS code FROM telemetry_fx),
steps_fx AS (SELECT *, CASE WHEN code IS NOT DISTINCT FROM lag(code) OVER w AND lag("at") OVER w IS NOT NULL THEN 0 ELSE 1 END AS ch FROM errors_fx WINDOW w AS (PARTITION BY page ORDER BY "at", event_id)),
runs2_fx AS (SELECT *, sum(ch) OVER (PARTITION BY page ORDER BY "at", event_id) AS run FROM steps_fx)"""


@case("collapse_repeated_errors", with_ctes(TELEMETRY, RUN_CTES, chain("page || ':' || run", gap=HOUR, source="runs2_fx"), body="SELECT event_id FROM kept_fx"))
def _(spark, sf):
    t = a.telemetry(spark, sf).selectExpr("*", "session % 3 as page", "cast(floor(value) as bigint) % 2 as code")
    return throttle.collapse_repeated_errors(t, ["page"], ["code"], HOUR).select("event_id")


@case("recent_events", with_ctes(TELEMETRY, body="""
SELECT event_id, session FROM telemetry_fx QUALIFY row_number() OVER (PARTITION BY session ORDER BY "at" DESC, event_id DESC) <= 20"""))
def _(spark, sf):
    return events.recent_events(a.telemetry(spark, sf), ["session"], 20).select("event_id", "session")


VITALS = """
entries_fx AS (SELECT session, "at", event_id, CASE type WHEN 'view' THEN 'lcp' WHEN 'signup' THEN 'shift' WHEN 'error' THEN 'longtask' WHEN 'purchase' THEN 'navigation' ELSE 'interaction' END AS kind,
  CASE WHEN device = 'phone' THEN 'pointerdown' ELSE '' END AS name, value * 10 AS value, lang = 'ja' AS recent_input,
  CAST(regexp_extract(data, '([0-9]+)', 1) AS BIGINT) AS interaction_id FROM telemetry_fx)"""


def entries(spark, sf):
    return a.telemetry(spark, sf).selectExpr(
        "session", "at", "event_id", "case type when 'view' then 'lcp' when 'signup' then 'shift' when 'error' then 'longtask' when 'purchase' then 'navigation' else 'interaction' end as kind",
        "if(device = 'phone', 'pointerdown', '') as name", "value * 10 as value", "lang = 'ja' as recent_input",
        "cast(regexp_extract(data, '([0-9]+)', 1) as bigint) as interaction_id",
    )


@case("session_vitals", with_ctes(TELEMETRY, VITALS, chain("session", "kind = 'longtask'", 24 * HOUR, "entries_fx", "tasks_fx"), body="""
SELECT session, CAST(floor(lcp + 0.5) AS BIGINT) AS lcp_ms, CASE WHEN cls > 0 THEN cls END AS cls, CAST(floor(ttfb + 0.5) AS BIGINT) AS ttfb_ms, CAST(floor(inp + 0.5) AS BIGINT) AS inp_ms,
  nullif(tasks, 0) AS long_task_count, CAST(floor(task_max + 0.5) AS BIGINT) AS long_task_max_ms
FROM (SELECT session, max(value) FILTER (kind = 'lcp' AND value > 0) AS lcp, floor(sum(value) FILTER (kind = 'shift' AND NOT coalesce(recent_input, false)) * 1000 + 0.5) / 1000 AS cls,
   max(value) FILTER (kind = 'navigation' AND value > 0) AS ttfb, count(*) FILTER (event_id IN (SELECT event_id FROM tasks_fx) AND value > 0) AS tasks,
   max(value) FILTER (event_id IN (SELECT event_id FROM tasks_fx) AND value > 0) AS task_max FROM entries_fx GROUP BY session)
LEFT JOIN (SELECT session, quantile_disc(d, 0.98) AS inp FROM (SELECT session, interaction_id, max(value) AS d FROM entries_fx WHERE kind = 'interaction' AND interaction_id <> 0 AND value > 0 GROUP BY session, interaction_id
  QUALIFY row_number() OVER (PARTITION BY session ORDER BY min("at") DESC) <= 10) GROUP BY session) USING (session)"""))
def _(spark, sf):
    return events.session_vitals(entries(spark, sf), 24 * HOUR, keep=10)


@case("request_health", with_ctes(TELEMETRY, """
requests_fx AS (SELECT event_id, "at", session % 4 AS session, CASE WHEN type IN ('view', 'click') THEN 'start' ELSE 'end' END AS phase, value * 100 AS duration_ms, type <> 'error' AS ok, path AS url FROM telemetry_fx),
sums_fx AS (SELECT *, sum(CASE WHEN phase = 'end' THEN -1 ELSE 1 END) OVER w AS s, max(CASE WHEN phase = 'end' AND duration_ms >= 1800 THEN epoch_us("at") // 1000 END) OVER w AS slow_at,
  max(CASE WHEN phase = 'end' AND NOT ok THEN "at" END) OVER w AS err_at FROM requests_fx WINDOW w AS (PARTITION BY session ORDER BY "at", event_id))""", body="""
SELECT event_id, active, slow, strftime(err_at, '%H:%M:%S') AS err FROM (SELECT event_id, CAST(s - least(0, min(s) OVER (PARTITION BY session ORDER BY "at", event_id)) AS BIGINT) AS active,
  coalesce(epoch_us("at") // 1000 - slow_at < 4500, false) AS slow, err_at FROM sums_fx)"""))
def _(spark, sf):
    r = a.telemetry(spark, sf).selectExpr(
        "event_id", "at", "session % 4 as session", "if(type in ('view', 'click'), 'start', 'end') as phase", "value * 100 as duration_ms", "type <> 'error' as ok", "path as url"
    )
    return events.request_health(r).select("event_id", "active", "slow", F.date_format("last_error_at", "HH:mm:ss").alias("err"))


WANTED = r"""
wanted_fx AS (SELECT id, field, target, CASE field WHEN 'title' THEN title WHEN 'summary' THEN summary ELSE preview END AS text,
  CASE field || target WHEN 'titlezh' THEN title_zh WHEN 'titleja' THEN title_ja END AS have, lang
  FROM posts_fx LEFT JOIN (SELECT source_id, lang FROM sources_fx) USING (source_id), (VALUES ('title'), ('summary'), ('preview')) f(field), (VALUES ('zh'), ('ja')) g(target)),
work_fx AS (SELECT *, sha1(target || '::' || trim(text)) AS key FROM wanted_fx WHERE coalesce(lang, 'unknown') <> target AND coalesce(text, '') <> '' AND have IS NULL
  AND (target = 'zh' OR NOT regexp_matches(text, '[\x{3041}-\x{30ff}]'))),
cache_fx AS (SELECT DISTINCT key, CASE WHEN length(text) % 5 = 0 THEN ' ' WHEN length(text) % 5 = 1 THEN text ELSE upper(text) END AS done FROM work_fx WHERE target = 'zh' OR field = 'title')"""


def _cache(spark, sf):
    """Finished translations: all Chinese texts and all titles, some of them blank or unchanged."""
    w = translate.wanted_texts(a.posts(spark, sf), a.sources(spark, sf))
    done = "case when length(text) % 5 = 0 then ' ' when length(text) % 5 = 1 then text else concat(text, ' (done)') end as text"
    return w.filter("target = 'zh' or field = 'title'").withColumn("key", translate.cache_key(F.col("target"), F.col("text"))).selectExpr("key", done).distinct()


CACHED = WANTED.replace("upper(text)", "text || ' (done)'")


@case("translation_candidates", with_ctes(POSTS, SOURCES, WANTED, body="SELECT id FROM (SELECT DISTINCT id, arrival FROM work_fx JOIN posts_fx USING (id)) ORDER BY arrival LIMIT 220"))
def _(spark, sf):
    return translate.translation_candidates(a.posts(spark, sf), a.sources(spark, sf), 220).select("id")


@case("translation_worklist", with_ctes(POSTS, SOURCES, CACHED, body="""
SELECT DISTINCT key, target, trim(text) AS text FROM work_fx WHERE key NOT IN (SELECT key FROM cache_fx WHERE trim(done) <> '')"""))
def _(spark, sf):
    return translate.translation_worklist(a.posts(spark, sf), a.sources(spark, sf), _cache(spark, sf))


@case("apply_translations", with_ctes(POSTS, SOURCES, CACHED, r"""
done_fx AS (SELECT id, field || '_' || target AS col, trim(regexp_replace(done, '[ \t\r\n\f\v\x{a0}]+', ' ', 'g')) AS d, CASE field WHEN 'title' THEN 180 WHEN 'summary' THEN 420 ELSE 520 END AS n
  FROM work_fx JOIN cache_fx USING (key) WHERE trim(done) <> '' AND done <> text),
cut_fx AS (SELECT id, col, CASE WHEN length(d) <= n THEN d ELSE rtrim(substring(d, 1, n - 1)) || '…' END AS d FROM done_fx)""", body="""
SELECT id, coalesce(title_zh, max(d) FILTER (col = 'title_zh')) AS title_zh, coalesce(title_ja, max(d) FILTER (col = 'title_ja')) AS title_ja,
  max(d) FILTER (col = 'summary_zh') AS summary_zh, max(d) FILTER (col = 'summary_ja') AS summary_ja, max(d) FILTER (col = 'preview_zh') AS preview_zh, max(d) FILTER (col = 'preview_ja') AS preview_ja
FROM posts_fx LEFT JOIN cut_fx USING (id) GROUP BY id, title_zh, title_ja"""))
def _(spark, sf):
    out = translate.apply_translations(a.posts(spark, sf), a.sources(spark, sf), _cache(spark, sf))
    return out.select("id", *[f"{f}_{t}" for f in ("title", "summary", "preview") for t in ("zh", "ja")])


STATE = """
state_fx AS (SELECT url, CASE WHEN lang = 'en' THEN published_at + INTERVAL 2 DAY END AS cover_miss_at, CASE WHEN lang <> 'fr' THEN published_at + INTERVAL 1 DAY END AS preview_miss_at
  FROM (SELECT *, category AS lang FROM posts_fx)),
wants_fx AS (SELECT *, cover IS NULL AS lacks_cover, cover IS NULL AS want_cover, preview IS NULL AND (summary IS NULL OR length(summary) < 300) AS want_preview FROM posts_fx),
left_fx AS (SELECT w.* FROM wants_fx w LEFT JOIN state_fx USING (url) WHERE (lacks_cover OR want_preview)
  AND NOT ((NOT want_cover OR coalesce(epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(cover_miss_at) BETWEEN 0 AND 72 * 3600000 - 1, false))
   AND (NOT want_preview OR coalesce(epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(preview_miss_at) BETWEEN 0 AND 24 * 3600000 - 1, false))))"""


def _settings():
    from feedweave.config import Settings

    return Settings(preview_min_len=300, enrich_per_source=9, enrich_max=150)


def _state(spark, sf):
    return a.posts(spark, sf).selectExpr(
        "url", "if(category = 'en', published_at + interval 2 day, null) as cover_miss_at", "if(category <> 'fr', published_at + interval 1 day, null) as preview_miss_at",
        "cast(null as timestamp) as cover_ok_at", "cast(null as timestamp) as preview_ok_at",
    )


@case("drop_recent_misses", with_ctes(POSTS, STATE, body="SELECT id FROM left_fx"))
def _(spark, sf):
    wants = enrich.with_wants(a.posts(spark, sf), _settings()).filter("lacks_cover or want_preview")
    return enrich.drop_recent_misses(wants, _state(spark, sf), a.now(), _settings()).select("id")


@case("cap_per_source", with_ctes(POSTS, STATE, body="""
SELECT id FROM (SELECT * FROM left_fx QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY lacks_cover DESC, published_at DESC, arrival) <= 9) ORDER BY lacks_cover DESC, published_at DESC, arrival LIMIT 150"""))
def _(spark, sf):
    return enrich.page_candidates(a.posts(spark, sf), _state(spark, sf), a.now(), _settings()).select("id")


@case("cover_candidates", with_ctes(POSTS, body="SELECT id FROM posts_fx WHERE cover IS NOT NULL ORDER BY published_at DESC, arrival LIMIT 260"))
def _(spark, sf):
    return enrich.cover_candidates(a.posts(spark, sf)).select("id")


@case("reset_missing_assets", with_ctes(POSTS, body="""
SELECT id, CASE WHEN cover IS NULL THEN NULL WHEN n_chars > 900 THEN '/covers/' || arrival || '.jpg' WHEN category = 'en' THEN cover END AS cover
FROM posts_fx JOIN (SELECT doc_id AS arrival, n_chars FROM documents) USING (arrival)"""))
def _(spark, sf):
    d = a.table(spark, sf, "documents")
    assets = d.selectExpr("concat('/covers/', doc_id, '.jpg') as path", "if(n_chars > 900, n_chars, 0) as size")
    p = a.posts(spark, sf).withColumn("cover_original", F.expr("if(category = 'en', cover, 'file:' || cover)"))
    p = p.withColumn("cover", F.expr("if(cover is null, null, concat('/covers/', arrival, '.jpg'))"))
    return enrich.reset_missing_assets(p, assets).select("id", "cover")


@case("join_page_fields", with_ctes(POSTS, body="""
SELECT id, CASE WHEN cover IS NULL AND category <> 'en' THEN 'https://p.example.com/' || arrival ELSE cover END AS cover,
  CASE WHEN preview IS NULL AND (summary IS NULL OR length(summary) < 300) THEN 'page ' || arrival ELSE preview END AS preview FROM posts_fx"""))
def _(spark, sf):
    fields = a.posts(spark, sf).selectExpr(
        "url", "if(category <> 'en', concat('https://p.example.com/', arrival), null) as page_cover", "concat('page  ', arrival) as page_preview"
    )
    return enrich.join_page_fields(a.posts(spark, sf), fields, _settings()).select("id", "cover", "preview")


# Broken copies of the items: the pages table says which fields are spoiled how.
BROKEN = """
bad_fx AS (SELECT arrival, CASE WHEN category = 'de' THEN upper(id) ELSE id END AS id, CASE WHEN len(tags) = 3 THEN '' ELSE title END AS title, CASE WHEN category = 'es' THEN 'ftp:' || url ELSE url END AS url,
  CASE WHEN source_id = 'src7' THEN NULL ELSE published_at END AS published_at, category, tags, source_id, source_name, source_url, CASE WHEN cover IS NULL AND category = 'fr' THEN 'x' ELSE cover END AS cover FROM posts_fx
  UNION ALL SELECT arrival + 1000000, id, title, upper(url), published_at, category, tags, source_id, source_name, source_url, cover FROM posts_fx WHERE category = 'en'),
known_fx AS (SELECT source_id FROM sources_fx WHERE kind = 'feed')"""


def _bad(spark, sf):
    cols = ("arrival", "id", "title", "url", "published_at", "category", "tags", "source_id", "source_name", "source_url", "cover")
    p = a.posts(spark, sf).select(*cols)
    x = p.withColumn("id", F.expr("if(category = 'de', upper(id), id)")).withColumn("title", F.expr("if(size(tags) = 3, '', title)"))
    x = x.withColumn("url", F.expr("if(category = 'es', concat('ftp:', url), url)")).withColumn("published_at", F.expr("if(source_id = 'src7', null, published_at)"))
    x = x.withColumn("cover", F.expr("if(cover is null and category = 'fr', 'x', cover)"))
    y = p.filter("category = 'en'").withColumn("arrival", F.expr("arrival + 1000000")).withColumn("url", F.upper("url"))
    return x.unionByName(y)


@case("check_posts", with_ctes(POSTS, SOURCES, BROKEN, body="""
SELECT arrival AS item, 'title_missing' AS rule FROM bad_fx WHERE trim(title) = ''
UNION ALL SELECT arrival, 'url_not_http' FROM bad_fx WHERE NOT regexp_matches(url, '^https?://', 'i')
UNION ALL SELECT arrival, 'id_not_sha1_of_url' FROM bad_fx WHERE regexp_matches(url, '^https?://', 'i') AND id <> sha1(url)
UNION ALL SELECT arrival, 'date_invalid' FROM bad_fx WHERE published_at IS NULL
UNION ALL SELECT arrival, 'category_unknown' FROM bad_fx WHERE category = 'fr'
UNION ALL SELECT arrival, 'source_unknown' FROM bad_fx WHERE source_id NOT IN (SELECT source_id FROM known_fx)
UNION ALL SELECT arrival, 'cover_invalid' FROM bad_fx WHERE cover = 'x'
UNION ALL (SELECT arrival, 'id_repeated' FROM bad_fx QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival) > 1)
UNION ALL (SELECT arrival, 'url_repeated' FROM bad_fx WHERE regexp_matches(url, '^https?://', 'i') QUALIFY row_number() OVER (PARTITION BY lower(url) ORDER BY arrival) > 1)
UNION ALL (SELECT arrival, 'not_newest_first' FROM (SELECT arrival, epoch_ms(published_at) > epoch_ms(lag(published_at) OVER (ORDER BY arrival)) + 1000 AS late FROM bad_fx WHERE published_at IS NOT NULL) WHERE late)"""))
def _(spark, sf):
    return quality.check_posts(_bad(spark, sf), a.sources(spark, sf).filter("kind = 'feed'"), ("en", "de", "es"))


@case("order_violations", with_ctes(POSTS, body="""
SELECT id AS item, 'not_newest_first' AS rule FROM (SELECT id, epoch_ms(published_at) > epoch_ms(lag(published_at) OVER (PARTITION BY source_id ORDER BY arrival)) + 1000 AS late FROM posts_fx) WHERE late"""))
def _(spark, sf):
    return quality.order_violations(a.posts(spark, sf), ["source_id"], "arrival", "published_at", "id")


@case("check_source_runs", with_ctes(SOURCES, RUNS, """
r_fx AS (SELECT source_id, CASE WHEN errors > 3 THEN '' ELSE 'n' END AS name, 'feed' AS kind, 'https://x' AS url, ok, CASE WHEN new_item_count > 5 THEN NULL ELSE item_count END AS item_count, duration_ms,
  CASE WHEN used = 'cached' THEN 'other' ELSE used END AS used, error FROM runs_fx WHERE visible_item_count > 3)""", body="""
SELECT source_id AS item, 'source_not_configured' AS rule FROM r_fx WHERE source_id NOT IN (SELECT source_id FROM sources_fx WHERE kind = 'feed')
UNION ALL SELECT source_id, 'name_missing' FROM r_fx WHERE name = '' UNION ALL SELECT source_id, 'item_count_missing' FROM r_fx WHERE item_count IS NULL
UNION ALL SELECT source_id, 'used_invalid' FROM r_fx WHERE used = 'other'
UNION ALL SELECT source_id, 'status_missing' FROM sources_fx WHERE kind = 'feed' AND source_id NOT IN (SELECT source_id FROM r_fx)"""))
def _(spark, sf):
    r = a.runs(spark, sf).filter("visible_item_count > 3").selectExpr(
        "source_id", "if(errors > 3, '', 'n') as name", "'feed' as kind", "'https://x' as url", "ok", "if(new_item_count > 5, null, item_count) as item_count",
        "duration_ms", "if(used = 'cached', 'other', used) as used", "error",
    )
    return quality.check_source_runs(r, a.sources(spark, sf).filter("kind = 'feed'"))


@case("check_index", with_ctes(POSTS, body="""
SELECT id AS item, 'item_unknown' AS rule FROM posts_fx WHERE category = 'es' UNION ALL SELECT id, 'hay_empty' FROM posts_fx WHERE category = 'fr'
UNION ALL SELECT 'index', 'count_differs' WHERE (SELECT count(*) FROM posts_fx WHERE category = 'es') > 0"""))
def _(spark, sf):
    p = a.posts(spark, sf)
    index = search_index.build_search_index(p).withColumn("hay", F.expr("if(category = 'fr', ' ', hay)"))
    return quality.check_index(index, p.filter("category <> 'es'"))


@case("check_history", with_ctes(RUNS, """
h_fx AS (SELECT dense_rank() OVER (ORDER BY total_items, run_ts) AS arrival, run_ts AS generated_at, CASE WHEN total_items % 4 = 0 THEN NULL ELSE total_items END AS total_items, ok_sources
 FROM (SELECT run_ts, sum(item_count) AS total_items, count(*) FILTER (ok) AS ok_sources FROM runs_fx GROUP BY run_ts))""", body="""
SELECT CAST(arrival AS VARCHAR) AS item, 'total_items_missing' AS rule FROM h_fx WHERE total_items IS NULL
UNION ALL SELECT CAST(arrival AS VARCHAR), 'not_ascending' FROM (SELECT arrival, generated_at < lag(generated_at) OVER (ORDER BY arrival) AS back FROM h_fx) WHERE back"""))
def _(spark, sf):
    from pyspark.sql import Window

    r = a.runs(spark, sf).groupBy(F.col("run_ts").alias("generated_at")).agg(F.sum("item_count").alias("total_items"), F.count_if("ok").alias("ok_sources"))
    rank = F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("total_items", "generated_at"))  # one row per run
    h = r.withColumn("arrival", rank).withColumn("total_items", F.expr("if(total_items % 4 = 0, null, total_items)"))
    return quality.check_history(h, ("total_items", "ok_sources"))


@case("check_copies", with_ctes(POSTS, PREVIOUS, body="""
SELECT true AS differs, 'internal' AS copy, count(*) AS rows FROM posts_fx UNION ALL SELECT true, 'published', count(*) FROM previous_fx"""))
def _(spark, sf):
    return quality.check_copies({"internal": a.posts(spark, sf), "published": a.previous(spark, sf)})


@case("quality_report", with_ctes(POSTS, """
v_fx AS (SELECT arrival AS item, 'cover_missing' AS rule FROM posts_fx WHERE cover IS NULL UNION ALL SELECT arrival, 'no_tags' FROM posts_fx WHERE len(tags) = 0)""", body="""
SELECT rule, count(*) AS total, count(*) FILTER (rn <= 60) AS shown FROM (SELECT *, row_number() OVER (ORDER BY item, rule) AS rn FROM v_fx) GROUP BY rule"""))
def _(spark, sf):
    rules = {"cover_missing": F.col("cover").isNull(), "no_tags": F.size("tags") == 0}
    return quality.quality_report(quality.violations(a.posts(spark, sf), F.col("arrival"), rules))


BASE = "https://feeds.example.com"
XML = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


RSS = f"""
rss_fx AS (SELECT id, '<item>' || chr(10) || '<title>' || {XML("coalesce(title_ja, title)")} || '</title>' || chr(10) || '<link>{BASE}/ja/p/' || id || '/</link>' || chr(10) || '<guid isPermaLink="true">{BASE}/ja/p/' || id || '/</guid>' || chr(10)
 || '<pubDate>' || strftime(published_at, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate>' || chr(10)
 || '<description><![CDATA[' || CASE WHEN trim(coalesce(preview, summary, '')) <> '' THEN trim(coalesce(preview, summary)) ELSE source_name || ' · ' || strftime(published_at, '%Y/%-m/%-d %H:%M:%S') END || chr(10) || chr(10) || '元記事：' || url || ']]></description>' || chr(10) || '</item>' AS xml, row_number() OVER (ORDER BY published_at DESC, arrival) AS place
FROM posts_fx QUALIFY place <= 120)"""


def rss_items(spark, sf):
    return publish.rss_items(a.posts(spark, sf), "ja", BASE)


@case("rss_items", with_ctes(POSTS, RSS, body="""
SELECT id, xml, place FROM rss_fx"""))
def _(spark, sf):
    place = F.row_number().over(Window.orderBy(F.col("published_ms").desc(), "arrival"))  # 120 rows
    return rss_items(spark, sf).select("id", "xml", place.alias("place"))


@case("rss_document", with_ctes(POSTS, RSS, body=f"""
SELECT concat_ws(chr(10), '<?xml version="1.0" encoding="UTF-8"?>', '<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom">', '<channel>', '<title>A &amp; B</title>',
  '<link>{BASE}/</link>', '<atom:link href="{BASE}/feed.xml" rel="self" type="application/rss+xml" />', '<description>d</description>', '<language>ja</language>', '<ttl>30</ttl>',
  string_agg(xml, chr(10) ORDER BY place), '</channel>' || chr(10) || '</rss>') AS value FROM rss_fx"""))
def _(spark, sf):
    return publish.rss_document(rss_items(spark, sf), "A & B", f"{BASE}/", f"{BASE}/feed.xml", "d", "ja", 30)


@case("json_feed_items", with_ctes(POSTS, body=f"""
SELECT id, '{BASE}/zh/p/' || id || '/' AS url, coalesce(title_zh, title) AS title, CASE WHEN trim(coalesce(preview, summary, '')) <> '' THEN trim(coalesce(preview, summary)) ELSE source_name END AS content_text,
 strftime(published_at, '%Y-%m-%dT%H:%M:%S.000Z') AS date_published, cover AS image FROM posts_fx ORDER BY published_at DESC, arrival LIMIT 120"""))
def _(spark, sf):
    out = publish.json_feed_items(a.posts(spark, sf), "zh", BASE)
    t = out.select("id", F.from_json("json", "url string, title string, content_text string, date_published string, image string").alias("j"))
    return t.select("id", "j.*")


@case("opml_outlines", with_ctes(SOURCES, body=f"""
SELECT list_position(['fr', 'en', 'de'], category) AS section, name, '<outline text="' || name || '" title="' || name || '" type="' || CASE WHEN kind = 'feed' THEN 'rss" xmlUrl="' || url ELSE 'link' END
 || '" htmlUrl="' || coalesce(homepage, url) || '" category="' || CASE category WHEN 'fr' THEN 'R&amp;D' ELSE category END || '" />' AS xml FROM sources_fx WHERE category IN ('fr', 'en', 'de')"""))
def _(spark, sf):
    return publish.opml_outlines(a.sources(spark, sf), "zh", ("fr", "en", "de"), {"fr": "R&D"}).select("section", "name", "xml")


@case("sitemap_entries", with_ctes(POSTS, """
pages_fx AS (SELECT '/' AS p UNION ALL SELECT '/' || l || '/' || s FROM (VALUES ('zh'), ('ja')) a(l), (VALUES (''), ('status/'), ('about/'), ('bookmarks/'), ('c/en/'), ('c/de/')) b(s))""", body=f"""
SELECT '{BASE}' || p AS loc, '2024-01-31T00:00:00.000Z' AS lastmod FROM pages_fx
UNION ALL SELECT '{BASE}/' || l || '/p/' || id || '/', strftime(published_at, '%Y-%m-%dT%H:%M:%S.000Z') FROM (SELECT * FROM posts_fx ORDER BY published_at DESC, arrival LIMIT 5000), (VALUES ('zh'), ('ja')) a(l)"""))
def _(spark, sf):
    return publish.sitemap_entries(a.posts(spark, sf), ("en", "de"), ("zh", "ja"), BASE, a.now()).select("loc", "lastmod")


@case("chunk_text")
def _(spark, sf):
    chunks = a.table(spark, sf, "documents").select("doc_id", F.posexplode(text.chunk_text(F.col("text"), 1200)).alias("n", "chunk"))
    return chunks
