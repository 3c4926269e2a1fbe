"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweave import config
from feedweave.functions import dates, privacy, scores, text, urls
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


def _pages(spark, sf):
    return a.table(spark, sf, "pages")


TRACK = "^(utm_.*|fbclid|gclid|igshid|mc_cid|mc_eid|mkt_tok|yclid)(=|$)"
URL_PARTS = r"""
url_fx AS (SELECT page_id, url, length(html) AS summary_len, lower(regexp_extract(url, '^(https?)://', 1)) AS scheme,
  lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(url, '(#.*)$', 1) AS frag FROM pages),
norm_fx AS (SELECT *, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS norm
  FROM (SELECT *, list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '""" + TRACK + r"""', 'i')) AS kept FROM url_fx))"""


@case("normalize_url", with_ctes(URL_PARTS, body="SELECT page_id, norm AS url_norm FROM norm_fx"))
def _(spark, sf):
    return _pages(spark, sf).select("page_id", urls.normalize_url(F.col("url")).alias("url_norm"))


@case("stable_id", with_ctes(URL_PARTS, body="SELECT page_id, sha1(norm) AS id FROM norm_fx"))
def _(spark, sf):
    return _pages(spark, sf).select("page_id", urls.stable_id(F.col("url")).alias("id"))


@case("safe_external_url", with_ctes(URL_PARTS, body="""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END
  || CASE WHEN query = '' THEN '' ELSE '?' || query END || frag END AS safe FROM url_fx"""))
def _(spark, sf):
    odd = F.col("page_id") % 2 == 1
    mixed = F.when(odd, F.concat(F.lit("javascript:"), "url")).otherwise(F.concat(F.lit("  "), "url", F.lit(" ")))
    return _pages(spark, sf).select("page_id", urls.safe_external_url(mixed).alias("safe"))


@case("strip_truncate", """
SELECT doc_id, CASE WHEN length(t) <= 180 THEN t ELSE rtrim(substring(t, 1, 179)) || '…' END AS short
FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n\\f\\v\\x{a0}]+', ' ', 'g')) AS t FROM documents)""")
def _(spark, sf):
    return a.table(spark, sf, "documents").select("doc_id", text.strip_truncate(F.col("text"), 180).alias("short"))


# The rules' word boundary is ASCII in both engines; RE2's \b is ASCII already.
RULES_SQL = "list_filter([" + ", ".join(
    "CASE WHEN regexp_matches(b, '{}', 'i') THEN '{}' END".format(
        p.replace(r"(?<![0-9A-Za-z_])PV(?![0-9A-Za-z_])", r"\bPV\b"), tag)
    for tag, p in config.TAG_RULES) + "], lambda x: x IS NOT NULL)"


@case("derive_tags", f"""
SELECT doc_id, array_to_string(CASE WHEN len(t) > 0 THEN t[1:6] ELSE [CASE lang WHEN 'game' THEN '游戏' WHEN 'goods' THEN '周边' WHEN 'seiyuu' THEN '声优' ELSE '资讯' END] END, '|') AS tags
FROM (SELECT doc_id, lang, {RULES_SQL} AS t FROM (SELECT doc_id, lang, substring(text, 1, 80) || chr(10) || text AS b FROM documents))""")
def _(spark, sf):
    tags = text.derive_tags(F.substring("text", 1, 80), F.col("text"), F.col("lang"))
    return a.table(spark, sf, "documents").select("doc_id", F.array_join(tags, "|").alias("tags"))


@case("within_days", with_ctes(POSTS, body=f"SELECT id FROM posts_fx WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY"))
def _(spark, sf):
    return a.posts(spark, sf).filter(dates.within_days(F.col("published_at"), 10, a.now())).select("id")


@case("is_fresh", with_ctes(POSTS, body="""
SELECT id, published_at <= TIMESTAMP '2024-01-20 12:00:00' AND published_at > TIMESTAMP '2024-01-20 06:00:00' AS fresh FROM posts_fx"""))
def _(spark, sf):
    clock = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return a.posts(spark, sf).select("id", dates.is_fresh(F.col("published_at"), clock).alias("fresh"))


@case("normalize_text", r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(text), chr(12288), ' '), '[\x{200b}-\x{200d}\x{feff}]', '', 'g'), '[ \t\r\n\f\v\x{a0}]+', ' ', 'g')) AS norm FROM documents""")
def _(spark, sf):
    return a.table(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@case("dedup_key", f"SELECT doc_id, {a.dedup_key_sql('text')} AS dedup_key FROM documents")
def _(spark, sf):
    return a.table(spark, sf, "documents").select("doc_id", text.dedup_key(F.col("text")).alias("dedup_key"))


@case("read_minutes", f"SELECT doc_id, {a.read_minutes_sql('text')} AS minutes FROM documents")
def _(spark, sf):
    return a.table(spark, sf, "documents").select("doc_id", text.read_minutes(F.col("text")).alias("minutes"))


@case("parse_published", r"""
SELECT event_id, strftime(CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 3 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS at FROM events""")
def _(spark, sf):
    kinds = """case event_id % 5
      when 0 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
      when 1 then concat('Mon, ', date_format(ts, 'dd MMM yyyy HH:mm:ss'), ' +0000')
      when 2 then concat('Mon, ', date_format(ts, 'd MMM yyyy HH:mm:ss'), ' GMT')
      when 3 then date_format(ts, 'yyyy-MM-dd')
      else concat('not a date ', event_id) end"""
    raw = a.table(spark, sf, "events").select("event_id", F.expr(kinds).alias("raw"))
    return raw.select("event_id", F.date_format(dates.parse_published(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@case("pulse_score", with_ctes(*a.ALL_POSTS, body="SELECT id, pulse_score FROM enriched_fx"))
def _(spark, sf):
    from feedweave.operators import health

    h = health.source_health(health.latest_runs(a.history_runs(spark, sf)))
    p = health.attach_health(a.posts(spark, sf), h)
    cols = [F.col(c) for c in ("published_at", "tags", "cover", "summary", "preview", "source_health")]
    return p.select("id", scores.pulse_score(*cols, a.now()).alias("pulse_score"))


@case("health_level", with_ctes(RUNS, body="""
SELECT source_id, strftime(run_ts, '%Y-%m-%d') AS day, CASE WHEN NOT ok THEN 'down' WHEN consecutive_fails >= 2 OR used = 'fallback' THEN 'warn'
    WHEN consecutive_fails = 0 AND used = 'fetched' AND duration_ms > 0 AND duration_ms <= 1200 THEN 'excellent' ELSE 'good' END AS level FROM streaks_fx"""))
def _(spark, sf):
    level = scores.health_level(F.col("ok"), F.col("used"), F.col("consecutive_fails"), F.col("duration_ms"))
    return a.history_runs(spark, sf).select("source_id", F.date_format("run_ts", "yyyy-MM-dd").alias("day"), level.alias("level"))


@case("pick_localized", with_ctes(POSTS, body="""
SELECT id, coalesce(title_zh, title) AS title_zh, coalesce(title_ja, title) AS title_ja,
  coalesce(preview_zh, summary_zh, preview, summary) AS feed_zh, coalesce(summary_ja, preview_ja, summary, preview) AS card_ja FROM posts_fx"""))
def _(spark, sf):
    return a.posts(spark, sf).select(
        "id", text.pick_localized("title", "zh").alias("title_zh"), text.pick_localized("title", "ja").alias("title_ja"),
        text.pick_localized("feed", "zh").alias("feed_zh"), text.pick_localized("card", "ja").alias("card_ja"),
    )


@case("relative_age_label", with_ctes(POSTS, body="""
SELECT id, CASE WHEN h < 0 THEN NULL WHEN h = 0 THEN '1時間未満' WHEN h < 24 THEN h || '時間前' ELSE (h // 24) || '日前' END AS label
FROM (SELECT id, CAST(floor(date_diff('minute', published_at, TIMESTAMP '2024-01-20 12:30:00') / 60.0) AS INT) AS h FROM posts_fx)"""))
def _(spark, sf):
    clock = F.lit("2024-01-20 12:30:00").cast("timestamp")
    return a.posts(spark, sf).select("id", text.relative_age_label(F.col("published_at"), clock, "ja").alias("label"))


@case("category_alias", """
SELECT doc_id, CASE word WHEN '动画' THEN 'anime' WHEN 'グッズ' THEN 'goods' WHEN '声優' THEN 'seiyuu' ELSE word END AS category
FROM (SELECT doc_id, CASE lang WHEN 'en' THEN '动画' WHEN 'de' THEN 'グッズ' WHEN 'fr' THEN '声優' ELSE source END AS word FROM documents)""")
def _(spark, sf):
    word = F.expr("case lang when 'en' then '动画' when 'de' then 'グッズ' when 'fr' then '声優' else source end")
    return a.table(spark, sf, "documents").select("doc_id", text.category_alias(word).alias("category"))


@case("needs_translation", with_ctes(POSTS, SOURCES, body=r"""
SELECT id, (lang IS DISTINCT FROM 'zh' AND (title_zh IS NULL OR summary IS NOT NULL OR preview IS NOT NULL))
  OR (lang IS DISTINCT FROM 'ja' AND ((title_ja IS NULL AND NOT regexp_matches(title, '[\x{3041}-\x{30ff}]'))
    OR (summary IS NOT NULL AND NOT regexp_matches(summary, '[\x{3041}-\x{30ff}]'))
    OR (preview IS NOT NULL AND NOT regexp_matches(preview, '[\x{3041}-\x{30ff}]')))) AS needed
FROM posts_fx LEFT JOIN (SELECT source_id, lang FROM sources_fx) USING (source_id) WHERE title <> ''"""))
def _(spark, sf):
    s = a.sources(spark, sf).select("source_id", "lang")
    p = a.posts(spark, sf).filter("title <> ''").join(s, "source_id", "left")
    return p.select("id", text.post_needs_translation(F.col("lang")).alias("needed"))


@case("cover_url_tests", r"""
SELECT page_id, regexp_matches(u, 'favicon|apple-touch-icon|site-icon|siteicon|manifest|sprite|avatar|emoji|spacer|blank|placeholder|noimage|no_image|/icons?/|/logo\.|/logos?/', 'i') AS decorative,
  regexp_matches(u, '\.(png|jpe?g|gif|webp|avif|bmp|svg)(\?|#|$)', 'i') AS image
FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 4 WHEN 0 THEN '/logo.png' WHEN 1 THEN '/Icons/x' WHEN 2 THEN '/a.JPEG?w=1' ELSE '' END AS u FROM pages)""")
def _(spark, sf):
    tail = F.expr("case page_id % 4 when 0 then '/logo.png' when 1 then '/Icons/x' when 2 then '/a.JPEG?w=1' else '' end")
    u = F.concat(F.regexp_replace("url", r"[?#].*$", ""), tail)
    return _pages(spark, sf).select("page_id", urls.is_non_cover_image(u).alias("decorative"), urls.is_image_url(u).alias("image"))


@case("resolve_cover", r"""
SELECT page_id, CASE WHEN page_id % 5 = 4 THEN NULL WHEN page_id % 5 = 3 THEN '/base/covers/' || page_id
  WHEN url LIKE 'http://%' THEN 'https://images.weserv.nl/?url=' || url_encode(url) || '&w=640&fit=cover&n=-1' ELSE url END AS src,
  CASE WHEN page_id % 5 = 4 THEN NULL WHEN page_id % 5 = 3 THEN '/covers/' || page_id ELSE url END AS original FROM pages""")
def _(spark, sf):
    c = F.expr(
        "case page_id % 5 when 4 then concat('https://www.animenewsnetwork.com/x', page_id) when 3 then concat('/covers/', page_id) else url end"
    )
    cover = urls.resolve_cover(c, 640, "/base/")
    return _pages(spark, sf).select("page_id", cover["src"].alias("src"), cover["original"].alias("original"))


@case("absolute_url", r"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN o || '/img/' || page_id || '.png' WHEN 1 THEN regexp_extract(url, '^(https?):', 1) || '://cdn.example.com/' || page_id
  WHEN 2 THEN NULL ELSE url END AS abs FROM (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS o FROM pages)""")
def _(spark, sf):
    raw = F.expr(
        "case page_id % 4 when 0 then concat('/img/', page_id, '.png') when 1 then concat('//cdn.example.com/', page_id) "
        "when 2 then 'data:image/gif;base64,xx' else url end"
    )
    return _pages(spark, sf).select("page_id", urls.absolute_url(raw, F.col("url")).alias("abs"))


@case("best_srcset", r"""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '?b' WHEN 1 THEN url || '?c' ELSE url || '?a' END AS best
FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)""")
def _(spark, sf):
    u = F.regexp_replace("url", r"[?#].*$", "")
    rest = F.expr("case page_id % 3 when 0 then '?b 900w, ' when 1 then '?b 90w, ' else '?b zz, ' end")
    last = F.expr("case page_id % 3 when 0 then '?c 900w' when 1 then '?c 2x' else '?c' end")
    return _pages(spark, sf).select(
        "page_id", urls.best_srcset(F.concat(u, F.lit("?a 0w, "), u, rest, u, last)).alias("best")
    )


@case("trim_url_punct", r"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '(x)' WHEN 2 THEN url ELSE url END AS trimmed
FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)""")
def _(spark, sf):
    tail = F.expr("case page_id % 4 when 0 then ').,' when 1 then '(x)' when 2 then '）】。' else '!' end")
    return _pages(spark, sf).select(
        "page_id", urls.trim_url_punct(F.concat(F.regexp_replace("url", r"[?#].*$", ""), tail)).alias("trimmed")
    )


@case("url_compare_key", with_ctes(URL_PARTS, body=r"""
SELECT page_id, regexp_replace(host, '^www\.', '') || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '/+$', '/') AS key FROM url_fx"""))
def _(spark, sf):
    tail = F.expr("if(page_id % 2 = 0, '', '%EF%BC%89')")
    plain = F.expr("if(instr(url, '#') + instr(url, '?') > 0, url, concat(url, if(page_id % 2 = 0, '', '%EF%BC%89')))")
    return _pages(spark, sf).select("page_id", urls.url_compare_key(plain).alias("key"))


@case("redact_text", with_ctes(URL_PARTS, body=r"""
SELECT page_id, CASE WHEN length(t) <= 60 THEN t ELSE substring(t, 1, 59) || '…' END AS message
FROM (SELECT page_id, 'failed ' || scheme || '://' || host || path || ' twice' AS t FROM url_fx)"""))
def _(spark, sf):
    msg = F.concat(F.lit("failed \n "), "url", F.lit("  twice"))
    return _pages(spark, sf).select("page_id", privacy.redact_text(msg, 60).alias("message"))


@case("redact_stack", with_ctes(URL_PARTS, body=r"""
SELECT page_id, CASE WHEN length(t) <= 90 THEN t ELSE substring(t, 1, 89) || '…' END AS stack
FROM (SELECT page_id, 'Error: x' || chr(10) || '  at f (' || scheme || '://' || host || path || ')' || chr(10) || '  at g' AS t FROM url_fx)"""))
def _(spark, sf):
    stack = F.concat(F.lit(" Error: x\n  at f ("), "url", F.lit(")\n  at g\n"))
    return _pages(spark, sf).select("page_id", privacy.redact_stack(stack, 90).alias("stack"))


@case("error_key", with_ctes(URL_PARTS, body=r"""
SELECT page_id, 'error:load ' || scheme || '://' || host || path || ':at f ' || page_id AS key FROM url_fx"""))
def _(spark, sf):
    stack = F.concat(F.lit("at f "), F.col("page_id").cast("string"), F.lit("\nat g"))
    return _pages(spark, sf).select("page_id", privacy.error_key(F.lit("error"), F.concat(F.lit("load "), "url"), stack).alias("key"))


@case("sanitize_payload", r"""
SELECT event_id, '{"k":' || regexp_extract(props, '([0-9]+)', 1) || ',"api_key":"[redacted]","page":"https://a.example/x","n":[1,{"Token":"[redacted]"}]}' AS data FROM events""")
def _(spark, sf):
    extra = F.lit(',"api_key":"v","page":" https://a.example/x?q=1#f ","n":[1,{"Token":2}]}')
    raw = F.concat(F.regexp_replace("props", r"\}$", ""), extra)
    return a.table(spark, sf, "events").select("event_id", privacy.sanitize_payload(raw).alias("data"))


@case("diagnose_source", with_ctes(RUNS, body=f"""
SELECT source_id, strftime(run_ts, '%Y-%m-%d') AS day, round(stale, 6) AS stale_h,
 CASE WHEN ok AND stale >= 100 THEN 'stale' WHEN ok THEN NULL WHEN consecutive_fails >= 3 THEN 'failing_repeatedly' WHEN http_status = 429 THEN 'rate_limited'
  WHEN http_status IN (401, 403) THEN 'blocked' WHEN http_status = 404 THEN 'moved' WHEN lower(error) LIKE '%parse_%' THEN 'parse_problem'
  WHEN error = 'timeout' THEN 'timeout' ELSE 'other' END AS cause
FROM (SELECT *, greatest(0, epoch_ms(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(latest_published_at) // 1000) / 3600000.0 AS stale FROM streaks_fx)"""))
def _(spark, sf):
    clock = F.lit("2024-01-20 00:00:00").cast("timestamp")
    r = a.history_runs(spark, sf).withColumn("stale", scores.stale_hours(F.col("latest_published_at"), clock))
    cause = scores.diagnose_source(*[F.col(c) for c in ("ok", "stale", "consecutive_fails", "http_status", "error")], stale_after=100)
    return r.select("source_id", F.date_format("run_ts", "yyyy-MM-dd").alias("day"), F.round("stale", 6).alias("stale_h"), cause.alias("cause"))


@case("index_page_url", with_ctes(URL_PARTS, body=r"""
SELECT page_id, CASE page_id % 5 WHEN 4 THEN false ELSE true END AS is_index FROM url_fx"""))
def _(spark, sf):
    path = F.expr("case page_id % 5 when 0 then '' when 1 then '/news/' when 2 then '/x/archive/2024' when 3 then '/Review?x=1' else '/news/1' end")
    u = F.concat(F.regexp_extract("url", r"^https?://[^/?#]*", 0), path)
    return _pages(spark, sf).select("page_id", urls.index_page_url(u).alias("is_index"))
