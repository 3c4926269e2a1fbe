"""Feed and list-page parsing and whole runs; bodies are built from the documents, one per document."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweave import config
from feedweave.functions.text import escape_xml
from feedweave.operators import merge
from feedweave.plans import sync as sy
from feedweave.session import checkpoint
from feedweave.sources import feeds
from verification import adapters as a
from verification.adapters import BEFORE, NOW, POSTS, RUNS, SOURCES, with_ctes
from verification.cases_columns import RULES_SQL
from verification.cases_search import NORM

QUERIES, SQL = {}, {}


def case(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# Control characters cannot be part of XML; the texts of the items are made without them.
PLAIN = r"[\x00-\x1f\x7f]+"


def items_source(spark, sf):
    p = a.posts(spark, sf)
    body = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("summary", "preview"), PLAIN, " "), " +", " "))
    title = F.trim(F.regexp_replace(F.regexp_replace("title", PLAIN, " "), " +", " "))
    return p.withColumn("title", title).withColumn("body_text", body)


ITEMS = r"""
items_fx AS (SELECT * EXCLUDE (title), trim(regexp_replace(regexp_replace(title, '[\x00-\x1f\x7f]+', ' ', 'g'), ' +', ' ', 'g')) AS title,
  trim(regexp_replace(regexp_replace(coalesce(summary, preview), '[\x00-\x1f\x7f]+', ' ', 'g'), ' +', ' ', 'g')) AS body_text FROM posts_fx)"""


def bodies(spark, sf):
    """One feed body per item: RSS, Atom or RDF by source, each with a second item that lacks a link or title."""
    p = items_source(spark, sf)
    t, b, u = escape_xml(F.col("title")), escape_xml(F.concat(F.lit("<p>"), escape_xml(F.col("body_text")), F.lit('</p><img src="/i.png">'))), F.col("url")
    rfc = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    iso = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rss = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>c</title><item><title>'), t,
        F.lit("</title><link> "), u, F.lit("?utm_source=rss&amp;x=1#top </link><pubDate>"), rfc, F.lit("</pubDate><description>"), b,
        F.lit('</description><enclosure url="/a.mp3" type="audio/mpeg"/><media:content url="/m.png" medium="image"/></item><item><title>no link</title></item></channel></rss>'),
    )
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="text">'), t, F.lit('</title><link rel="self" href="https://self.example/"/><link rel="alternate" href="'), u,
        F.lit('"/><link rel="enclosure" type="image/png" href="https://cdn.example/e"/><updated>'), iso, F.lit('</updated><content type="html">'), b, F.lit("</content></entry><entry><link href=\"https://x.example/\"/></entry></feed>"),
    )
    rdf = F.concat(
        F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title></channel><item><title>'),
        t, F.lit("</title><link>"), u, F.lit("</link><description>"), b, F.lit("</description><dc:date>"), iso, F.lit("</dc:date></item></rdf:RDF>"),
    )
    n = F.regexp_extract("source_id", r"(\d+)$", 1).cast("int")
    # Stands for the stored bodies: made once, on all cores, however often and with what filter they are read.
    return checkpoint(p.select("source_id", F.col("arrival").alias("body_no"), F.when(n < 7, rss).when(n < 13, atom).otherwise(rdf).alias("body")))


NUM = "CAST(regexp_extract(source_id, '([0-9]+)$', 1) AS INT)"


@case("parse_feeds", with_ctes(POSTS, ITEMS, body=f"""
SELECT arrival AS body_no, title, url || CASE WHEN {NUM} < 7 THEN '?utm_source=rss&x=1#top' ELSE '' END AS url,
  CASE WHEN {NUM} < 7 THEN strftime(published_at, '%a, %d %b %Y %H:%M:%S +0000') ELSE strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') END AS published_raw,
  CASE WHEN {NUM} < 7 THEN '/m.png' WHEN {NUM} < 13 THEN 'https://cdn.example/e' END AS cover_raw FROM items_fx WHERE title <> ''"""))
def _(spark, sf):
    return feeds.parse_feeds(bodies(spark, sf)).select("body_no", "title", "url", "published_raw", "cover_raw")


CUT = "CASE WHEN length(body_text) <= {0} THEN body_text ELSE rtrim(substring(body_text, 1, {0} - 1)) || '…' END"
TITLE_CUT = "CASE WHEN length(title) <= 180 THEN title ELSE rtrim(substring(title, 1, 179)) || '…' END"
COVER = f"CASE WHEN {NUM} < 7 THEN 'https://' || source_id || '.example.com/m.png' WHEN {NUM} < 13 THEN 'https://cdn.example/e' ELSE 'https://' || source_id || '.example.com/i.png' END"
PROJECTED = f"""
projected_fx AS (SELECT arrival, published_at, source_id, {TITLE_CUT} AS title, url || CASE WHEN {NUM} < 7 THEN '?x=1' ELSE '' END AS url, nullif({CUT.format(220)}, '') AS summary, {COVER} AS cover
  FROM items_fx WHERE title <> '')"""


@case("project_feed_items", with_ctes(POSTS, ITEMS, PROJECTED, body="SELECT arrival AS body_no, summary, cover, strftime(published_at, '%Y-%m-%d %H:%M') AS \"at\" FROM projected_fx"))
def _(spark, sf):
    out = feeds.project_feed_items(feeds.parse_feeds(bodies(spark, sf)), a.sources(spark, sf))
    return out.select("body_no", "summary", "cover", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("at"))


def listings(spark, sf):
    p = items_source(spark, sf)
    page = F.concat(
        F.lit('<section class="item hot"><a class="link" href="/article/2024/01/02/'), F.col("arrival").cast("string"), F.lit('.html">x</a><div class="title"> '), escape_xml(F.col("title")),
        F.lit('</div><time datetime="'), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('">t</time><p class="summary">'), escape_xml(F.col("body_text")),
        F.lit('</p><img class="figure" src="/f.png"></section><section class="item"><a class="link" href="/article/bad">x</a><div class="title">bad</div></section>'),
    )
    return p.select(F.lit("animeanime-list").alias("source_id"), F.col("arrival").alias("body_no"), page.alias("body"))


@case("parse_listing", with_ctes(POSTS, ITEMS, body=f"""
SELECT arrival AS body_no, {TITLE_CUT} AS title, 'https://animeanime.jp/article/2024/01/02/' || arrival || '.html' AS url, 'https://animeanime.jp/f.png' AS cover,
  nullif({CUT.format(220)}, '') AS summary, strftime(published_at, '%Y-%m-%d %H:%M') AS "at" FROM items_fx WHERE title <> ''"""))
def _(spark, sf):
    out = feeds.parse_listing(listings(spark, sf))
    return out.select("body_no", "title", "url", "cover", "summary", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("at"))


BUILT = f"""
built_fx AS (SELECT sha1(url) AS id, title, summary, url, published_at, cover, s.category, CASE WHEN len(tg) > 0 THEN tg[1:6] ELSE ['资讯'] END AS tags, source_id, s.name AS source_name,
   coalesce(s.homepage, s.url_s) AS source_url, arrival
  FROM (SELECT *, {RULES_SQL} AS tg FROM (SELECT *, title || chr(10) || coalesce(summary, '') AS b FROM projected_fx)) JOIN (SELECT source_id, name, category, homepage, url AS url_s, pattern FROM sources_fx) s USING (source_id)
  WHERE s.pattern IS NULL OR regexp_matches(b, s.pattern))"""


def all_feeds(spark, sf):
    return a.sources(spark, sf).withColumn("kind", F.lit("feed"))


@case("build_posts", with_ctes(POSTS, ITEMS, SOURCES, PROJECTED, BUILT, body="""
SELECT id, title, summary, url, category, array_to_string(tags, '|') AS tags, source_id, source_name, source_url, cover FROM built_fx"""))
def _(spark, sf):
    s = all_feeds(spark, sf)
    out = sy.build_posts(sy.raw_items(bodies(spark, sf), s), s)
    return out.select("id", "title", "summary", "url", "category", F.array_join("tags", "|").alias("tags"), "source_id", "source_name", "source_url", "cover")


# Run: the bodies dated after the previous snapshot arrive now; one source failed to load, one was unchanged.
RUN = f"""
raw_fx AS (SELECT * FROM projected_fx WHERE published_at >= TIMESTAMP '{BEFORE}'),
now_fx AS (SELECT * FROM built_fx WHERE published_at >= TIMESTAMP '{BEFORE}'),
old_fx AS (SELECT * FROM built_fx WHERE published_at < TIMESTAMP '{BEFORE}'),
dec_fx AS (SELECT source_id, raw_items, prev_items, CASE WHEN source_id = 'src3' THEN 'cached' WHEN source_id = 'src5' OR raw_items = 0
    OR (prev_items >= 12 AND raw_items < greatest(3, floor(prev_items * 0.15))) THEN 'fallback' ELSE 'fetched' END AS used
  FROM (SELECT source_id, (SELECT count(*) FROM raw_fx r WHERE r.source_id = s.source_id) AS raw_items, (SELECT count(*) FROM old_fx o WHERE o.source_id = s.source_id) AS prev_items FROM sources_fx s)),
all_fx AS (SELECT *, 0 AS phase FROM old_fx UNION ALL SELECT *, 1 FROM now_fx WHERE source_id IN (SELECT source_id FROM dec_fx WHERE used = 'fetched')
  UNION ALL SELECT *, 1 FROM old_fx WHERE source_id IN (SELECT source_id FROM dec_fx WHERE used <> 'fetched')),
uniq_fx AS (SELECT *, min((phase, arrival)) OVER (PARTITION BY lower(url)) AS seen, row_number() OVER (PARTITION BY lower(url) ORDER BY length(coalesce(summary, '')) + CASE WHEN cover IS NOT NULL THEN 20 ELSE 0 END DESC, phase DESC, arrival DESC) AS rn FROM all_fx),
next_fx AS (SELECT * FROM uniq_fx WHERE rn = 1 AND published_at >= TIMESTAMP '{NOW}' - INTERVAL 25 DAY)"""
RUN_CTES = (POSTS, ITEMS, SOURCES, PROJECTED, BUILT, RUN)


def run(spark, sf):
    s = checkpoint(all_feeds(spark, sf))  # stands for the stored source table
    every = bodies(spark, sf).join(a.posts(spark, sf).select(F.col("arrival").alias("body_no"), "published_at"), "body_no")
    old = F.col("published_at") < F.lit(BEFORE).cast("timestamp")
    fresh, before = every.filter(~old).drop("published_at"), every.filter(old).drop("published_at")
    previous = checkpoint(sy.build_posts(sy.raw_items(before, s), s))  # stands for the stored snapshot
    fetched = s.select(
        "source_id", F.expr("case source_id when 'src3' then 304 when 'src5' then 503 else 200 end").alias("http_status"), (F.col("source_id") != "src5").alias("fetch_ok"),
        F.lit(None).cast("string").alias("parse_error"), F.lit(500).alias("duration_ms"),
    )
    earlier = a.history_runs(spark, sf).filter("run_ts = timestamp'2024-01-30'")
    return sy.sync(fresh, fetched, s, previous, earlier, None, a.now(), config.Settings(days=25))


@case("sync_posts", with_ctes(*RUN_CTES, body="SELECT id, title, summary, source_id, category, strftime(published_at, '%Y-%m-%d %H:%M') AS \"at\" FROM next_fx"))
def _(spark, sf):
    return run(spark, sf).posts.select("id", "title", "summary", "source_id", "category", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("at"))


# The search tables of the published snapshot.
@case("sync_search", with_ctes(*RUN_CTES, body=f"""
SELECT id, {NORM.format("concat_ws(' ', title, coalesce(summary, ''), array_to_string(tags, ' '), source_name, source_id, category)")} AS hay, epoch_ms(published_at) AS published_ms, title, summary AS shown
FROM next_fx"""))
def _(spark, sf):
    result = run(spark, sf)
    slim = result.search_posts.select("id", "title", F.col("summary").alias("shown"))
    return result.search_rows.select("id", "hay", "published_ms").join(slim, "id")


@case("sync_runs", with_ctes(RUNS, *RUN_CTES, body="""
SELECT source_id, raw_items, prev_items, used, used <> 'fallback' AS ok, CASE WHEN used <> 'fallback' THEN 0 ELSE coalesce(p.consecutive_fails, 0) + 1 END AS consecutive_fails,
  CASE WHEN used = 'fetched' THEN (SELECT count(*) FROM now_fx n WHERE n.source_id = d.source_id) ELSE prev_items END AS item_count,
  CASE WHEN used = 'fetched' THEN (SELECT count(*) FROM now_fx n WHERE n.source_id = d.source_id AND n.id NOT IN (SELECT id FROM old_fx)) ELSE 0 END AS new_item_count,
  (SELECT count(*) FROM next_fx x WHERE x.source_id = d.source_id) AS visible_items
FROM dec_fx d LEFT JOIN (SELECT source_id, consecutive_fails FROM streaks_fx WHERE run_ts = TIMESTAMP '2024-01-30') p USING (source_id)"""))
def _(spark, sf):
    return run(spark, sf).runs.select("source_id", "raw_items", "prev_items", "used", "ok", "consecutive_fails", "item_count", "new_item_count", "visible_items")


# Pages of the posts: each document also has a page with a cover and a description.
@case("enrich_from_pages", with_ctes(POSTS, """
wants_fx AS (SELECT *, cover IS NULL AS lacks_cover, preview IS NULL AND (summary IS NULL OR length(summary) < 300) AS want_preview FROM posts_fx),
tried_fx AS (SELECT * FROM wants_fx WHERE lacks_cover OR want_preview),
done_fx AS (SELECT id FROM tried_fx)""", body="""
SELECT id, CASE WHEN lacks_cover AND id IN (SELECT id FROM done_fx) THEN 'https://' || source_id || '.example.com/og/' || arrival || '.png' ELSE cover END AS cover,
  CASE WHEN want_preview AND id IN (SELECT id FROM done_fx) THEN 'A description of page number ' || arrival ELSE preview END AS preview FROM wants_fx"""))
def _(spark, sf):
    p = a.posts(spark, sf)
    html = F.concat(
        F.lit('<html><head><meta property="og:image" content="/og/'), F.col("arrival").cast("string"), F.lit('.png"><meta name="description" content="A description of page number '),
        F.col("arrival").cast("string"), F.lit('"></head><body><p>text</p></body></html>'),
    )
    state = p.limit(0).selectExpr("url", *[f"cast(null as timestamp) as {k}_{s}_at" for k in ("cover", "preview") for s in ("miss", "ok")])
    settings = config.Settings(preview_min_len=300)
    out, _ = sy.enrich_from_pages(p, state, p.select("url", html.alias("html")), a.now(), settings)
    return out.select("id", "cover", "preview")
