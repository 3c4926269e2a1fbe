"""Boards, rankings and related items."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweave.operators import boards, health, merge, related
from feedweave.plans import home
from verification import adapters as a
from verification.adapters import NOW, POSTS, RUNS, SOURCES, with_ctes

QUERIES, SQL = {}, {}


def case(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


CLOCK = "2024-01-30 12:00:00"  # some items are still in the future at this hour
RECENT = f"recent_fx AS (SELECT * FROM posts_fx WHERE published_at >= TIMESTAMP '{CLOCK}' - INTERVAL 24 HOUR)"
HOT_RECENT = f"recent_fx AS (SELECT * FROM enriched_fx WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR)"


def scored(spark, sf):
    """Items with health and scores, without the duplicate counts these lists do not use."""
    h = health.source_health(health.latest_runs(a.history_runs(spark, sf)))
    return boards.with_scores(health.attach_health(a.posts(spark, sf), h), a.now())


def clock():
    return F.lit(CLOCK).cast("timestamp")


@case("latest", with_ctes(POSTS, body="SELECT id, title FROM posts_fx ORDER BY published_at DESC, arrival LIMIT 36"))
def _(spark, sf):
    return merge.latest(a.posts(spark, sf), 36).select("id", "title")


@case("hot_tags", with_ctes(POSTS, RECENT, body="""
SELECT tag, count(*) AS count FROM (SELECT arrival, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM recent_fx)
GROUP BY tag ORDER BY count(*) DESC, min((arrival, pos)) LIMIT 12"""))
def _(spark, sf):
    return boards.hot_tags(a.posts(spark, sf), clock())


@case("category_counts", with_ctes(POSTS, RECENT, SOURCES, body="""
SELECT c.category, count(r.id) AS items FROM (SELECT DISTINCT category FROM posts_fx) c LEFT JOIN recent_fx r USING (category) GROUP BY 1"""))
def _(spark, sf):
    p = a.posts(spark, sf)
    return boards.category_counts(p, p.select("category").distinct(), clock())


@case("time_lens_counts", with_ctes(POSTS, body=f"""
SELECT count(*) FILTER (age BETWEEN 0 AND 120) AS h2, count(*) FILTER (age BETWEEN 0 AND 360) AS h6, count(*) FILTER (age BETWEEN 0 AND 1440) AS h24
FROM (SELECT date_diff('minute', published_at, TIMESTAMP '{CLOCK}') AS age FROM posts_fx)"""))
def _(spark, sf):
    return boards.time_lens_counts(a.posts(spark, sf), clock())


@case("category_overview", with_ctes(*a.ALL_POSTS, body=f"""
SELECT *, CAST(floor(stable_sources * 100.0 / sources + 0.5) AS INT) AS stable_ratio FROM (
SELECT category, count(*) AS total, count(*) FILTER (age BETWEEN 0 AND 120) AS h2, count(*) FILTER (age BETWEEN 0 AND 360) AS h6, count(*) FILTER (age BETWEEN 0 AND 1440) AS h24,
  greatest(0, max(pulse_score)) AS top_pulse, count(DISTINCT source_id) AS sources, count(DISTINCT source_id) FILTER (source_health IN ('excellent', 'good')) AS stable_sources
FROM (SELECT *, date_diff('minute', published_at, TIMESTAMP '{CLOCK}') AS age FROM enriched_fx) GROUP BY category)"""))
def _(spark, sf):
    return boards.category_overview(scored(spark, sf), clock())


@case("top_token", with_ctes(POSTS, body="""
(SELECT 'tag' AS kind, token, count(*) AS count FROM (SELECT arrival, lower(unnest(tags)) AS token, generate_subscripts(tags, 1) AS pos FROM posts_fx) GROUP BY token ORDER BY count(*) DESC, length(token) DESC, min((arrival, pos)) LIMIT 1)
UNION ALL (SELECT 'source' AS kind, lower(source_name) AS token, count(*) FROM posts_fx GROUP BY 2 ORDER BY count(*) DESC, length(lower(source_name)) DESC, min(arrival) LIMIT 1)"""))
def _(spark, sf):
    p = a.posts(spark, sf)
    tags = boards.top_token(boards.tag_tokens(p)).withColumn("kind", F.lit("tag"))
    return tags.unionByName(boards.top_token(boards.source_tokens(p)).withColumn("kind", F.lit("source")))


@case("pulse_top", with_ctes(*a.ALL_POSTS, HOT_RECENT, body="SELECT id, title, pulse_score FROM recent_fx ORDER BY pulse_score DESC, arrival LIMIT 6"))
def _(spark, sf):
    return boards.pulse_top(scored(spark, sf), a.now()).select("id", "title", "pulse_score")


@case("spotlight", with_ctes(*a.ALL_POSTS, HOT_RECENT, body="SELECT id, cover, pulse_score FROM recent_fx ORDER BY cover IS NOT NULL DESC, pulse_score DESC, arrival LIMIT 6"))
def _(spark, sf):
    return boards.spotlight(scored(spark, sf), a.now()).select("id", "cover", "pulse_score")


@case("random_pick", with_ctes(POSTS, body="""
SELECT id FROM (SELECT id FROM posts_fx ORDER BY published_at DESC, arrival LIMIT 200) ORDER BY sha1('7:' || id) LIMIT 1"""))
def _(spark, sf):
    return boards.random_pick(a.posts(spark, sf), seed=7).select("id")


@case("sort_posts", with_ctes(*a.ALL_POSTS, body="SELECT id, pulse_score FROM enriched_fx"))
def _(spark, sf):
    return boards.sort_posts(scored(spark, sf), "pulse").select("id", "pulse_score")


@case("brief_lines", with_ctes(POSTS, body=f"""
SELECT line_no, line_no || '. ' || coalesce(title_zh, title) AS line FROM (SELECT *, row_number() OVER (ORDER BY published_at DESC, arrival) AS line_no
FROM posts_fx WHERE published_at >= TIMESTAMP '{CLOCK}' - INTERVAL 24 HOUR) WHERE line_no <= 10"""))
def _(spark, sf):
    return boards.brief_lines(a.posts(spark, sf), "zh", clock())


@case("home_board", with_ctes(*a.ALL_POSTS, HOT_RECENT, SOURCES, f"""
ages_fx AS (SELECT date_diff('minute', published_at, TIMESTAMP '{NOW}') AS age FROM posts_fx),
levels_fx AS (SELECT coalesce(source_health, 'good') AS lv FROM sources_fx LEFT JOIN health_fx USING (source_id))""", body="""
(SELECT 'latest' AS section, row_number() OVER (ORDER BY published_at DESC, arrival) AS rank, id AS item, CAST(pulse_score AS BIGINT) AS value FROM enriched_fx ORDER BY rank LIMIT 24)
UNION ALL (SELECT 'pulse', row_number() OVER (ORDER BY pulse_score DESC, arrival) AS rank, id, pulse_score FROM recent_fx ORDER BY rank LIMIT 6)
UNION ALL (SELECT 'spotlight', row_number() OVER (ORDER BY cover IS NOT NULL DESC, pulse_score DESC, arrival) AS rank, id, pulse_score FROM recent_fx ORDER BY rank LIMIT 6)
UNION ALL (SELECT 'tag', row_number() OVER (ORDER BY n DESC, f) AS rank, tag, n FROM (SELECT tag, count(*) AS n, min((arrival, pos)) AS f
  FROM (SELECT arrival, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM recent_fx) GROUP BY tag) ORDER BY rank LIMIT 12)
UNION ALL (SELECT 'lens', r, i, (SELECT count(*) FROM ages_fx WHERE age BETWEEN 0 AND m) FROM (VALUES (1, 'h2', 120), (2, 'h6', 360), (3, 'h24', 1440)) l(r, i, m))
UNION ALL (SELECT 'category', row_number() OVER (ORDER BY category), category, n FROM (SELECT p.category, (SELECT count(*) FROM recent_fx r WHERE r.category = p.category) AS n FROM posts_fx p GROUP BY p.category))
UNION ALL (SELECT 'health', r, i, CASE i WHEN 'stable_ratio' THEN CAST(floor((SELECT count(*) FILTER (lv IN ('excellent', 'good')) * 100.0 / count(*) FROM levels_fx) + 0.5) AS BIGINT) ELSE (SELECT count(*) FROM levels_fx WHERE lv = i) END
  FROM (VALUES (1, 'excellent'), (2, 'good'), (3, 'warn'), (4, 'down'), (5, 'stable_ratio')) h(r, i))
UNION ALL (SELECT 'random', 1, id, pulse_score FROM (SELECT id, pulse_score FROM enriched_fx ORDER BY published_at DESC, arrival LIMIT 200) ORDER BY sha1('7:' || id) LIMIT 1)
UNION ALL (SELECT 'brief', rank, rank || '. ' || coalesce(title_zh, title), NULL FROM (SELECT *, row_number() OVER (ORDER BY published_at DESC, arrival) AS rank FROM recent_fx) WHERE rank <= 10)"""))
def _(spark, sf):
    return home.home_board(a.posts(spark, sf), health.latest_runs(a.history_runs(spark, sf)), a.now(), a.sources(spark, sf), seed=7)


RELATED = f"""
placed_fx AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY published_at DESC, arrival) AS rn FROM posts_fx),
pairs_fx AS (SELECT p.id, c.id AS related_id, c.published_at AS cp, c.rn AS crn,
  round(CASE WHEN p.source_id = c.source_id THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN c.cover IS NOT NULL THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN coalesce(c.summary, '') <> '' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
   + len(list_filter(c.tags, lambda t: list_contains(p.tags, t)))
   + greatest(0.0::DOUBLE, 1.2::DOUBLE - greatest(0.0::DOUBLE, (epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(c.published_at)) / 86400000.0::DOUBLE) / 10), 9) AS score
  FROM placed_fx p JOIN placed_fx c ON p.category = c.category AND p.id <> c.id AND abs(p.rn - c.rn) <= 40)"""


@case("related_posts", with_ctes(POSTS, RELATED, body="""
SELECT id, rank, related_id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, cp DESC, crn) AS rank FROM pairs_fx) WHERE rank <= 6"""))
def _(spark, sf):
    return related.related_posts(a.posts(spark, sf), a.now())


@case("adjacent_posts", with_ctes(POSTS, body="""
SELECT id, category, lag(id) OVER w AS newer_id, lead(id) OVER w AS older_id FROM posts_fx WINDOW w AS (PARTITION BY category ORDER BY published_at DESC, arrival)"""))
def _(spark, sf):
    return related.adjacent_posts(a.posts(spark, sf))
