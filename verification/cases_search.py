"""Search rows, search, saved queries, readers of published documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedweave.functions.dates import HOUR_MS
from feedweave.operators import search as s
from feedweave.session import checkpoint
from feedweave.sources import readers, search_index
from verification import adapters as a
from verification.adapters import NOW, POSTS, RUNS, TELEMETRY, with_ctes
from verification.cases_merge import enriched

QUERIES, SQL = {}, {}


def case(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[\x{{200b}}-\x{{200d}}\x{{feff}}]', '', 'g'), '[ \t\r\n\f\v\x{{a0}}\x{{3000}}]+', ' ', 'g'))"
INDEX = f"""
index_fx AS (SELECT id, arrival, published_at, source_id, lower(source_name) AS source_name, lower(source_id) AS source_id_norm, lower(category) AS category, tags, epoch_ms(published_at) AS published_ms,
  {NORM.format("concat_ws(' ', title, coalesce(title_zh, ''), coalesce(title_ja, ''), coalesce(summary, ''), '', '', coalesce(preview, ''), '', '', array_to_string(tags, ' '), source_name, source_id, category)")} AS hay FROM posts_fx)"""
# The rows that readers search: the whole index for one who is not known, and each reader's bookmarks.
READS = a.user_items_sql("reads_fx", "view") + "," + a.user_items_sql("marks_fx", "click") + """,
rows_fx AS (SELECT r.*, s.post_id IS NOT NULL AS is_read FROM (SELECT CAST(NULL AS BIGINT) AS user_id, * FROM index_fx UNION ALL SELECT m.user_id, i.* FROM marks_fx m JOIN index_fx i ON i.id = m.post_id) r
  LEFT JOIN reads_fx s ON s.user_id = r.user_id AND s.post_id = r.id)"""


def index(spark, sf):
    return search_index.build_search_index(a.posts(spark, sf))


def stored_index(spark, sf):
    """The stored search table: built once, on all cores, however often and with what filter it is read."""
    return checkpoint(index(spark, sf))


def reads(spark, sf):
    """What each user viewed."""
    return a.user_items(spark, sf, "view")


def readers_rows(spark, sf):
    i = stored_index(spark, sf)
    marked = a.user_items(spark, sf, "click").withColumnRenamed("post_id", "id").join(i, "id")
    return i.withColumn("user_id", F.lit(None).cast("long")).unionByName(marked)


@case("build_search_index", with_ctes(POSTS, INDEX, body="SELECT id, hay, array_to_string(tags, '|') AS tags, source_name, source_id_norm, category, published_ms FROM index_fx"))
def _(spark, sf):
    return index(spark, sf).select("id", "hay", F.array_join("tags", "|").alias("tags"), "source_name", "source_id_norm", "category", "published_ms")


@case("slim_search_posts", with_ctes(POSTS, body="""
SELECT id, title, title_zh, title_ja, coalesce(summary, preview) AS summary, url, cover, category, source_id, array_to_string(tags, '|') AS tags FROM posts_fx"""))
def _(spark, sf):
    slim = search_index.slim_search_posts(a.posts(spark, sf))
    return slim.select("id", "title", "title_zh", "title_ja", "summary", "url", "cover", "category", "source_id", F.array_join("tags", "|").alias("tags"))


@case("repair_search_index", with_ctes(POSTS, INDEX, body="SELECT id, hay, array_to_string(tags, '|') AS tags FROM index_fx"))
def _(spark, sf):
    stored = stored_index(spark, sf).withColumn("hay", F.concat(F.lit("  "), F.replace("hay", F.lit(" "), F.lit(" \t ")), F.lit(" ")))
    return search_index.repair_search_index(stored, a.posts(spark, sf)).select("id", "hay", F.array_join("tags", "|").alias("tags"))


SPEC = s.SearchSpec(text=("the",), not_text=("http",), not_tags=("mail",), sources=("src1",), not_sources=("src15",), categories=("en", "fr", "es"),
                    not_categories=("es",), after_ms=1_704_412_800_000, before_ms=1_706_400_000_000, is_unread=True)
FOUND = """
found_fx AS (SELECT * FROM rows_fx WHERE contains(hay, 'the') AND NOT contains(hay, 'http')
  AND len(list_filter(tags, lambda t: contains(t, 'mail'))) = 0 AND (contains(source_name, 'src1') OR contains(source_id_norm, 'src1'))
  AND NOT contains(source_id_norm, 'src15') AND category IN ('en', 'fr', 'es') AND category <> 'es'
  AND published_ms >= 1704412800000 AND published_ms <= 1706400000000 AND NOT is_read AND source_id <> 'src12'
  AND (contains(hay, 'and') OR contains(hay, 'ing')) AND NOT contains(hay, 'zzz'))"""


def found(spark, sf):
    p = a.posts(spark, sf)
    state = s.ReaderState(reads=reads(spark, sf), disabled_sources=p.filter("source_id = 'src12'").select("source_id"),
                          follow_words=("and", "ing"), block_words=("zzz",), only_followed=True, hide_read=True)
    return s.search(readers_rows(spark, sf), SPEC, state, a.now())


@case("search", with_ctes(POSTS, INDEX, READS, FOUND, body="SELECT user_id, id, is_read FROM found_fx"))
def _(spark, sf):
    return found(spark, sf).select("user_id", "id", "is_read")


@case("search_limit", with_ctes(POSTS, INDEX, body="""
SELECT id, row_number() OVER (ORDER BY published_ms DESC, id) AS place FROM index_fx WHERE contains(hay, 'a') QUALIFY place <= 300"""))
def _(spark, sf):
    top = s.search_limit(s.search(index(spark, sf), s.SearchSpec(text=("a",))), 300)
    return top.select("id", F.row_number().over(Window.orderBy(F.col("published_ms").desc(), "id")).alias("place"))  # 300 rows


@case("search_totals", with_ctes(POSTS, INDEX, READS, body="""
SELECT user_id, count(*) AS items, count(*) FILTER (contains(hay, 'the')) AS matched,
  count(*) FILTER (contains(hay, 'the') AND NOT is_read) AS unread, count(*) FILTER (contains(hay, 'the')) > 300 AS truncated FROM rows_fx GROUP BY user_id"""))
def _(spark, sf):
    return s.search_totals(s.mark_read(readers_rows(spark, sf), reads(spark, sf)), s.matches(s.SearchSpec(text=("the",))), 300, by=("user_id",))


@case("mark_read", with_ctes(POSTS, INDEX, READS, body="SELECT user_id, id, is_read FROM rows_fx"))
def _(spark, sf):
    return s.mark_read(readers_rows(spark, sf), reads(spark, sf)).select("user_id", "id", "is_read")


@case("match_sources", with_ctes(POSTS, INDEX, a.USER_SOURCES, body="""
SELECT id FROM index_fx WHERE source_id IN (SELECT source_id FROM user_sources_fx WHERE user_id < 4) AND source_id NOT IN (SELECT source_id FROM user_sources_fx WHERE user_id = 5)"""))
def _(spark, sf):
    u = a.user_sources(spark, sf)
    state = s.ReaderState(followed_sources=u.filter("user_id < 4"), disabled_sources=u.filter("user_id = 5"), only_followed_sources=True)
    return s.match_sources(index(spark, sf), state).select("id")


# Words that readers follow: every event's type and number.
@case("match_words", with_ctes(POSTS, INDEX, r"""
words_fx AS (SELECT event_type AS word FROM events UNION SELECT json_extract_string(props, '$.k') FROM events)""",
  body="SELECT word, id FROM words_fx JOIN index_fx ON contains(hay, word)"))
def _(spark, sf):
    e = a.table(spark, sf, "events")
    words = e.selectExpr("explode(array(event_type, get_json_object(props, '$.k'))) as word")
    stored = checkpoint(index(spark, sf).select("id", "hay"))  # stands for the stored search table
    return s.match_words(stored, words)


@case("search_facets", with_ctes(POSTS, INDEX, READS, body="""
SELECT user_id, category, shown, unread, is_total = 0 AND shown = max(CASE WHEN is_total = 0 THEN shown END) OVER (PARTITION BY user_id) AS is_peak FROM (
SELECT user_id, category, grouping(category) AS is_total, count(*) AS shown, count(*) FILTER (NOT is_read) AS unread FROM rows_fx WHERE contains(hay, 'a') GROUP BY GROUPING SETS ((user_id, category), (user_id)))"""))
def _(spark, sf):
    got = s.search(readers_rows(spark, sf), s.SearchSpec(text=("a",)), s.ReaderState(reads=reads(spark, sf)))
    return s.search_facets(got, by=("user_id",))


PAGE = f"""
page_fx AS (SELECT *, epoch_ms(published_at) AS published_ms, {NORM.format("concat_ws(' ', title, coalesce(summary, preview, ''), array_to_string(tags, ' '), source_name)")} AS hay FROM enriched_fx),
shown_fx AS (SELECT * FROM page_fx WHERE contains(hay, 'a') AND epoch_ms(TIMESTAMP '2024-01-30 12:00:00') - published_ms <= 24 * 3600000 AND source_health IN ('excellent', 'good', 'warn'))"""


@case("page_filter", with_ctes(*a.ALL_POSTS, PAGE, body="""
SELECT id, pulse_score FROM page_fx WHERE contains(hay, 'a') AND epoch_ms(TIMESTAMP '2024-01-30 12:00:00') - published_ms <= 24 * 3600000 AND source_health IN ('excellent', 'good')
QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY pulse_score DESC, arrival) = 1"""))
def _(spark, sf):
    clock = F.lit("2024-01-30 12:00:00").cast("timestamp")
    filters = s.PageFilters(lens_hours=24, only_stable=True, dedup=True, sort="pulse")
    return s.page_filter(enriched(spark, sf), s.SearchSpec(text=("a",)), filters, clock).select("id", "pulse_score")


@case("dedup_leaders", with_ctes(*a.ALL_POSTS, body="""
SELECT id, dedup_key, pulse_score FROM enriched_fx QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY pulse_score DESC, arrival) = 1"""))
def _(spark, sf):
    return s.dedup_leaders(enriched(spark, sf)).select("id", "dedup_key", "pulse_score")


QUERY_SQL = """CASE doc_id % 6
 WHEN 0 THEN 'tag:"' || w || '" -source:' || source || ' ' || w || ' after:2024-01-05'
 WHEN 1 THEN 'http://' || source || ' -t:mail c:动画 -cat:' || lang || ' is:unread'
 WHEN 2 THEN '"' || w || ' two" -is:read since:2024-01-02 until:bad before:2024-01-20 is:fresh'
 WHEN 3 THEN 's:' || upper(source) || ' -"' || w || '" is:read is:new'
 WHEN 4 THEN '  - tag: -is:fresh ' || chr(39) || w || ' x' || chr(39) || ' after:2024-01-03 after:2024-01-04'
 ELSE w || ' ' || lang || ' category:グッズ' END"""
QWORD = r"regexp_extract(text, '([A-Za-z]{3,12})', 1)"
PARSED = f"""
queries_fx AS (SELECT doc_id AS query_id, {QUERY_SQL} AS query FROM (SELECT *, {QWORD} AS w FROM documents)),""" + r"""
tokens_fx AS (SELECT query_id, list_transform(regexp_extract_all(trim(query), '"[^"]+"|''[^'']+''|[^ ]+'), lambda t: trim(CASE WHEN regexp_matches(t, '^("[^"]+"|''[^'']+'')$') THEN substring(t, 2, length(t) - 2) ELSE t END)) AS ts FROM queries_fx),
flat_fx AS (SELECT query_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS n FROM tokens_fx),
body_fx AS (SELECT query_id, n, starts_with(t, '-') AS neg, trim(CASE WHEN starts_with(t, '-') THEN substring(t, 2) ELSE t END) AS b FROM flat_fx),
split_fx AS (SELECT query_id, n, neg, CASE WHEN contains(b, ':') THEN lower(split_part(b, ':', 1)) ELSE '' END AS k, CASE WHEN contains(b, ':') THEN regexp_replace(b, '^[^:]*:', '') ELSE b END AS raw FROM body_fx),
part_fx AS (SELECT *, trim(lower(raw)) AS v0, CASE WHEN k IN ('tag', 't') THEN 'tags' WHEN k IN ('source', 's') THEN 'sources' WHEN k IN ('cat', 'c', 'category') THEN 'categories'
  WHEN k IN ('after', 'since') THEN 'after' WHEN k IN ('before', 'until') THEN 'before' WHEN k = 'is' THEN 'flag' ELSE 'text' END AS kind FROM split_fx WHERE trim(lower(raw)) <> ''),
value_fx AS (SELECT *, CASE WHEN kind = 'categories' THEN CASE v0 WHEN '动画' THEN 'anime' WHEN 'グッズ' THEN 'goods' ELSE v0 END ELSE v0 END AS v FROM part_fx),
flags_fx AS (SELECT query_id, last(v ORDER BY n) FILTER (kind = 'flag' AND v IN ('read', 'unread', 'new')) AS seen, last(neg ORDER BY n) FILTER (kind = 'flag' AND v IN ('read', 'unread', 'new')) AS seen_neg,
  last(neg ORDER BY n) FILTER (kind = 'flag' AND v = 'fresh') AS fresh_neg,
  last(epoch_ms(CAST(TRY_CAST(raw AS DATE) AS TIMESTAMP)) ORDER BY n) FILTER (kind = 'after' AND TRY_CAST(raw AS DATE) IS NOT NULL) AS after_ms,
  last(epoch_ms(CAST(TRY_CAST(raw AS DATE) AS TIMESTAMP)) ORDER BY n) FILTER (kind = 'before' AND TRY_CAST(raw AS DATE) IS NOT NULL) AS before_ms,
""" + ",\n".join(
    f"coalesce(string_agg(v, '|' ORDER BY n) FILTER (kind = '{k}' AND {'neg' if neg else 'NOT neg'}), '') AS {'not_' if neg else ''}{k}"
    for k in ("text", "tags", "sources", "categories") for neg in (False, True)) + """
FROM value_fx GROUP BY query_id)"""


def query_table(spark, sf):
    # Of a text only its first word is dealt out.
    d = a.stored(spark, sf, "documents").select("doc_id", "source", "lang", F.regexp_extract("text", "([A-Za-z]{3,12})", 1).alias("w"))
    return d.repartition("doc_id").select(F.col("doc_id").alias("query_id"), F.expr(QUERY_SQL).alias("query"))


@case("parse_query_table", with_ctes(PARSED, body="""
SELECT query_id, text, not_text, tags, not_tags, sources, not_sources, categories, not_categories, after_ms, before_ms,
  CASE WHEN seen = 'read' THEN NOT seen_neg WHEN seen_neg THEN true END AS is_read,
  CASE WHEN seen = 'read' THEN CASE WHEN seen_neg THEN true END ELSE NOT seen_neg END AS is_unread, NOT fresh_neg AS is_fresh FROM flags_fx"""))
def _(spark, sf):
    parsed = s.parse_query_table(query_table(spark, sf))
    lists = [p + k for k in ("text", "tags", "sources", "categories") for p in ("", "not_")]
    return parsed.select("query_id", *[F.array_join(c, "|").alias(c) for c in lists], "after_ms", "before_ms", "is_read", "is_unread", "is_fresh")


def _of(name: str) -> str:
    return f"list_filter(string_split({name}, '|'), lambda w: w <> '')"


def _some(name: str, test: str) -> str:
    return f"len(list_filter({_of(name)}, lambda w: {test})) > 0"


IN_TAGS, IN_SOURCE = "len(list_filter(i.tags, lambda t: contains(t, w))) > 0", "(contains(source_name, w) OR contains(source_id_norm, w))"


@case("search_many", with_ctes(POSTS, INDEX, PARSED, body=f"""
SELECT query_id, id FROM (SELECT *, CASE WHEN seen = 'read' THEN NOT seen_neg WHEN seen_neg THEN true END AS is_read,
  CASE WHEN seen = 'read' THEN CASE WHEN seen_neg THEN true END ELSE NOT seen_neg END AS is_unread, NOT fresh_neg AS is_fresh FROM flags_fx) q
  JOIN (SELECT *, epoch_ms(TIMESTAMP '{NOW}') - published_ms BETWEEN 0 AND 6 * 3600000 - 1 AS fresh FROM index_fx) i
  ON NOT {_some("q.text", "NOT contains(hay, w)")} AND NOT {_some("q.not_text", "contains(hay, w)")} AND NOT {_some("q.tags", "NOT (" + IN_TAGS + ")")} AND NOT {_some("q.not_tags", IN_TAGS)}
  AND NOT {_some("q.sources", "NOT " + IN_SOURCE)} AND NOT {_some("q.not_sources", IN_SOURCE)} AND (q.categories = '' OR {_some("q.categories", "w = i.category")}) AND NOT {_some("q.not_categories", "w = i.category")}
  AND (after_ms IS NULL OR published_ms >= after_ms) AND (before_ms IS NULL OR published_ms <= before_ms)
  AND coalesce(NOT is_read, true) AND coalesce(is_unread, true) AND coalesce(is_fresh = fresh, true)"""))
def _(spark, sf):
    return s.search_many(index(spark, sf), s.parse_query_table(query_table(spark, sf)), now=a.now())


@case("empty_result_suggestions", with_ctes(POSTS, body="""
SELECT ord, preset, lens, sort FROM (SELECT 1 AS ord, 'is:unread' AS preset, CAST(NULL AS VARCHAR) AS lens, CAST(NULL AS VARCHAR) AS sort
UNION ALL SELECT * FROM (SELECT 2, 'cat:' || category, NULL, NULL FROM posts_fx GROUP BY category ORDER BY count(*) DESC, list_position(['es', 'de', 'fr', 'en'], category) LIMIT 1)
UNION ALL SELECT * FROM (SELECT 3, 'tag:' || token, NULL, NULL FROM (SELECT arrival, unnest(tags) AS token, generate_subscripts(tags, 1) AS pos FROM posts_fx) GROUP BY token ORDER BY count(*) DESC, length(token) DESC, min((arrival, pos)) LIMIT 1)
UNION ALL SELECT * FROM (SELECT 4, 'source:' || lower(source_name), NULL, NULL FROM posts_fx GROUP BY lower(source_name) ORDER BY count(*) DESC, length(lower(source_name)) DESC, min(arrival) LIMIT 1)
UNION ALL SELECT 5, 'after:2024-01-30', '24h', 'pulse') ORDER BY ord LIMIT 5"""))
def _(spark, sf):
    return s.empty_result_suggestions(s.SearchSpec(text=("nothing",)), a.posts(spark, sf), ("es", "de", "fr", "en"), a.now())


@case("search_events", with_ctes(TELEMETRY, body="""
SELECT event_id FROM telemetry_fx WHERE contains(lower(concat_ws(chr(10), type, path, coalesce(lang, ''), device, data)), lower('"K": 4'))"""))
def _(spark, sf):
    return s.search_events(a.telemetry(spark, sf), '"K": 4').select("event_id")


@case("resolve_bookmarks", with_ctes(POSTS, a.user_items_sql("marks_fx", "click"), body="""
SELECT id, title, title IS NOT NULL AS found FROM (SELECT DISTINCT post_id AS id FROM marks_fx) LEFT JOIN (SELECT id, title FROM posts_fx WHERE published_at >= TIMESTAMP '2024-01-10') USING (id)"""))
def _(spark, sf):
    visible = a.posts(spark, sf).filter("published_at >= timestamp'2024-01-10'")
    return s.resolve_bookmarks(a.user_items(spark, sf, "click"), visible).select("id", "title", "found")


@case("merge_bookmarks", with_ctes(a.user_items_sql("marks_fx", "click"), a.user_items_sql("reads_fx", "view"), body="""
SELECT user_id, post_id, (user_id, post_id) NOT IN (SELECT (user_id, post_id) FROM marks_fx) AS added FROM (SELECT * FROM marks_fx UNION SELECT * FROM reads_fx)"""))
def _(spark, sf):
    docs = a.user_items(spark, sf, "view")
    even = F.col("user_id") % 2 == 0
    docs = docs.select("user_id", F.when(even, F.to_json(F.array("post_id"))).otherwise(F.to_json(F.struct(F.array("post_id").alias("ids")))).alias("json"))
    return readers.merge_bookmarks(a.user_items(spark, sf, "click"), readers.parse_bookmarks(docs))


@case("read_posts", with_ctes(POSTS, body="""
SELECT id, title, CASE WHEN arrival % 4 = 1 THEN 'anime' ELSE 'goods' END AS category, CASE WHEN arrival % 5 = 1 THEN NULL ELSE strftime(published_at, '%Y-%m-%d %H:%M') END AS "at",
  array_to_string(tags, '|') AS tags FROM posts_fx WHERE category <> 'de' OR len(tags) > 0"""))
def _(spark, sf):
    doc = F.struct(
        F.when((F.col("category") != "de") | (F.size("tags") > 0), F.col("id")).alias("id"), "title", F.col("arrival").alias("summary"),
        F.when(F.col("arrival") % 5 == 1, F.lit("soon")).otherwise(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("publishedAt"),
        F.when(F.col("arrival") % 4 == 1, F.lit("sports")).otherwise(F.lit("goods")).alias("category"), "tags",
    )
    out = readers.parse_posts(a.posts(spark, sf).select(F.to_json(doc).alias("json")))
    return out.select("id", "title", "category", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("at"), F.array_join("tags", "|").alias("tags"))


@case("read_source_runs", with_ctes(RUNS, body="""
SELECT strftime(run_ts, '%Y-%m-%d') AS day, source_id, ok, item_count, CASE WHEN used = 'cached' THEN NULL ELSE used END AS used, http_status FROM runs_fx"""))
def _(spark, sf):
    r = a.runs(spark, sf)
    item = F.struct(
        F.col("source_id").alias("id"), "ok", F.col("item_count").alias("itemCount"), F.col("http_status").alias("httpStatus"),
        F.when(F.col("used") == "cached", F.lit("odd")).otherwise(F.col("used")).alias("used"),
    )
    # a status document is one run: one row per configured source
    docs = r.groupBy("run_ts").agg(F.collect_list(item).alias("sources"))
    docs = docs.select(F.to_json(F.struct(F.date_format("run_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generatedAt"), "sources")).alias("json"))
    out = readers.parse_source_runs(docs)
    return out.select(F.date_format("run_ts", "yyyy-MM-dd").alias("day"), "source_id", "ok", "item_count", "used", "http_status")


@case("read_run_history", with_ctes(RUNS, body="""
SELECT strftime(run_ts, '%Y-%m-%d') AS generated_at, CAST(sum(item_count) AS DOUBLE) AS total_items FROM runs_fx GROUP BY run_ts HAVING count(*) FILTER (NOT ok) % 3 <> 0"""))
def _(spark, sf):
    g = a.runs(spark, sf).groupBy("run_ts").agg(F.sum("item_count").alias("items"), F.count_if(~F.col("ok")).alias("err"))
    zeros = [F.lit(0).alias(n) for n in readers.HISTORY_NUMBERS if n not in ("totalItems", "errSources")]
    entry = F.struct(F.date_format("run_ts", "yyyy-MM-dd").alias("generatedAt"), F.col("items").alias("totalItems"),
                     F.when(F.col("err") % 3 != 0, F.col("err")).alias("errSources"), *zeros)
    docs = g.select(F.to_json(F.struct(F.lit(1).alias("v"), F.array(entry).alias("entries"))).alias("json"))
    return readers.parse_run_history(docs).select("generated_at", "total_items")


@case("read_telemetry", with_ctes(TELEMETRY, body="""
SELECT type, strftime("at", '%Y-%m-%dT%H:%M:%S') AS "at", path, lang, replace(data, ' ', '') AS data FROM telemetry_fx WHERE lang IS NOT NULL AND type <> 'error'"""))
def _(spark, sf):
    t = a.telemetry(spark, sf)
    event = F.struct(
        F.when(F.col("type") != "error", F.col("type")).alias("type"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), "path", "lang",
        F.from_json("data", "k int").alias("data"),
    )
    version = F.when(F.col("lang").isNull(), F.lit(2)).otherwise(F.lit(1)).alias("version")
    docs = t.select(F.to_json(F.struct(version, F.array(event).alias("events"))).alias("json"))
    return readers.parse_telemetry(docs).select("type", "at", "path", "lang", "data")


@case("read_saved_views", with_ctes(POSTS, body="""
SELECT id, source_id AS name, arrival AS created_at, CASE WHEN source_id < 'src3' THEN '2h · latest' WHEN length(trim(title || ' ' || title)) > 72 THEN substring(trim(title || ' ' || title), 1, 72) || '…' ELSE trim(title || ' ' || title) END AS hint
FROM posts_fx WHERE arrival > 0 AND (source_id < 'src3' OR trim(title) <> '') AND cover IS NULL"""))
def _(spark, sf):
    q = F.when(F.col("source_id") < "src3", F.lit("  ")).otherwise(F.concat_ws(" ", "title", "title"))
    snap = F.struct(q.alias("q"), F.struct(F.lit("2h").alias("timeLens"), F.lit("odd").alias("sortMode")).alias("filters"))
    preset = F.struct(F.when(F.col("cover").isNotNull(), F.lit(2)).otherwise(F.lit(1)).alias("version"), "id", F.col("source_id").alias("name"), F.col("arrival").alias("createdAt"), snap.alias("snapshot"))
    docs = a.posts(spark, sf).select(F.to_json(F.struct(F.lit(1).alias("version"), F.array(preset).alias("presets"))).alias("json"))
    return readers.parse_saved_views(docs)
