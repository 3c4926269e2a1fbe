"""Streams over the event files, snapshots written and read back, and the translation hook."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedweave import config
from feedweave.operators import translate
from feedweave.plans.sync import StoredRun
from feedweave.session import checkpoint, shared_folder
from feedweave.sources import publish, readers
from feedweave.streaming import jobs
from feedweave.streaming.jobs import read_output
from verification import adapters as a
from verification.adapters import BEFORE, NOW, POSTS, SOURCES, TELEMETRY, with_ctes
from verification.cases_events import CACHED, HOUR, VITALS, chain, entries, SQL as EVENT_SQL
from verification.cases_feeds import RUN_CTES, all_feeds, bodies

QUERIES, SQL = {}, {}


def case(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# The events arrive as one micro-batch a week; the errors of the first week come with the last one, too late to count.
SLICES = 4
SLICE = "least(3, (dayofmonth(at) - 1) div 8)"
ON_TIME = """
slices_fx AS (SELECT * FROM telemetry_fx WHERE NOT (type = 'error' AND day("at") <= 8))"""


def in_slices(spark, df, late):
    """A stream of files that were written one slice after the other."""
    path, parts = scratch(spark, "slices"), 2
    arriving = df.withColumn("_slice", F.expr(f"if({late} and {SLICE} = 0, {SLICES - 1}, {SLICE})"))
    for k in range(SLICES):
        arriving.filter(F.col("_slice") == k).drop("_slice").repartition(parts).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", parts).parquet(f"{path}/*")


@case("throttle_stream", with_ctes(TELEMETRY, ON_TIME, chain("concat_ws('|', type, path, coalesce(lang, ''), device, coalesce(data, ''))", source="slices_fx"), body="SELECT event_id FROM kept_fx"))
def _(spark, sf):
    folder = scratch(spark, "throttle")
    jobs.throttle_stream(in_slices(spark, a.telemetry(spark, sf), "type = 'error'"), ["type", "path", "lang", "device", "data"], folder, HOUR, delay_ms=HOUR)
    return read_output(spark, folder, "kept").select("event_id")


@case("recent_stream", EVENT_SQL["recent_events"])
def _(spark, sf):
    folder = scratch(spark, "recent")
    jobs.recent_stream(in_slices(spark, a.telemetry(spark, sf), "type = 'error'"), ["session"], folder, 20)
    return jobs.recent_lists(spark, folder, ["session"]).select("event_id", "session")


VISITS = f"""
gaps_fx AS (SELECT *, CASE WHEN "at" < lag("at") OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM entries_fx WHERE NOT (kind = 'longtask' AND day("at") <= 8) WINDOW w AS (PARTITION BY session ORDER BY "at", event_id)),
visits_fx AS (SELECT *, session || '/' || sum(fresh) OVER (PARTITION BY session ORDER BY "at", event_id) AS visit FROM gaps_fx),
closed_fx AS (SELECT visit, any_value(session) AS session, min("at") AS session_start FROM visits_fx GROUP BY visit
  HAVING max("at") + INTERVAL 12 HOUR <= (SELECT max("at") FROM telemetry_fx) - INTERVAL 1 HOUR)"""


@case("vitals_stream", with_ctes(TELEMETRY, VITALS, VISITS, chain("visit", "kind = 'longtask'", HOUR, "visits_fx", "tasks_fx"), body="""
SELECT CAST(session AS VARCHAR) AS session, strftime(session_start, '%Y-%m-%d %H:%M:%S') AS session_start, CAST(floor(lcp + 0.5) AS BIGINT) AS lcp_ms, CASE WHEN cls > 0 THEN cls END AS cls,
  CAST(floor(ttfb + 0.5) AS BIGINT) AS ttfb_ms, CAST(floor(inp + 0.5) AS BIGINT) AS inp_ms, nullif(tasks, 0) AS long_task_count, CAST(floor(task_max + 0.5) AS BIGINT) AS long_task_max_ms
FROM closed_fx JOIN (SELECT visit, max(value) FILTER (kind = 'lcp' AND value > 0) AS lcp, floor(sum(value) FILTER (kind = 'shift' AND NOT coalesce(recent_input, false)) * 1000 + 0.5) / 1000 AS cls,
   max(value) FILTER (kind = 'navigation' AND value > 0) AS ttfb, count(*) FILTER (event_id IN (SELECT event_id FROM tasks_fx) AND value > 0) AS tasks, count(*) FILTER (kind <> 'interaction') AS others,
   max(value) FILTER (event_id IN (SELECT event_id FROM tasks_fx) AND value > 0) AS task_max FROM visits_fx GROUP BY visit) USING (visit)
LEFT JOIN (SELECT visit, quantile_disc(d, 0.98) AS inp FROM (SELECT visit, interaction_id, max(value) AS d FROM visits_fx WHERE kind = 'interaction' AND interaction_id <> 0 AND value > 0 GROUP BY visit, interaction_id
  QUALIFY row_number() OVER (PARTITION BY visit ORDER BY min(("at", event_id)) DESC) <= 3) GROUP BY visit) USING (visit)
WHERE others > 0 OR inp IS NOT NULL"""))
def _(spark, sf):
    folder = scratch(spark, "vitals")
    jobs.vitals_stream(in_slices(spark, entries(spark, sf), "kind = 'longtask'"), folder, idle_ms=12 * HOUR, delay_ms=HOUR, sample_gap_ms=HOUR, keep=3)
    return read_output(spark, folder, "vitals").withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))


def ingested(spark, sf):
    """Two runs of the stream: the bodies of the previous snapshot, then those of the run in cases_feeds."""
    sources, out = checkpoint(all_feeds(spark, sf)), scratch(spark, "ingest")
    every = bodies(spark, sf).join(a.posts(spark, sf).select(F.col("arrival").alias("body_no"), "published_at"), "body_no")
    none = sources.select("source_id", F.lit(-1).cast("long").alias("body_no"), F.lit(None).cast("string").alias("body"))
    path = scratch(spark, "fetched")
    for number, (clock, cond) in enumerate(((BEFORE, "published_at < timestamp'{0}'"), (NOW, "published_at >= timestamp'{0}'"))):
        got = every.filter(cond.format(BEFORE)).select(none.columns).unionByName(none)
        status = "200" if number == 0 else "case source_id when 'src3' then 304 when 'src5' then 503 else 200 end"
        got = got.selectExpr("*", f"{status} as http_status", f"{status} <> 503 as fetch_ok", "cast(null as string) as parse_error", "500 as duration_ms", f"timestamp'{clock}' as fetched_at")
        got.repartition(4).write.parquet(f"{path}/{number}")
    stream = spark.readStream.schema(got.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/*")
    jobs.ingest_stream(stream, sources, out, config.Settings(days=25))
    return StoredRun(spark, out, 2)


@case("ingest_stream", with_ctes(*RUN_CTES, body="SELECT id, title, summary, source_id, category, strftime(published_at, '%Y-%m-%d %H:%M') AS \"at\" FROM next_fx"))
def _(spark, sf):
    return ingested(spark, sf).posts().select("id", "title", "summary", "source_id", "category", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("at"))


# The first run starts from nothing, so a source is used unless nothing was parsed.
@case("sync_history", with_ctes(*RUN_CTES, f"""
one_fx AS (SELECT prev_items AS items, (SELECT count(*) FROM projected_fx r WHERE r.source_id = s.source_id AND r.published_at < TIMESTAMP '{BEFORE}') > 0 AS ok FROM dec_fx s),
two_fx AS (SELECT used <> 'fallback' AS ok, CASE WHEN used = 'fetched' THEN (SELECT count(*) FROM now_fx n WHERE n.source_id = d.source_id) ELSE prev_items END AS items,
  CASE WHEN used = 'fetched' THEN (SELECT count(*) FROM now_fx n WHERE n.source_id = d.source_id AND n.id NOT IN (SELECT id FROM old_fx)) ELSE 0 END AS fresh FROM dec_fx d)""", body=f"""
SELECT '{BEFORE}' AS "at", count(*) AS total_sources, count(*) FILTER (ok) AS ok_sources, sum(items)::BIGINT AS total_items, sum(items)::BIGINT AS total_new_items FROM one_fx
UNION ALL SELECT '{NOW}', count(*), count(*) FILTER (ok), sum(items)::BIGINT, sum(fresh)::BIGINT FROM two_fx"""))
def _(spark, sf):
    done = ingested(spark, sf).history()
    return done.select(F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss").alias("at"), "total_sources", "ok_sources", "total_items", "total_new_items")


@case("write_snapshot", with_ctes(POSTS, body="""
SELECT id, title, url, source_id, array_to_string(tags, '|') AS tags, strftime(published_at, '%Y-%m-%d %H:%M') AS "at" FROM posts_fx"""))
def _(spark, sf):
    folder = scratch(spark, "snapshot")
    p = a.posts(spark, sf)
    record = p.select(
        "id", "title", "url", F.col("source_id").alias("sourceId"), "tags", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
        F.to_date("published_at").alias("day"),
    )
    publish.write_snapshot(record, folder, "day")
    back = readers.read_posts(spark, f"{folder}/*")
    return back.select("id", "title", "url", "source_id", F.array_join("tags", "|").alias("tags"), F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("at"))


@case("run_provider", with_ctes(POSTS, SOURCES, CACHED, body="SELECT DISTINCT key, target, target || ': ' || trim(text) AS text FROM work_fx"))
def _(spark, sf):
    empty = spark.createDataFrame([], "key string, text string")
    translate_all = lambda texts, target: [f"{target}: {t}" for t in texts]
    return translate.run_provider(translate.translation_worklist(a.posts(spark, sf), a.sources(spark, sf), empty), translate_all)
