"""Feed dialects, list pages, published forms and snapshot round trip on hand-written bodies."""

import datetime
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from feedweave import config
from feedweave.plans import sync as sy
from feedweave.sources import dimension, feeds, publish, readers

RSS = """<?xml version="1.0"?>
<rss version="2.0"><channel><title>Railway notes</title><item><guid>n7</guid><description>Two new sleepers.</description>
<pubDate>Sun, 11 Jan 2026 18:30:00 +0100</pubDate><link>
  https://trains.example/notes/7 </link><enclosure url="https://trains.example/img/7.jpg" length="9" type="image/jpeg"/>
<title>Night trains north &amp; south</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Harbour lab</title><entry><id>urn:x</id><title type="html">Tidal atom clock</title>
<link rel="self" href="https://harbour.example/self"/><link href="https://harbour.example/clock" rel="alternate"/>
<link rel="enclosure" type="image/webp" href="https://harbour.example/clock.webp"/>
<published>2026-01-09T06:00:00Z</published><updated>2026-01-11T17:30:00Z</updated><summary>Keeps time by the moon.</summary></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Bees</title></channel>
<item><dc:date>2026-01-11T17:30:00+00:00</dc:date><link>https://bees.example/swarm</link><title>Swarm season</title>
<content:encoded><![CDATA[<div><p>First <b>swarm</b> seen.</p><img data-src="/pics/s.png"></div>]]></content:encoded></item></rdf:RDF>"""

SOURCES = [
    {"id": "a", "name": "Zed", "kind": "feed", "url": "https://example.com/feed", "homepage": "https://example.com/", "category": "anime", "lang": "en"},
    {"id": "b", "name": "Beta <&>", "kind": "feed", "url": "https://b.example/feed", "category": "game", "include": {"pattern": "atom", "flags": "i"}},
    {"id": "c", "name": "Gamma", "kind": "feed", "url": "https://c.example/feed", "category": "game", "include": {"pattern": "(", "flags": ""}},
    {"id": "animeanime-list", "name": "List", "kind": "html", "url": "https://animeanime.jp/", "category": "goods"},
]


@pytest.fixture(scope="module")
def sources(spark):
    return dimension.load_sources(spark, SOURCES)


def bodies(spark, rows):
    return spark.createDataFrame(rows, "source_id string, body_no int, body string")


def test_three_dialects(spark, sources):
    damaged = ["<broken", None, "", "<rss><channel><item><title>cut off", "<html><body>no feed</body></html>", RSS[: len(RSS) // 2], "\ufeff" + ATOM.replace("</entry>", "")]
    items = feeds.parse_feeds(bodies(spark, [("a", 0, RSS), ("b", 1, ATOM), ("c", 2, RDF), *(("a", 3 + i, d) for i, d in enumerate(damaged[:6]))]))
    got = {r.title: r for r in feeds.project_feed_items(items, sources).collect()}
    assert set(got) == {"Night trains north & south", "Tidal atom clock", "Swarm season"}
    rss, atom, rdf = got["Night trains north & south"], got["Tidal atom clock"], got["Swarm season"]
    assert (rss.url, rss.cover, rss.summary) == ("https://trains.example/notes/7", "https://trains.example/img/7.jpg", "Two new sleepers.")
    assert rss.published_at == rdf.published_at == datetime.datetime(2026, 1, 11, 17, 30)
    assert (atom.url, atom.cover, atom.summary) == ("https://harbour.example/clock", "https://harbour.example/clock.webp", "Keeps time by the moon.")
    assert rdf.summary == "First swarm seen."
    assert rdf.cover.endswith("/pics/s.png")


def test_source_ids_are_unique(spark):
    with pytest.raises(ValueError):
        dimension.load_sources(spark, SOURCES[:1] * 2)


def test_listing(spark):
    html = """<section class="item"><a class="link" href="/article/2026/01/02/7.html">x</a><h2 class="title"> A  title </h2>
      <time datetime="2026-01-02T03:04:05+09:00">t</time><p class="summary">Sum</p><img class="figure" src="/f.jpg"></section>
      <section class="item"><a class="link" href="/article/x">x</a><h2 class="title">bad link</h2><time datetime="2026-01-02"></time></section>
      <section class="item"><a class="link" href="/article/2026/01/02/8.html">x</a><h2 class="title">no date</h2></section>"""
    out = feeds.parse_listing(bodies(spark, [("animeanime-list", 0, html), ("other", 1, html)])).collect()
    assert [(r.title, r.url, r.cover, r.summary, r.published_at) for r in out] == [
        ("A title", "https://animeanime.jp/article/2026/01/02/7.html", "https://animeanime.jp/f.jpg", "Sum", datetime.datetime(2026, 1, 1, 18, 4, 5))
    ]


def test_run_ladder_and_streak(spark, sources):
    now = F.lit(datetime.datetime(2026, 1, 14)).cast("timestamp")
    first = bodies(spark, [("a", 0, RSS), ("b", 0, ATOM), ("c", 0, RDF)])
    fetched = [("a", 200, True, None, 10), ("b", 200, True, None, 10), ("c", 200, True, None, 10)]
    schema = "source_id string, http_status int, fetch_ok boolean, parse_error string, duration_ms int"
    nothing = spark.createDataFrame([], ", ".join(f"{c} string" for c in sy.POST_COLUMNS if c not in ("published_at", "tags", "arrival")) + ", published_at timestamp, tags array<string>, arrival struct<body_no:bigint,item_no:bigint>")
    no_runs = spark.createDataFrame([], "source_id string, ok boolean, consecutive_fails int")
    one = sy.sync(first, spark.createDataFrame(fetched, schema), sources, nothing, no_runs, None, now)
    assert {r.source_id for r in one.posts.collect()} == {"a", "b", "c"}
    assert {(r.source_id, r.used, r.new_item_count, r.visible_items) for r in one.runs.collect()} == {(s, "fetched", 1, 1) for s in "abc"}
    later = [("a", 304, True, None, 5), ("b", 503, False, None, 5), ("c", 200, True, None, 5)]
    two = sy.sync(bodies(spark, [("c", 1, "<rss/>")]), spark.createDataFrame(later, schema), sources, one.posts, one.runs, one.history, F.lit(datetime.datetime(2026, 1, 15)).cast("timestamp"))
    assert {(r.source_id, r.used, r.ok, r.error, r.consecutive_fails, r.item_count) for r in two.runs.collect()} == {
        ("a", "cached", True, None, 0, 1), ("b", "fallback", False, "fetch_error", 1, 1), ("c", "fallback", False, "parse_empty", 1, 1),
    }
    assert two.posts.count() == 3 and two.history.count() == 2


def test_snapshot_round_trip(spark):
    rows = [("x1", "T1", "https://e.com/1", "2026-01-01T00:00:00.000Z", "anime", ["a", "b"]), ("x2", "T2", "https://e.com/2", "never", "goods", [])]
    df = spark.createDataFrame(rows, "id string, title string, url string, publishedAt string, category string, tags array<string>")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    publish.write_snapshot(df, f"{folder}/a", "category")
    publish.write_snapshot(df, f"{folder}/b")
    back = {r.id: r for r in readers.read_posts(spark, f"{folder}/b").collect()}
    assert back["x1"].tags == ["a", "b"] and back["x2"].published_at is None and back["x2"].category == "goods"
    assert {r.id for r in readers.read_posts(spark, f"{folder}/a/*").collect()} == {"x1", "x2"}
    with open(f"{folder}/array.json", "w") as f:
        json.dump([{"id": 5}, {"id": "ok", "category": "zzz", "tags": ["t", 1]}, "no", {"id": ""}], f)
    arr = readers.read_posts(spark, f"{folder}/array.json", "array").collect()
    assert [(r.id, r.category, r.tags, r.title) for r in arr] == [("ok", "anime", ["t"], "")]
    with open(f"{folder}/bad.json", "w") as f:
        f.write("{not json")
    assert readers.read_posts(spark, f"{folder}/bad.json", "array").count() == 0
    assert readers.read_run_history(spark, f"{folder}/bad.json").count() == 0


def test_rss_document(spark):
    cols = ", ".join(f"{c} string" for c in ("id", "title", "title_zh", "title_ja", "summary", "summary_zh", "summary_ja", "preview", "preview_zh", "preview_ja", "url", "source_name"))
    rows = [("1", "A & <B>", None, None, "x ]]> y", None, None, None, None, None, "https://e.com/1", "S", datetime.datetime(2026, 1, 2), 0),
            ("2", "C", "译", None, None, None, None, None, None, None, "https://e.com/2", "S", None, 1)]
    posts = spark.createDataFrame(rows, cols + ", published_at timestamp, arrival int")
    doc = publish.rss_document(publish.rss_items(posts, "zh", "https://site"), "T", "https://site/zh/", "https://site/zh/feed.xml", "D", "zh-Hans", 2).first()["value"]
    assert "<ttl>5</ttl>" in doc and "<title>A &amp; &lt;B&gt;</title>" in doc and "x ]]&gt; y" in doc
    assert "<pubDate>Fri, 02 Jan 2026 00:00:00 GMT</pubDate>" in doc and doc.count("<pubDate>") == 1
    assert doc.index("/p/1/") < doc.index("/p/2/") and "<title>译</title>" in doc
    assert publish.ttl_minutes(None) == 60 and publish.ttl_minutes(7.9) == 7


def test_opml(spark, sources):
    rows = publish.opml_outlines(sources, "zh").orderBy("section", "name").collect()
    assert [(r.section, r.name) for r in rows] == [(1, "Zed"), (2, "Beta <&>"), (2, "Gamma"), (3, "List")]
    assert rows[0].xml == '<outline text="Zed" title="Zed" type="rss" xmlUrl="https://example.com/feed" htmlUrl="https://example.com/" category="动画" />'
    assert "Beta &lt;&amp;&gt;" in rows[1].xml and 'type="link"' in rows[3].xml and "xmlUrl" not in rows[3].xml


def test_image_addresses_and_settings(spark, sources):
    kept = dimension.include_filter(
        spark.createDataFrame([("a", "x", None), ("b", "An ATOM", None), ("b", "none", None), ("c", "x", None)], "source_id string, title string, summary string"), sources
    )
    assert sorted((r.source_id, r.title) for r in kept.collect()) == [("a", "x"), ("b", "An ATOM"), ("c", "x")]
    assert config.Settings().snapshot_limit == 0
