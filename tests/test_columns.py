"""Literal expectations of the column functions."""

import datetime
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from feedweave import config
from feedweave.functions import dates, privacy, scores, text, urls


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("title,key", [
    ("【新作】Foo Bar!", "foo-bar"), ("  『特報』 テスト123 ", "テスト123"), ("新作 特報", "新作-特報"), ("", ""), ("!!!", ""),
    ("a b c d e f g h i j k l m n", "a-b-c-d-e-f-g-h-i-j-k-l"), ("新作新作 x", "新作新作-x"),
])
def test_dedup_key(spark, title, key):
    assert one(spark, text.dedup_key(F.lit(title))) == key


def test_read_minutes(spark):
    assert one(spark, text.read_minutes(F.lit("hello"))) == 1
    assert one(spark, text.read_minutes(F.lit(""))) == 1
    assert one(spark, text.read_minutes(F.lit("word " * 800))) == 4
    assert one(spark, text.read_minutes(F.lit("漢" * 421))) == 2
    assert one(spark, text.read_minutes(F.lit("word " * 100000))) == 20


@pytest.mark.parametrize("raw,out", [
    ("", None), ("javascript:alert(1)", None), ("data:text/plain,hi", None), ("not a url", None),
    ("https://example.com/a?utm_source=abc&x=1#frag", "https://example.com/a?x=1"),
    ("https://example.com/a?fbclid=123&utm_medium=social", "https://example.com/a"),
    (" HTTP://Example.COM ", "http://example.com/"), ("https://e.com:443/a?UTM_X=1&b=2&GCLID=3", "https://e.com/a?b=2"),
])
def test_normalize_url(spark, raw, out):
    assert one(spark, urls.normalize_url(F.lit(raw))) == out


def test_strip_truncate(spark):
    assert one(spark, text.strip_truncate(F.lit("  hello   world \n ok "), 12)) == "hello world…"
    assert one(spark, text.strip_truncate(F.lit("a　  b"), 12)) == "a b"


def test_normalize_text_and_collapse(spark):
    assert one(spark, text.normalize_text(F.lit(" Ab​　\tC  d﻿ "))) == "ab c d"


@pytest.mark.parametrize("title,category,tags", [
    ("PV trailer", "anime", ["PV/预告"]), ("日本PV公開", "anime", ["PV/预告", "定档/上映"]), ("nothing", "game", ["游戏"]),
    ("nothing", "goods", ["周边"]), ("nothing", "seiyuu", ["声优"]), ("nothing", "anime", ["资讯"]), ("SPVX", "anime", ["资讯"]),
])
def test_derive_tags(spark, title, category, tags):
    assert one(spark, text.derive_tags(F.lit(title), F.lit(None).cast("string"), F.lit(category))) == tags


@pytest.mark.parametrize("raw,iso", [
    ("2026-01-13T00:00:00.000Z", "2026-01-13T00:00:00.000Z"), ("Mon, 13 Jan 2026 00:00:00 GMT", "2026-01-13T00:00:00.000Z"),
    ("Mon, 15 Dec 2025 12:34:56 +0900", "2025-12-15T03:34:56.000Z"), ("2026-01-13", "2026-01-13T00:00:00.000Z"),
    ("invalid-date", None), ("", None), ("12:30:00", None), ("Dec 5, 2025", "2025-12-05T00:00:00.000Z"),
])
def test_parse_published(spark, raw, iso):
    assert one(spark, dates.to_iso(dates.parse_published(F.lit(raw)))) == iso


def test_pulse_score_orders_by_health(spark):
    now = F.lit(datetime.datetime(2026, 1, 2)).cast("timestamp")
    at = F.lit(datetime.datetime(2026, 1, 1, 18)).cast("timestamp")

    def score(health, when=at):
        return one(spark, scores.pulse_score(when, F.array(F.lit("a")), F.lit(""), F.lit("x"), F.lit(""), F.lit(health).cast("string"), now))

    assert [score(h) for h in ("excellent", "good", "warn", "down", None)] == [87, 83, 79, 71, 79]
    assert score(None, F.lit(None).cast("timestamp")) == 3
    assert score(None, F.lit(datetime.datetime(2026, 1, 5)).cast("timestamp")) == 103


@pytest.mark.parametrize("row,level", [
    ((True, "fetched", 0, 800), "excellent"), ((False, "fetched", 0, 500), "down"), ((True, "fallback", 0, 10), "warn"), ((True, "fetched", 2, 10), "warn"),
    ((True, "fetched", 1, 10), "good"), ((True, "cached", 0, 10), "good"), ((True, "fetched", None, 1201), "good"), ((None, "fetched", 0, 1), "down"),
])
def test_health_level(spark, row, level):
    ok, used, fails, ms = row
    assert one(spark, scores.health_level(F.lit(ok).cast("boolean"), F.lit(used), F.lit(fails).cast("int"), F.lit(ms))) == level


def test_redaction(spark):
    assert one(spark, privacy.redact_text(F.lit("  hello   world \n ok "))) == "hello world ok"
    assert one(spark, privacy.redact_text(F.lit("fetch https://example.com/a?token=secret#x failed"))) == "fetch https://example.com/a failed"
    assert one(spark, privacy.redact_text(F.lit("see https://example.com?x=1, (http://b.c/d#e)"))) == "see https://example.com/ (http://b.c/d)"
    assert one(spark, privacy.redact_text(F.lit("x" * 500), 20)) == "x" * 19 + "…"
    stack = "Error: boom\n    at https://example.com/a?token=secret#x:1:2\n    at https://example.com/b?utm_source=abc:3:4"
    assert one(spark, privacy.redact_stack(F.lit(stack))) == "Error: boom\n    at https://example.com/a\n    at https://example.com/b"
    key = privacy.error_key(F.lit("error"), F.lit("boom"), F.lit("Error: boom\n    at foo:1:2"))
    assert one(spark, key) == "error:boom:Error: boom"


def test_sanitize_payload(spark):
    import json

    raw = {
        "url": "https://example.com/a?token=secret#x", "href": "/zh/?q=1#x", "token": "secret", "long": "y" * 400, "none": None,
        "nested": {"ok": True, "secret": "x", "arr": ["https://e.com/x?y=1#z", 2]}, "a": {"b": {"c": {"d": {"e": 1}}}}, "many": list(range(60)),
    }
    whole = json.loads(one(spark, privacy.sanitize_payload(F.lit(json.dumps(raw)))))
    assert whole["a"] == raw["a"] and whole["many"] == raw["many"] and whole["long"] == raw["long"] and whole["token"] == "[redacted]"
    limits = privacy.PayloadLimits(depth=4, keys=48, items=48, text=360)
    out = json.loads(one(spark, privacy.sanitize_payload(F.lit(json.dumps(raw)), limits)))
    assert out["url"] == "https://example.com/a" and out["href"] == "/zh/" and out["token"] == "[redacted]"
    assert out["nested"] == {"ok": True, "secret": "[redacted]", "arr": ["https://e.com/x", 2]}
    assert out["a"]["b"]["c"]["d"] == "[max_depth]" and len(out["many"]) == 48 and len(out["long"]) == 360 and out["none"] is None
    for bad in ("[1]", "nope", "{}", None):
        assert one(spark, privacy.sanitize_payload(F.lit(bad).cast("string"))) is None


@pytest.mark.parametrize("raw,out", [
    ("https://en.wikipedia.org/wiki/A_(b)", "https://en.wikipedia.org/wiki/A_(b)"), ("https://a.b/c).", "https://a.b/c"),
    ("https://a.b/c）】。", "https://a.b/c"), ("https://a.b/（c）", "https://a.b/（c）"), ("https://a.b/c(d))", "https://a.b/c(d)"), ("", ""),
])
def test_trim_url_punct(spark, raw, out):
    assert one(spark, urls.trim_url_punct(F.lit(raw))) == out


def test_encoded_punct_and_compare_key(spark):
    assert one(spark, urls.strip_encoded_punct(F.lit("https://a.b/c%29%EF%BC%89"))) == "https://a.b/c"
    assert one(spark, urls.strip_encoded_punct(F.lit("https://a.b/%28c%29"))) == "https://a.b/%28c%29"
    assert one(spark, urls.url_compare_key(F.lit("https://www.a.b/c//?x=1#y"))) == "a.b/c/"
    assert one(spark, urls.url_compare_key(F.lit("relative/path)"))) == "relative/path"


def test_resolve_cover(spark):
    assert one(spark, urls.resolve_cover(F.lit("").cast("string"))) is None
    assert one(spark, urls.resolve_cover(F.lit("/covers/a.webp"))).src == "/covers/a.webp"
    http = one(spark, urls.resolve_cover(F.lit("http://example.com/a b(c)~.jpg?x=1&y='"), 320))
    assert http.src == "https://images.weserv.nl/?url=http%3A%2F%2Fexample.com%2Fa%20b(c)~.jpg%3Fx%3D1%26y%3D'&w=320&fit=cover&n=-1"
    assert one(spark, urls.resolve_cover(F.lit("https://example.com/a.jpg"))).src == "https://example.com/a.jpg"
    assert one(spark, urls.resolve_cover(F.lit("https://www.animenewsnetwork.com/x.jpg"))) is None


def test_settings_clamp():
    s = config.Settings.from_mapping({"days": "7", "drop_ratio": "2", "history_max": "-1", "enrich_max": "x", "stale_hours": "12.9"})
    assert (s.days, s.drop_ratio, s.history_max, s.enrich_max, s.stale_hours) == (7, 0.15, 0, 0, 12)


def test_absolute_url_equals_urljoin(spark):
    """10,000 pairs of addresses and references, put together from parts."""
    rnd = random.Random(3)
    part = lambda: rnd.choice(["a", "b c", "..", ".", "", "x.y", "ü", "c;d=1", "~e"])
    path = lambda: "/".join(part() for _ in range(rnd.randint(0, 5)))
    tail = lambda: rnd.choice(["", "", "?q=1&r=/..", "#f", "?#", "?a#b?c"])
    base = lambda: rnd.choice(["http", "https", "HTTPS"]) + "://" + rnd.choice(["h.example", "H.example:80", "u@h"]) + rnd.choice(["", "/" + path()]) + tail()
    ref = lambda: rnd.choice([path, path, lambda: "/" + path(), lambda: "//o.example/" + path(), base, lambda: "mailto:x", lambda: "ftp://f/" + path(), lambda: "data:image/gif,x", lambda: " "])() + tail()
    rows = []
    while len(rows) < 10_000:
        b, r = base(), ref()
        if not r.startswith("///"):  # an empty host
            rows.append((len(rows), b, r))

    def plain(b, r):
        r = r.strip()
        for url in ([] if not r or r.startswith("data:") else [r, urljoin(b, r)]):
            scheme, sep, rest = url.partition("://")
            if sep and scheme.lower() in ("http", "https") and rest:
                return url if any(c in rest for c in "/?#") else url + "/"
        return None

    got = {r.i: r.u for r in spark.createDataFrame(rows, "i int, b string, r string").select("i", urls.absolute_url(F.col("r"), F.col("b")).alias("u")).collect()}
    wrong = [(b, r, got[i], plain(b, r)) for i, b, r in rows if got[i] != plain(b, r)]
    assert not wrong, wrong[:5]
