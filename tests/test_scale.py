"""What has to stay small or spread out when the tables grow."""

import pandas as pd
from pyspark.sql import functions as F

from feedweave.functions import text, urls
from feedweave.operators import page_parse, pages
from feedweave.operators import search as s
from feedweave.session import checkpoint
from feedweave.sources import feeds, search_index
from verification import adapters as a
from verification import cases_feeds, cases_search


def test_whole_texts_are_dealt_to_several_tasks(spark):
    for name in ("documents", "pages"):
        rows = a.table(spark, "/root/testdata/sf0.1", name)
        held = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
        assert sum(n > 0 for n in held) > 1, name


def test_bodies_and_index_are_built_once(spark):
    for stored in (cases_feeds.bodies(spark, "/root/testdata/sf0.001"), cases_search.readers_rows(spark, "/root/testdata/sf0.001")):
        plan = stored._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" not in plan, plan


def test_repair_does_not_normalize_to_see_which_rows_are_there(spark):
    posts = spark.createDataFrame([(i, "Title") for i in "abcd"], "id string, title string")
    for name in (*search_index.TEXTS[1:], "source_id", "source_name", "category"):
        posts = posts.withColumn(name, F.lit(None).cast("string"))
    posts = posts.withColumn("tags", F.array().cast("array<string>")).withColumn("published_at", F.lit(None).cast("timestamp"))
    index = search_index.build_search_index(posts).withColumn("hay", F.expr("case id when 'a' then ' Old \t One ' when 'b' then '​ 　﻿' when 'c' then null else '‍x' end"))
    got = search_index.repair_search_index(index, posts)
    assert {(r.id, r.hay) for r in got.collect()} == {("a", "old one"), ("b", "title"), ("c", "title"), ("d", "x")}
    filters = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert filters and not any("regexp_replace" in line for line in filters)


def test_queries_that_ask_for_the_same_are_one(spark):
    texts = spark.range(2 * s.ASKERS + 5).select(F.col("id").alias("query_id"), F.lit("apple -pear").alias("query"))
    queries = s.parse_query_table(texts.unionByName(spark.createDataFrame([(-1, "apple pie"), (-2, "s:one"), (-3, "s:one -t:x"), (-4, "c:fruit fresh"), (-5, "cat:fruit")], "query_id long, query string")))
    assert s._asked_alike(queries).count() == 3 + 5
    rows = [("i1", "an apple pie", ["x"], "one", "1", "one", "fruit", 0), ("i2", "pear and apple", [], "two", "2", "two", "fruit", 0), ("i3", "", [], "one", "1", "one", "none", 0)]
    index = spark.createDataFrame(rows, "id string, hay string, tags array<string>, source_name string, source_id string, source_id_norm string, category string, published_ms long")
    found = s.search_many(index, queries)
    got = {(r.query_id, r.id) for r in found.collect()}
    assert got == {(q, "i1") for q in range(2 * s.ASKERS + 5)} | {(-1, "i1"), (-2, "i1"), (-2, "i3"), (-3, "i3"), (-5, "i1"), (-5, "i2")}
    assert "Join Inner, (item" not in found._jdf.queryExecution().optimizedPlan().toString()  # no pair goes to its item by a shuffle


def _finds(q, i, now_ms):
    """One parsed query against one item, in plain code."""
    source = lambda w: w in i.source_name or w in i.source_id_norm
    tag = lambda w: any(w in t for t in i.tags)
    fresh = i.published_ms is not None and 0 <= now_ms - i.published_ms < 6 * 3_600_000
    return (
        all(w in i.hay for w in q.text) and not any(w in i.hay for w in q.not_text) and all(map(tag, q.tags)) and not any(map(tag, q.not_tags))
        and all(map(source, q.sources)) and not any(map(source, q.not_sources)) and (not q.categories or i.category in q.categories) and i.category not in q.not_categories
        and (q.after_ms is None or i.published_ms is not None and i.published_ms >= q.after_ms) and (q.before_ms is None or i.published_ms is not None and i.published_ms <= q.before_ms)
        and q.is_read in (None, i.seen) and q.is_unread in (None, not i.seen) and q.is_fresh in (None, fresh)
    )


def test_pairs_are_met_without_their_texts_and_found_as_in_plain_code(spark, monkeypatch):
    day = 86_400_000
    rows = [
        ("i1", "an apple pie with cream", ["x", "hot mail"], "one", "src1", "fruit", 10 * day), ("i2", "pear and apple", ["mail"], "two", "src2", "fruit", 20 * day),
        ("i3", "", [], "one", "src1", "none", 20 * day - 1000), ("i4", "the apple piece", ["x"], "source one", "src11", "news", None), ("i5", "日本語 の apple", ["日本"], "two b", "src2", "", 20 * day + 1000),
        ("i6", "pie", ["hot"], "", "src3", "news", 5 * day), ("i7", "grapple pies an apple", [], "one", "src1", "fruit", 19 * day), ("i8", "an an apple apple", ["x", "xy"], "two", "src12", "none", 20 * day - 7 * 3_600_000),
    ]
    index = spark.createDataFrame(rows, "id string, hay string, tags array<string>, source_name string, source_id_norm string, category string, published_ms long")
    parts = ["apple", "-apple", '"apple pie"', "-'apple pie'", '"an apple"', "pie -cream", "p", "ap -pear", "e", "nothing", "-nothing", "-\"the\"", "日", "\"語 の\"", "'le p'", "\"no pie\"", "t:x", "-t:x", "'t:hot mail'", "-t:none", "t:none",
             "s:src1", "s:one s:src1", "-s:src1", "'s:source one'", "-s:none", "c:fruit", "c:fruit c:news", "-c:news", "c:none -c:none", "c:absent", "is:read", "-is:read", "is:fresh", "-is:fresh", "after:1970-01-15", "before:1970-01-15", "after:1970-01-20 before:1970-01-12", ""]
    texts = [f"{a} {b}".strip() for a in parts for b in parts]
    queries = s.parse_query_table(spark.createDataFrame(list(enumerate(texts)), "query_id long, query string"))
    reads = spark.createDataFrame([("i2",), ("i7",), ("gone",)], "post_id string")
    found = s.search_many(index, queries, reads, F.timestamp_millis(F.lit(20 * day)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" not in plan and "lambda" not in plan and "hay" not in plan, plan  # a pair costs no search in a text
    items = [r for r in s.mark_read(index, reads).withColumnRenamed("is_read", "seen").collect()]
    want = sorted((q.query_id, i.id) for q in queries.collect() for i in items if _finds(q, i, 20 * day))
    assert sorted((r.query_id, r.id) for r in found.collect()) == want and len(want) > len(texts)
    monkeypatch.setattr(s, "FEW", 0)  # many words: hashes of them are broadcast, and the rest is shuffled
    monkeypatch.setattr(s, "BUCKETS", 2)
    monkeypatch.setattr(s, "SLICE", 5000)
    many = s.search_many(index, queries, reads, F.timestamp_millis(F.lit(20 * day)))
    assert sorted((r.query_id, r.id) for r in many.collect()) == want


def test_queries_that_differ_in_what_no_item_has_are_one_and_the_impossible_meet_none(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(s, "checkpoint", lambda df: (kept.append(checkpoint(df)), kept[-1])[1])
    index = spark.createDataFrame([(f"i{n}", "some text", ["x"], "one", "src1", "news", n) for n in range(3)], "id string, hay string, tags array<string>, source_name string, source_id_norm string, category string, published_ms long")
    texts = [f"s:src1 -w{n}" for n in range(50)] + [f"text t:w{n}" for n in range(50)] + [f"text c:w{n}" for n in range(50)] + ["text 'w text'", "text after:1990-01-01"]
    found = s.search_many(index, s.parse_query_table(spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")))
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(q, f"i{n}") for q in range(50) for n in range(3)]
    placed = next(df for df in kept if "place" in df.columns)
    assert [(r.place, len(r.query_ids)) for r in placed.collect()] == [("sone\nsrc1", 50)]


def test_pages_are_parsed_a_few_at_a_time():
    n = 3 * page_parse.PAGES + 1
    pages = pd.DataFrame({"page_id": range(n), "url": "https://a.example/", "html": [f"<p>page {i}" for i in range(n)]})
    parts = list(page_parse.describe_pages(iter([pages]), "page_id", ("text",)))
    assert [len(p) for p in parts] == [page_parse.PAGES] * 3 + [1]
    assert list(pd.concat(parts)["text"]) == [f"page {i}" for i in range(n)]


def test_words_are_made_one_before_they_are_normalized_and_sought_by_few_windows(spark, monkeypatch):
    tokens = spark.createDataFrame([("abcab",), ("日本",), ("",)], "token string")
    assert [r.w for r in tokens.select(s._windows("token").alias("w")).collect()] == [["abc", "bca", "cab", "ab", "b"], ["日本", "本"], None]
    plans = []
    kept = lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString().splitlines()), checkpoint(df))[1]
    monkeypatch.setattr(s, "checkpoint", kept)
    index = spark.createDataFrame([(1, "abcab 日本語 x"), (2, "ab c"), (3, "")], "id long, hay string")
    words = spark.range(1000).selectExpr("explode(array('AB', 'ab', 'B', '本', 'bca', 'ab c', 'cabx', 'x ')) as word")
    assert {tuple(r) for r in s.match_words(index, words).collect()} == {("ab", 1), ("ab", 2), ("b", 1), ("b", 2), ("本", 1), ("bca", 1), ("ab c", 2), ("x", 1)}
    assert any("Aggregate" in line for line in plans[0]) and not any("regexp_replace" in line for line in plans[0])


def test_white_space_is_collapsed_as_its_whole_class_says(spark):
    marks = [chr(n) for n in (*range(0xD800), *range(0xE000, 0x10000), 0x1F600)]
    rows = spark.createDataFrame([(i, f"{m} a{m}{m}b \t{m}c ") for i, m in enumerate(marks)], "i long, t string")
    slow = F.trim(F.regexp_replace("t", f"{text.WS_ODD}{text.WS}*| {text.WS}+", " "))
    assert rows.filter(~text.collapse(F.col("t")).eqNullSafe(slow)).count() == 0
    lower = F.regexp_replace(F.regexp_replace(F.lower("t"), "　", " "), r"[​-‍﻿]", "")
    assert rows.filter(~text.normalize_text(F.col("t")).eqNullSafe(F.trim(F.regexp_replace(lower, f"{text.WS_ODD}{text.WS}*| {text.WS}+", " ")))).count() == 0
    assert str(text.normalize_text(F.col("t"))).count("regexp_replace") == 1  # one pass of a pattern over a whole text


def test_parts_of_an_address_are_made_once(spark):
    made = str(urls.absolute_url(F.col("c"), F.col("a"), F.col("b")))
    assert made.count("regexp_extract") <= 2 * (2 * 5) + 3 * 2 and made.count("aggregate(") <= 4  # two bases: five parts of each and of the address


def test_summaries_of_items_are_cut_once(spark):
    items = spark.createDataFrame([("s", "t", "/a", "2024-01-01", "some text", None)], "source_id string, title string, url string, published_raw string, summary_html string, cover_raw string")
    out = feeds.project_feed_items(items, spark.createDataFrame([("s", "https://a.example/f")], "source_id string, url string"))
    assert [r.summary for r in out.collect()] == ["some text"]
    cut = next(line for line in out._jdf.queryExecution().analyzed().toString().splitlines() if "AS summary#" in line)
    assert cut[: cut.index("AS summary#")].count("rtrim") == 1


def test_a_text_is_lowered_once_for_all_words_sought_in_it(spark):
    assert str(pages._contains_any(F.lower("c"), ("a", "b", "c"))).count("lower(") == 1
    got = spark.createDataFrame([("An A",), ("x",), (None,)], "c string").select(pages._contains_any(F.lower("c"), ("b", "a")).alias("r"))
    assert [r.r for r in got.collect()] == [True, False, None]
