"""Published forms of the item tables: snapshots, RSS, JSON Feed, OPML, sitemap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave import config
from feedweave.functions import dates, text


def write_snapshot(df: DataFrame, path: str, partition_by: str | None = None, fmt: str = "json") -> None:
    """One record per line, gzip for JSON; written in parallel, partitioned when asked."""
    out = df.write.mode("overwrite")
    if fmt == "json":
        out = out.option("compression", "gzip").option("ignoreNullFields", "true")
    (out.partitionBy(partition_by) if partition_by else out).format(fmt).save(path)


def newest(posts: DataFrame, n: int) -> DataFrame:
    """The n newest items; undated ones count as the oldest."""
    return posts.orderBy(F.coalesce(F.unix_millis("published_at"), F.lit(0)).desc(), "arrival").limit(n)


def item_url(base: str, lang: str) -> Column:
    return F.concat(F.lit(f"{base.rstrip('/')}/{lang}/p/"), "id", F.lit("/"))


def _preview(lang: str) -> Column:
    return text.trim_ws(F.coalesce(text.pick_localized("feed", lang), F.lit("")))


# Fixed label before the link to the original article.
ORIGINAL_LABEL = {"zh": "原文", "ja": "元記事"}


def rss_items(posts: DataFrame, lang: str, base: str, n: int = 120) -> DataFrame:
    """One RSS <item> per row for the newest n items."""
    top = newest(posts, n)
    when = F.coalesce(F.date_format("published_at", "yyyy/M/d HH:mm:ss"), F.lit(""))
    body = _preview(lang)
    desc = F.when(body != "", body).otherwise(F.concat("source_name", F.lit(" · "), when))
    desc = F.concat(desc, F.lit(f"\n\n{ORIGINAL_LABEL[lang]}："), "url")
    url = text.escape_xml(item_url(base, lang))
    date = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    lines = F.concat_ws(
        "\n",
        F.lit("<item>"),
        F.concat(F.lit("<title>"), text.escape_xml(text.pick_localized("title", lang)), F.lit("</title>")),
        F.concat(F.lit("<link>"), url, F.lit("</link>")),
        F.concat(F.lit('<guid isPermaLink="true">'), url, F.lit("</guid>")),
        F.when(date.isNotNull(), F.concat(F.lit("<pubDate>"), date, F.lit("</pubDate>"))),
        F.concat(F.lit("<description><![CDATA["), F.replace(desc, F.lit("]]>"), F.lit("]]&gt;")), F.lit("]]></description>")),
        F.lit("</item>"),
    )
    return top.select("id", F.unix_millis("published_at").alias("published_ms"), "arrival", lines.alias("xml"))


def ttl_minutes(minutes: float | None) -> int:
    return 60 if minutes is None or minutes != minutes or minutes in (float("inf"), float("-inf")) else max(5, int(minutes // 1))


def rss_document(items: DataFrame, title: str, site_url: str, feed_url: str, description: str, language: str, ttl: float | None = 60) -> DataFrame:
    """The whole feed as one text row (its items are already limited)."""
    esc = lambda s: text.escape_xml(F.lit(s))
    rows = F.sort_array(F.collect_list(F.struct((-F.coalesce("published_ms", F.lit(0))).alias("t"), "arrival", "xml")))
    head = F.concat_ws(
        "\n",
        F.lit('<?xml version="1.0" encoding="UTF-8"?>'),
        F.lit('<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom">'),
        F.lit("<channel>"),
        F.concat(F.lit("<title>"), esc(title), F.lit("</title>")),
        F.concat(F.lit("<link>"), esc(site_url), F.lit("</link>")),
        F.concat(F.lit('<atom:link href="'), esc(feed_url), F.lit('" rel="self" type="application/rss+xml" />')),
        F.concat(F.lit("<description>"), esc(description), F.lit("</description>")),
        F.concat(F.lit("<language>"), esc(language), F.lit("</language>")),
        F.lit(f"<ttl>{ttl_minutes(ttl)}</ttl>"),
    )
    body = F.array_join(F.transform(rows, lambda r: r["xml"]), "\n")
    return items.agg(body.alias("body")).select(
        F.concat_ws("\n", head, F.when(F.col("body") != "", F.col("body")), F.lit("</channel>\n</rss>")).alias("value")
    )


def json_feed_items(posts: DataFrame, lang: str, base: str, n: int = 120) -> DataFrame:
    """One JSON Feed item per row for the newest n items."""
    body = _preview(lang)
    url = item_url(base, lang)
    item = F.to_json(
        F.struct(
            url.alias("id"), url.alias("url"), F.col("url").alias("external_url"),
            text.pick_localized("title", lang).alias("title"),
            F.when(body != "", body).otherwise(F.col("source_name")).alias("content_text"),
            dates.to_iso(F.col("published_at")).alias("date_published"),
            F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 10).alias("tags"),
            F.col("cover").alias("image"),
        )
    )
    return newest(posts, n).select("id", F.unix_millis("published_at").alias("published_ms"), "arrival", item.alias("json"))


def opml_outlines(sources: DataFrame, lang: str, categories: tuple = config.CATEGORIES, labels: dict | None = None) -> DataFrame:
    """One <outline> per source: (section, name, xml) in section order; order by section, name to print."""
    labels = config.CATEGORY_LABELS[lang] if labels is None else labels
    pairs = [F.lit(x) for c in categories for x in (c, labels.get(c, c))]
    label = F.try_element_at(F.create_map(*pairs), F.col("category"))
    section = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category"))
    feed = F.col("kind") == "feed"

    def attr(name: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f'{name}="'), text.escape_xml(value), F.lit('"')))

    attrs = F.concat_ws(
        " ", attr("text", F.col("name")), attr("title", F.col("name")),
        attr("type", F.when(feed, F.lit("rss")).otherwise(F.lit("link"))),
        attr("xmlUrl", F.when(feed, F.col("url"))), attr("htmlUrl", F.coalesce("homepage", "url")), attr("category", label),
    )
    return sources.filter(section > 0).select(
        section.alias("section"), label.alias("section_label"), "name", F.concat(F.lit("<outline "), attrs, F.lit(" />")).alias("xml")
    )


def sitemap_entries(posts: DataFrame, categories: tuple, langs: tuple, base: str, run_at: Column, n: int = 5000) -> DataFrame:
    """(loc, lastmod, ord): fixed pages first, then the newest n items in every language; first location wins."""
    pages = ["/"] + [f"/{lg}/{p}" for lg in langs for p in ("", "status/", "about/", "bookmarks/", *[f"c/{c}/" for c in categories])]
    root = base.rstrip("/")
    spark = posts.sparkSession
    run = dates.to_iso(run_at)
    fixed = spark.createDataFrame([(root + p, i) for i, p in enumerate(pages)], "loc string, i bigint")
    fixed = fixed.select("loc", run.alias("lastmod"), F.struct(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("t"), F.col("i").alias("a"), F.lit(0).alias("l")).alias("ord"))
    top = newest(posts, n).select("id", "published_at", "arrival")
    both = top.select("*", F.posexplode(F.array(*[F.lit(lg) for lg in langs])).alias("l", "lang"))
    items = both.select(
        F.concat(F.lit(root + "/"), "lang", F.lit("/p/"), "id", F.lit("/")).alias("loc"),
        F.coalesce(dates.to_iso(F.col("published_at")), run).alias("lastmod"),
        F.struct(F.lit(1).alias("part"), (-F.coalesce(F.unix_millis("published_at"), F.lit(0))).alias("t"), F.col("arrival").cast("bigint").alias("a"), "l").alias("ord"),
    )
    first = F.min_by(F.struct("lastmod", "ord"), "ord").alias("m")
    return fixed.unionByName(items).groupBy("loc").agg(first).select("loc", "m.lastmod", "m.ord")
