"""Feed bodies (RSS 2.0, Atom, RDF) and listing pages to raw items."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from feedweave.functions import dates, text, urls
from feedweave.functions.html import first, parse, select
from feedweave.operators.page_parse import image_address

MEDIA = "array<struct<_url:string,_href:string,_type:string,_medium:string,_VALUE:string>>"
MEDIA_FIELDS = f"`media:content`:{MEDIA},`media:thumbnail`:{MEDIA}"
ITEM = (
    "array<struct<title:string,link:string,pubDate:string,date:string,`dc:date`:string,description:string,summary:string,"
    f"`content:encoded`:string,enclosure:{MEDIA},{MEDIA_FIELDS}>>"
)
ENTRY = (
    "array<struct<title:string,link:array<struct<_href:string,_rel:string,_type:string,_VALUE:string>>,published:string,"
    f"updated:string,summary:string,content:string,{MEDIA_FIELDS}>>"
)
FEED = f"channel struct<item:{ITEM}>, item {ITEM}, entry {ENTRY}"
# Characters XML forbids, and ampersands that start no entity: both occur in real feeds.
FORBIDDEN = r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]"
LOOSE_AMP = r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)"


def _filled(*cs: Column) -> Column:
    """First text that is not blank."""
    return F.coalesce(*[F.nullif(text.trim_ws(c), F.lit("")) for c in cs])


def _image(nodes: Column) -> Column:
    def address(n: Column) -> Column:
        return _filled(n["_url"], n["_href"], n["_VALUE"])

    def is_image(n: Column) -> Column:
        typed = F.coalesce(F.lower(n["_type"]).startswith("image/"), F.lit(False))
        medium = F.coalesce(F.lower(n["_medium"]) == "image", F.lit(False))
        return address(n).isNotNull() & (typed | medium | urls.is_image_url(address(n)))

    return address(F.try_element_at(F.filter(nodes, is_image), F.lit(1)))


def _item(i: Column, date_order: tuple) -> Column:
    return F.struct(
        _filled(i["title"]).alias("title"), _filled(i["link"]).alias("url"), _filled(*[i[d] for d in date_order]).alias("published_raw"),
        _filled(i["description"], i["summary"], i["content:encoded"]).alias("summary_html"),
        F.coalesce(*[_image(i[n]) for n in ("enclosure", "media:content", "media:thumbnail")]).alias("cover_raw"),
    )


def _entry(e: Column) -> Column:
    alternate = F.try_element_at(F.filter(e["link"], lambda k: k["_rel"] == "alternate"), F.lit(1))
    link = F.coalesce(alternate, F.try_element_at(e["link"], F.lit(1)))
    enclosed = F.try_element_at(F.filter(e["link"], lambda k: k["_rel"] == "enclosure"), F.lit(1))
    image = _filled(enclosed["_href"], enclosed["_VALUE"])
    is_image = F.coalesce(F.lower(enclosed["_type"]).startswith("image/"), F.lit(False)) | urls.is_image_url(image)
    return F.struct(
        _filled(e["title"]).alias("title"), _filled(link["_href"], link["_VALUE"]).alias("url"),
        _filled(e["published"], e["updated"]).alias("published_raw"), _filled(e["summary"], e["content"]).alias("summary_html"),
        F.coalesce(F.when(is_image, image), _image(e["media:content"]), _image(e["media:thumbnail"])).alias("cover_raw"),
    )


def parse_feeds(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Items of each feed body; the first dialect with an item wins; items without title or link are dropped."""
    clean = F.regexp_replace(F.regexp_replace(F.col(body), FORBIDDEN, ""), LOOSE_AMP, "&amp;")
    feed = bodies.withColumn("_f", F.from_xml(clean, FEED, {"attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE"}))
    rss = F.transform("_f.channel.item", lambda i: _item(i, ("pubDate", "date", "dc:date")))
    atom = F.transform("_f.entry", _entry)
    rdf = F.transform("_f.item", lambda i: _item(i, ("dc:date", "date", "pubDate")))
    items = F.when(F.size("_f.channel.item") > 0, rss).when(F.size("_f.entry") > 0, atom).otherwise(rdf)
    kept = [c for c in bodies.columns if c != body]
    out = feed.select(*kept, F.posexplode(items).alias("item_no", "i")).select(*kept, "item_no", "i.*")
    return out.filter(F.col("title").isNotNull() & F.col("url").isNotNull())


TEXT_AND_IMAGE = StructType([StructField("text", StringType()), StructField("image", StringType())])


@F.pandas_udf(TEXT_AND_IMAGE)
def _read_html(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    rows = []
    for h, b in zip(html, base):
        doc = parse(h) if h else None
        rows.append((doc.text(), image_address(first(doc, "img"), b)) if doc else (None, None))
    return pd.DataFrame(rows, columns=["text", "image"], dtype="object")


def project_feed_items(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Dated items with clean title, summary text and absolute cover; undated ones are dropped."""
    base = sources.select("source_id", F.col("url").alias("_source_url"))
    t = items.withColumn("published_at", dates.parse_published(F.col("published_raw"))).filter("published_at is not null")
    t = t.join(base, "source_id", "left").withColumn("url", text.trim_ws(F.col("url")))
    marked = F.when(F.col("summary_html").rlike("[<&]"), F.col("summary_html"))  # plain texts need no parser
    t = t.withColumn("_h", _read_html(marked, F.col("url")))
    plain = F.when(F.col("summary_html").rlike("[<&]"), F.col("_h.text")).otherwise(F.col("summary_html"))
    short = text.bind(text.strip_truncate(plain, 220), lambda s: F.when(s != "", s))
    cover = F.coalesce(urls.absolute_url(F.col("cover_raw"), F.col("url"), F.col("_source_url")), F.col("_h.image"))
    dropped = ("published_raw", "summary_html", "cover_raw", "_source_url", "_h")
    return (
        t.withColumn("title", text.strip_truncate(F.col("title"), 180))
        .withColumn("summary", short).withColumn("cover", cover).drop(*dropped)
    )


@dataclass(frozen=True)
class ListingRule:
    """How to read one site's list page. Selectors are relative to an item."""

    base: str
    item: str
    link: str
    link_pattern: str
    title: str
    time: str = "time[datetime]"
    summary: str = ".summary"
    image: str = "img"


# Registry of list pages by source id.
LISTING_RULES = {
    "animeanime-list": ListingRule(
        base="https://animeanime.jp", item="section.item", link="a.link[href^='/article/']",
        link_pattern=r"/article/\d{4}/\d{2}/\d{2}/\d+\.html", title=".title", image="img.figure",
    ),
}
LISTED = "item_no int, title string, url string, published_raw string, summary string, cover string"


def listed_items(html: str, rule: ListingRule) -> list[tuple]:
    out = []
    for node in select(parse(html), rule.item):
        link, title, time = (first(node, s) for s in (rule.link, rule.title, rule.time))
        href = link.attrs.get("href", "") if link else ""
        if not re.fullmatch(rule.link_pattern, href) or title is None or not title.text().strip():
            continue
        summary, image = first(node, rule.summary), first(node, rule.image)
        src = image.attrs.get("src") if image else None
        out.append((
            title.text(), urls.join_http(rule.base, href), time.attrs.get("datetime", "") if time else "",
            summary.text() if summary else None, urls.join_http(rule.base, src) if src else None,
        ))
    return out


def parse_listing(pages: DataFrame, rules: dict[str, ListingRule] = LISTING_RULES, body: str = "body") -> DataFrame:
    """Items of list pages (source_id, body) by each source's rule; sources without a rule give nothing."""
    kept = [c for c in pages.columns if c != body]
    types = {f.name: f.dataType.simpleString() for f in pages.schema}

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for record in pdf.to_dict("records"):
                rule = rules.get(record["source_id"])
                found = listed_items(record[body], rule) if rule and record[body] else []
                rows += [[record[k] for k in kept] + [n, *item] for n, item in enumerate(found)]
            yield pd.DataFrame(rows, columns=[*kept, "item_no", "title", "url", "published_raw", "summary", "cover"])

    known = pages.filter(F.col("source_id").isin(*rules))
    listed = known.mapInPandas(batches, ", ".join(f"{k} {types[k]}" for k in kept) + ", " + LISTED)
    dated = listed.withColumn("published_at", dates.parse_published(F.col("published_raw"))).drop("published_raw")
    return (
        dated.filter("published_at is not null").withColumn("title", text.strip_truncate(F.col("title"), 180))
        .withColumn("summary", F.nullif(text.strip_truncate(F.col("summary"), 220), F.lit("")))
    )
