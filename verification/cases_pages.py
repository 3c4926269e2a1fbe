"""Page operators over the pages table, and feed documents built from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweave.operators import pages as pg
from verification import adapters as a
from verification.adapters import POSTS, with_ctes

QUERIES, SQL = {}, {}


def case(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def pages(spark, sf):
    return a.table(spark, sf, "pages")


UNESCAPE = r"""replace(replace(regexp_replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '&quot;', '"'), '&quot', '"')"""
# The article of every page is a heading and paragraphs; `<p>` starts each paragraph.
ARTICLE = r"""
art_fx AS (SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS art FROM pages),
para_fx AS (SELECT page_id, url, n - 1 AS n, raw FROM (SELECT page_id, url, unnest(string_split(art, '<p>')) AS raw, generate_subscripts(string_split(art, '<p>'), 1) AS n FROM art_fx)),
p_fx AS (SELECT page_id, url, n, raw, """ + UNESCAPE.format("regexp_replace(raw, '<[^>]*>', '', 'g')") + r""" AS t FROM para_fx),
s_fx AS (SELECT page_id, url, n, raw LIKE '<b>%' AS bold, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM p_fx)"""

JUNK = "(length({0}) < 20 OR " + " OR ".join(f"contains(lower({{0}}), '{w}')" for w in pg.JUNK_WORDS) + ")"


@case("html_to_text", r"""
SELECT page_id, """ + UNESCAPE.format(r"""replace(regexp_replace(regexp_replace(replace(html, 't="</p>"', 't="\x01"'), '<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'), '\x01', '</p>')""").replace(r"'t=\"\x01\"'", "'t=\"' || chr(1) || '\"'") + " AS text FROM pages")
def _(spark, sf):
    return pg.html_to_text(pages(spark, sf))


SQL["html_to_text"] = "SELECT page_id, " + UNESCAPE.format(
    "replace(regexp_replace(regexp_replace(replace(html, '=\"</p>\"', '=\"' || chr(1) || '\"'), '<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'), chr(1), '</p>')"
) + " AS text FROM pages"

# Pages carry no images; the media below are put in front of every article.
MEDIA = (
    "concat('<img data-src=\"/pics/', page_id, '.png?x=1\"><img src=\"/logo.png\">"
    "<picture><img srcset=\"a.jpg 1x, b.jpg 2x\"></picture>')"
)
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"


@case("first_image", f"SELECT page_id, {ORIGIN} || '/pics/' || page_id || '.png?x=1' AS first_image FROM pages")
def _(spark, sf):
    p = pages(spark, sf).withColumn("html", F.expr(f"replace(html, '<article>', concat('<article>', {MEDIA}))"))
    return pg.first_image(p)


@case("extract_cover", f"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {ORIGIN} || '/og/' || page_id WHEN page_id % 3 = 1 THEN 'https://cdn.example.com/ld.jpg' ELSE {ORIGIN} || '/pics/' || page_id || '.png?x=1' END AS page_cover FROM pages""")
def _(spark, sf):
    head = """case page_id % 3 when 0 then concat('<meta property="og:image" content="/favicon.ico"><meta name="twitter:image" content="/og/', page_id, '">')
      when 1 then '<script type="application/ld+json">{"@graph":[{"image":["https://cdn.example.com/icons/x.png",{"url":"https://cdn.example.com/ld.jpg"}]}]}</script>' else '' end"""
    p = pages(spark, sf).withColumn("html", F.expr(f"replace(replace(html, '<article>', concat('<article>', {MEDIA})), '<style>', concat({head}, '<style>'))"))
    return pg.extract_cover(p)


PREVIEW = r"""
good_fx AS (SELECT page_id, list(t ORDER BY n) AS ts FROM (SELECT * FROM s_fx WHERE n > 0 AND NOT """ + JUNK.format("t") + r""" QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n) <= 6) GROUP BY page_id),
built_fx AS (SELECT page_id, list_reduce(list_prepend('', ts), lambda x, y: CASE WHEN length(x) >= 302 THEN x
   WHEN length(CASE WHEN x = '' THEN y ELSE x || ' ' || y END) >= 420 THEN rtrim(substring(CASE WHEN x = '' THEN y ELSE x || ' ' || y END, 1, 419)) || '…'
   ELSE CASE WHEN x = '' THEN y ELSE x || ' ' || y END END) AS b FROM good_fx)"""


@case("extract_preview", with_ctes(ARTICLE, PREVIEW, body=f"""
SELECT page_id, CASE WHEN b <> '' AND NOT {JUNK.format("b")} THEN b END AS page_preview FROM pages LEFT JOIN built_fx USING (page_id)"""))
def _(spark, sf):
    return pg.extract_preview(pages(spark, sf))


MD = r"""
md_fx AS (SELECT page_id, n, CASE WHEN n = 0 THEN 'heading' ELSE 'paragraph' END AS kind,
  CASE WHEN n = 0 THEN '# ' || trim(""" + UNESCAPE.format("regexp_replace(raw, '<[^>]*>', '', 'g')") + r""") WHEN bold THEN '**' || trim(t) || '**' ELSE trim(t) END AS md
  FROM (SELECT page_id, n, raw, raw LIKE '<b>%' AS bold, t FROM p_fx)),
blocks_fx AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos FROM md_fx WHERE md NOT IN ('', '# ', '#', '****'))"""


@case("block_table", with_ctes(ARTICLE, MD, body="SELECT page_id, pos, kind, md FROM blocks_fx"))
def _(spark, sf):
    return pg.block_table(pg.main_content(pages(spark, sf))).select("page_id", "pos", "kind", "md")


@case("page_to_markdown", with_ctes(ARTICLE, MD, body="SELECT page_id, string_agg(md, chr(10) || chr(10) ORDER BY pos) AS md FROM blocks_fx GROUP BY page_id"))
def _(spark, sf):
    return pg.page_to_markdown(pg.main_content(pages(spark, sf))).select("page_id", "md")


MAIN = r"""
main_fx AS (SELECT page_id, length(trim(regexp_replace(string_agg(t, '' ORDER BY n), '\s+', ' ', 'g'))) AS text_len, count(*) FILTER (n > 0) AS p FROM p_fx GROUP BY page_id)"""


@case("main_content", with_ctes(ARTICLE, MAIN, body="""
SELECT page_id, text_len, p, 1 AS h, round(text_len + p * 180 + 80 - CASE WHEN text_len < 260 THEN 260 - text_len ELSE 0 END, 3)::DOUBLE AS score FROM main_fx"""))
def _(spark, sf):
    return pg.main_content(pages(spark, sf)).select("page_id", "text_len", "p", "h", "score")


@case("page_kind", with_ctes(ARTICLE, MD, body="""
SELECT page_id, count(*) FILTER (kind = 'paragraph') AS p, count(*) FILTER (kind = 'paragraph' AND length(t) >= 90) AS long_p, CAST(sum(length(t)) AS BIGINT) AS chars, 'article' AS kind
FROM (SELECT page_id, n, kind FROM blocks_fx) JOIN s_fx USING (page_id, n) GROUP BY page_id"""))
def _(spark, sf):
    return pg.page_kind(pg.main_content(pages(spark, sf))).select("page_id", "p", "long_p", "chars", "kind")


# Link paragraphs and a tag list are put into every article.
EXTRA = (
    "concat('<p><a href=\"https://a.example/', page_id, '\">Read more</a></p><p>Source: <a href=\"/x\">x</a></p>', "
    "'<p>https://b.example/', page_id, ' 。</p><p><a href=\"https://youtu.be/v', page_id, '\">clip</a></p>', "
    "'<ul><li><a href=\"/1\">one</a> and some more words here</li><li>kept entry of the list</li><li><a href=\"/2\">two</a></li></ul>')"
)


@case("prune_blocks", with_ctes(ARTICLE, MD, r"""
more_fx AS (SELECT page_id, -2 AS n, 'paragraph' AS kind, '[clip](https://youtu.be/v' || page_id || ')' AS md FROM pages
  UNION ALL SELECT page_id, -1, 'list', '- [one](' || regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/1) and some more words here' || chr(10) || '- kept entry of the list' FROM pages
  UNION ALL SELECT page_id, n, kind, md FROM blocks_fx)""", body="SELECT page_id, string_agg(md, chr(10) || chr(10) ORDER BY n) AS md FROM more_fx GROUP BY page_id"))
def _(spark, sf):
    p = pages(spark, sf).withColumn("html", F.expr(f"replace(html, '<article>', concat('<article>', {EXTRA}))"))
    return pg.page_to_markdown(pg.prune_blocks(pg.main_content(p))).select("page_id", "md")


@case("clean_page", with_ctes(ARTICLE, MD, body=r"""
SELECT page_id, '![](' || regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/pics/' || page_id || '.png)' || chr(10) || chr(10) || '[Watch video (YouTube)](https://www.youtube.com/watch?v=id' || page_id || ')' || chr(10) || chr(10) || md AS md
FROM (SELECT page_id, string_agg(md, chr(10) || chr(10) ORDER BY n) AS md FROM blocks_fx GROUP BY page_id) JOIN pages USING (page_id)"""))
def _(spark, sf):
    dirt = (
        "concat('<img src=\"/pics/', page_id, '.png\"><img src=\"/t.png\" width=\"1\"><img src=\"https://x.doubleclick.net/a.png\">', "
        "'<div class=\"share x\"><p>Share this page with everybody</p></div>"
        "<iframe data-src=\"https://www.youtube.com/embed/id', page_id, '?rel=0\"></iframe><iframe src=\"https://ads.example/\"></iframe>"
        "<div><a href=\"/a\">aaa</a><a href=\"/b\">bbb</a><a href=\"/c\">ccc</a><a href=\"/d\">ddd</a></div>')"
    )
    p = pages(spark, sf).withColumn("html", F.expr(f"replace(html, '<article>', concat('<article>', {dirt}))"))
    return pg.page_to_markdown(pg.main_content(p)).select("page_id", "md")


# Texts with every kind of damage, made from the documents; `w` is a word of the text.
DAMAGED = r"""
dmg_fx AS (SELECT doc_id, CASE WHEN length(compact) > 200 THEN substring(compact, 1, 200) ELSE compact END AS b FROM docs_fx)"""


@case("normalize_markdown", with_ctes(POSTS, r"""
b_fx AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^A-Za-z ]+', ' ', 'g'), ' +', ' ', 'g')) AS b FROM documents)""", body=r"""
SELECT doc_id, '## Head' || chr(10) || CASE WHEN b = '' THEN '' ELSE b END || chr(10) || chr(10) || '[t](https://a.example/xy) [c](https://b.example/p)' || chr(10) || 'https://c.example/news/today end' || CASE WHEN b = '' THEN '' ELSE chr(10) || b END AS md FROM b_fx WHERE b <> ''"""))
def _(spark, sf):
    b = F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z ]+", " "), " +", " "))
    d = a.table(spark, sf, "documents").select("doc_id", b.alias("b")).filter("b <> ''")
    md = F.concat(
        F.lit("* ## Head\r\n"), "b", F.lit("\n\n\n\n【t】(https://a.example/xy) [[c](https://b.example/p)]]\nhttps://c.example/ne\nws/today end@@ X TOKEN 12 @@\n"), "b",
        F.lit("\n- 12\n )\n![p](https://x.doubleclick.net/i.gif)\n[more](https://d.example/)\n|\nwww.e.example\n"),
    )
    return d.select("doc_id", pg.normalize_markdown(md).alias("md"))


# What a text looks like, line by line: the features that the rules on lists and menus ask for.
def shape_sql(source: str, key: str) -> str:
    """CTE shape_fx(key, md, url, n, listed, times, dates, paras) of a CTE with key, md and url."""
    trimmed = r"regexp_replace(s, '^[ \t\r\n\f\v\x{a0}\x{3000}]+|[ \t\r\n\f\v\x{a0}\x{3000}]+$', '', 'g')"
    is_list = r"(regexp_matches(s, '^[*-]\s*\S') OR regexp_matches(s, '^\d+\.\s*\S'))"
    times = r"regexp_matches(s, '^[*-]?\s*\d{1,2}:\d{2}([^0-9A-Za-z_]|$)')"
    dates = rf"(regexp_matches(s, '^[*-]?\s*\d{{1,2}}\s*月\s*\d{{1,2}}\s*日[0-9A-Za-z_]') OR regexp_matches(s, '^[*-]?\s*({pg.MONTHS})([^0-9A-Za-z_]|$)', 'i'))"
    paras = rf"(NOT {is_list} AND NOT regexp_matches(s, '^#{{2,6}}\s') AND length(s) >= 80)"
    count = lambda f: f"len(list_filter(lines, lambda s: {f}))"
    return f"""
lines_fx AS (SELECT {key}, md, url, list_filter(list_transform(regexp_split_to_array(md, '\\r?\\n'), lambda s: {trimmed}), lambda s: s <> '') AS lines FROM {source}),
shape_fx AS (SELECT {key}, md, url, lines, len(lines) AS n, {count(is_list)} AS listed, {count(times)} AS times, {count(dates)} AS dates, {count(paras)} AS paras FROM lines_fx)""".replace("\\\\", "\\")


def any_of(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


INDEX_SQL = f"""({any_of("lower(md)", pg.ARCHIVE_PHRASES)} OR (n >= 18 AND ((listed > 0.62::DOUBLE * n AND (times >= 8 OR dates >= 8) AND paras <= 4) OR (listed > 0.75::DOUBLE * n AND paras <= 8))))"""


# Spanish texts are written as dated lists, a sentence a line, and French ones as plain lists with a title; the others are taken as they are.
@case("looks_like_index", with_ctes(r"""
md_fx AS (SELECT doc_id, '' AS url, CASE lang WHEN 'es' THEN '- 10:30 ' || replace(text, '. ', '.' || chr(10) || '- 10:30 ') WHEN 'fr' THEN '# Time' || chr(10) || replace(text, '. ', chr(10) || '* ') ELSE text END AS md FROM documents)""",
  shape_sql("md_fx", "doc_id"), body=f"SELECT doc_id, trim(md) <> '' AND {INDEX_SQL} AS is_index FROM shape_fx"))
def _(spark, sf):
    d = a.table(spark, sf, "documents")
    md = F.expr(r"case lang when 'es' then concat('- 10:30 ', replace(text, '. ', '.\n- 10:30 ')) when 'fr' then concat('# Time\n', replace(text, '. ', '\n* ')) else text end")
    return d.select("doc_id", pg.looks_like_index(md).alias("is_index"))


# The text of every page, with damage by its length: what error bodies, blocked and list pages have beside it.
DAMAGE = (
    (1, "'{\"code\":451} '", "''"), (2, "'<!DOCTYPE html> '", "''"), (3, "''", "' Access Denied for you'"), (4, "'@@ab TOKEN@@token '", "''"), (5, "'Archivos. Time Archives '", "''"),
)  # head and tail by length(md) % 8


def damaged(column: str) -> str:
    part = lambda i: f"CASE length({column}) % 8 " + " ".join(f"WHEN {d[0]} THEN {d[i]}" for d in DAMAGE) + " ELSE '' END"
    return f"concat({part(1)}, {column}, {part(2)})"


REASON = f"""
whole_fx AS (SELECT page_id, url || '/a' AS url, string_agg(b.md, chr(10) || chr(10) ORDER BY pos) AS plain FROM blocks_fx b JOIN pages USING (page_id) GROUP BY page_id, url),
dmg2_fx AS (SELECT page_id, url, plain, {damaged("plain")} AS md FROM whole_fx),
{shape_sql("dmg2_fx", "page_id").strip()},
reason_fx AS (SELECT page_id, md, CASE WHEN md = '' THEN 'empty' WHEN regexp_matches(md, '(@@|＠＠)[a-z]*token', 'i') THEN 'placeholder'
  WHEN regexp_matches(substring(md, 1, 2200), '^[{{\\[]') AND {any_of("lower(substring(md, 1, 2200))", pg.JSON_ERRORS)} THEN 'json_error'
  WHEN regexp_matches(md, '^(<!doctype\\s+html|<html|<\\?xml)', 'i') THEN 'raw_html' WHEN {any_of("lower(md)", pg.BLOCK_WORDS)} THEN 'block_page' WHEN {INDEX_SQL} THEN 'index' END AS reason FROM shape_fx)""".replace("\\\\", "\\")


def damaged_pages(spark, sf):
    whole = pg.page_to_markdown(pg.main_content(pages(spark, sf))).select("page_id", F.col("md").alias("plain"))
    return pages(spark, sf).select("page_id", F.concat("url", F.lit("/a")).alias("url")).join(whole, "page_id").withColumn("md", F.expr(damaged("plain")))


@case("reject_page", with_ctes(ARTICLE, MD, REASON, body="SELECT page_id, reason FROM reason_fx"))
def _(spark, sf):
    return damaged_pages(spark, sf).select("page_id", pg.reject_page(F.col("md"), F.col("url")).alias("reason"))


# First the damaged text, then the plain one of pages of an even length, then a robot check.
@case("best_extraction", with_ctes(ARTICLE, MD, REASON, body="""
SELECT page_id, CASE WHEN reason IS NULL THEN 1 WHEN even THEN 2 END AS priority, CASE WHEN reason IS NULL THEN md WHEN even THEN plain END AS md,
  CASE WHEN reason IS NOT NULL AND NOT even THEN 451 END AS failed_status
FROM reason_fx JOIN (SELECT page_id, plain, length(plain) // 8 % 2 = 0 AS even FROM whole_fx) USING (page_id)"""))
def _(spark, sf):
    t = damaged_pages(spark, sf).withColumn("even", F.expr("length(plain) div 8 % 2 = 0"))
    tries = t.select(
        "page_id", "url",
        F.explode(F.expr("array(struct(1 as priority, md, cast(null as int) as status), struct(2 as priority, if(even, plain, null) as md, 451 as status), struct(3 as priority, 'captcha' as md, 200 as status))")).alias("x"),
    ).select("page_id", "url", "x.*")
    return pg.best_extraction(tries)


@case("mark_cacheable", r"""
SELECT doc_id, length(text) <= 3000 AS cache_text, length(text) * 2 <= 3000 AS cache_all FROM documents""")
def _(spark, sf):
    d = a.table(spark, sf, "documents").select("doc_id", F.col("text").alias("original"), F.col("text").alias("zh"), F.lit(None).cast("string").alias("ja"))
    return pg.mark_cacheable(d, 3000).select("doc_id", "cache_text", "cache_all")
