"""Text columns: cleaning, keys, tags, labels. All JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave import config

# White space as browsers see it; Java's \s covers only the ASCII part.
WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# The same without the ASCII space.
WS_ODD = r"[\t\n\x0b\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# Both behind a wide range that rules out most letters at once: Java asks the parts of a class one after the other.
FAST_WS = rf"[\t-\r \u00a0\u1680-\uffff&&{WS}]"
FAST_WS_ODD = rf"[\t-\r\u00a0\u1680-\uffff&&{WS_ODD}]"
NO_WIDTH = "\u200b\u200c\u200d\ufeff"
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
CJK = r"[\u3040-\u30ff\u4e00-\u9fff]"


def bind(c: Column, use) -> Column:
    """use(c) with c evaluated once per row, however often `use` mentions it.

    Lambda bodies are not searched for common parts, so a long expression
    mentioned n times inside one would run n times.
    """
    return F.transform(F.array(c), lambda v: use(v))[0]


def trim_ws(c: Column) -> Column:
    return F.trim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """Runs of white space become one space; ends trimmed. Single spaces are left untouched, not replaced."""
    return F.trim(F.regexp_replace(c, f"{FAST_WS_ODD}{FAST_WS}*| {FAST_WS}+", " "))


def clamp(c: Column, n: int) -> Column:
    """At most n characters, the last one an ellipsis when cut."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, max(0, n - 1)), F.lit("…")))


def strip_truncate(c: Column, n: int) -> Column:
    text = collapse(c)
    return F.when(F.length(text) <= n, text).otherwise(
        F.concat(F.rtrim(F.substring(text, 1, max(0, n - 1))), F.lit("…"))
    )


def normalize_text(c: Column) -> Column:
    """Lower case without marks of no width, white space (the ideographic space too) collapsed."""
    out = F.lower(c)
    for mark in NO_WIDTH:
        out = F.replace(out, F.lit(mark), F.lit(""))
    return collapse(out)


def dedup_key(c: Column) -> Column:
    """First 12 words (letters, digits, kana, kanji) joined by hyphens, noise words left out unless nothing else is there.

    Everything else, brackets included, separates words; single spaces are left untouched, not replaced.
    """
    keep = r"A-Za-z0-9\u3040-\u30ff\u4e00-\u9fff"
    base = F.regexp_replace(F.coalesce(c, F.lit("")), f"[^{keep} ][^{keep}]*| [^{keep}]+", " ")
    noise = "|".join(config.NOISE_TOKENS)

    def first_words(base: Column) -> Column:
        noisy = base.rlike(f"(?:^| )(?:{noise})(?: |$)")
        kept = F.trim(F.regexp_replace(F.concat(F.lit(" "), base, F.lit(" ")), f"(?: (?:{noise}))+(?= )", ""))
        words = F.when(noisy & (kept != ""), kept).otherwise(base)
        return F.lower(F.replace(F.substring_index(words, " ", 12), F.lit(" "), F.lit("-")))

    return bind(F.trim(base), first_words)


def read_minutes(c: Column) -> Column:
    raw = F.coalesce(c, F.lit(""))
    minutes = F.greatest(
        F.length(F.regexp_replace(raw, f"[^{CJK[1:-1]}]+", "")) / F.lit(420.0),
        F.regexp_count(raw, F.lit("[A-Za-z0-9]+")) / F.lit(200.0),
        F.lit(0.6),
    )
    # ceil of at least 0.6 is at least 1, also for blank text
    return F.least(F.lit(20), F.ceil(minutes)).cast("int")


def derive_tags(title: Column, summary: Column, category: Column, rules=config.TAG_RULES, limit: int = 6) -> Column:
    blob = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(summary, F.lit("")))
    hits = F.array_compact(F.array(*[F.when(blob.rlike(f"(?i)(?:{p})"), F.lit(tag)) for tag, p in rules]))
    fallback = F.lit(config.DEFAULT_TAG)
    for name, tag in config.DEFAULT_TAGS.items():
        fallback = F.when(category == name, F.lit(tag)).otherwise(fallback)
    return F.when(F.size(hits) > 0, F.slice(hits, 1, limit)).otherwise(F.array(fallback))


def category_alias(c: Column, aliases=config.CATEGORY_ALIASES) -> Column:
    pairs = [F.lit(x) for item in aliases.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def has_kana(c: Column) -> Column:
    return F.coalesce(c.rlike(r"[\u3041-\u30ff]"), F.lit(False))


def needs_translation(source_lang: Column, source_text: Column, translated: Column, target: str) -> Column:
    """Does this field still need the target language? Kana proves Japanese."""
    need = (F.coalesce(source_lang, F.lit("unknown")) != target) & (F.coalesce(translated, F.lit("")) == "")
    need = need & (F.coalesce(source_text, F.lit("")) != "")
    return need & ~has_kana(source_text) if target == "ja" else need


def post_needs_translation(source_lang: Column) -> Column:
    """Any of title, summary, preview still without one of the output languages."""
    checks = [
        needs_translation(source_lang, F.col(f), F.col(f"{f}_{t}"), t)
        for f in ("title", "summary", "preview")
        for t in config.OUTPUT_LANGS
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out | c
    return out


def pick_localized(field: str, lang: str) -> Column:
    """`title`: translation or original; `feed`: preview first; `card`: summary first."""
    if field == "title":
        return F.coalesce(F.col(f"title_{lang}"), F.col("title"))
    if field == "feed":
        order = (f"preview_{lang}", f"summary_{lang}", "preview", "summary")
    else:
        order = (f"summary_{lang}", f"preview_{lang}", "summary", "preview")
    return F.coalesce(*[F.col(name) for name in order])


def relative_age_label(at: Column, now: Column, lang: str) -> Column:
    hours = F.floor((F.unix_millis(now) - F.unix_millis(at)) / F.lit(3_600_000))
    days = F.floor(hours / 24)
    # Fixed label texts per language.
    under, h, d = ("1時間未満", "時間前", "日前") if lang == "ja" else ("1小时内", "小时前", "天前")
    return (
        F.when(hours < 0, F.lit(None).cast("string"))
        .when(hours == 0, F.lit(under))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(h)))
        .otherwise(F.concat(days.cast("string"), F.lit(d)))
    )


def escape_xml(c: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def chunk_text(c: Column, n: int) -> Column:
    """Packs paragraphs into chunks of at most n characters; a longer paragraph is cut at n.

    One pass per row over its own paragraphs; returns an array of chunks.
    """
    text = trim_ws(F.replace(c, F.lit("\r\n"), F.lit("\n")))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def cut(p: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.length(p) - 1) / n).cast("int"))
        return F.transform(starts, lambda i: F.substring(p, i * n + 1, F.lit(n)))

    def flushed(acc: Column) -> Column:
        cur = trim_ws(acc["cur"])
        return F.when(cur == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(cur)))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["cur"] == "", p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p))
        return (
            F.when(F.length(joined) <= n, F.struct(acc["done"].alias("done"), joined.alias("cur")))
            .when(
                F.length(p) > n,
                F.struct(F.concat(flushed(acc), cut(p)).alias("done"), F.lit("").alias("cur")),
            )
            .otherwise(F.struct(flushed(acc).alias("done"), p.alias("cur")))
        )

    def pack(text: Column) -> Column:
        paras = F.filter(F.transform(F.split(text, r"\n{2,}"), trim_ws), lambda p: p != "")
        return F.when(F.length(text) <= n, F.array(text)).otherwise(F.aggregate(paras, empty, step, flushed))

    return bind(text, pack)
