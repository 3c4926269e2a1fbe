"""URL columns: canonical form, keys, covers, relative resolution."""

from __future__ import annotations

from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedweave import config
from feedweave.functions.text import bind, trim_ws

SPLIT = r"^(?i:(https?))://([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _parts(c: Column) -> dict[str, Column]:
    url = trim_ws(c)
    scheme = F.lower(F.regexp_extract(url, SPLIT, 1))
    host = F.lower(F.regexp_extract(url, SPLIT, 2))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(
        F.regexp_replace(host, ":80$", "")
    )
    path = F.regexp_extract(url, SPLIT, 3)
    return {
        "ok": url.rlike(SPLIT) & (host != "") & ~host.rlike(r"[\s<>^|%`{}\"]"),
        "origin": F.concat(scheme, F.lit("://"), host),
        "host": host,
        "path": F.when(path == "", F.lit("/")).otherwise(F.replace(path, F.lit(" "), F.lit("%20"))),
        "query": F.replace(F.regexp_extract(url, SPLIT, 4), F.lit(" "), F.lit("%20")),
        "hash": F.regexp_extract(url, SPLIT, 5),
    }


def _without_tracking(query: Column) -> Column:
    params = F.split(F.substring(query, 2, 1_000_000_000), "&")
    pattern = r"(?i)^(?:utm_[^=]*|" + "|".join(config.TRACKING_KEYS) + r")(?:=.*)?$"
    kept = F.filter(params, lambda p: ~p.rlike(pattern))
    rest = F.array_join(F.filter(kept, lambda p: p != ""), "&")
    return (
        F.when(F.size(kept) == F.size(params), query)
        .when(rest == "", F.lit(""))
        .otherwise(F.concat(F.lit("?"), rest))
    )


def normalize_url(c: Column) -> Column:
    """Http(s) URL without fragment and tracking parameters; null for anything else."""
    p = _parts(c)
    return F.when(p["ok"], F.concat(p["origin"], p["path"], _without_tracking(p["query"])))


def stable_id(c: Column) -> Column:
    return F.sha1(normalize_url(c))


def safe_external_url(c: Column) -> Column:
    p = _parts(c)
    return F.when(p["ok"], F.concat(p["origin"], p["path"], p["query"], p["hash"]))


def is_http(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^https?://"), F.lit(False))


def host_of(c: Column) -> Column:
    p = _parts(c)
    return F.when(p["ok"], F.regexp_replace(p["host"], r":\d+$", ""))


# Fixed patterns: decorative images, and image file names.
NON_COVER = (
    r"(?i)favicon|apple-touch-icon|site-icon|siteicon|manifest|sprite|avatar|emoji"
    r"|spacer|blank|placeholder|noimage|no_image|/icons?/|/logo\.|/logos?/"
)
IMAGE_FILE = r"(?i)\.(png|jpe?g|gif|webp|avif|bmp|svg)(\?|#|$)"


def is_non_cover_image(c: Column) -> Column:
    return F.coalesce(c.rlike(NON_COVER), F.lit(False))


def is_image_url(c: Column) -> Column:
    return F.coalesce(c.rlike(IMAGE_FILE), F.lit(False))


def is_blocked_cover(c: Column, hosts=config.BLOCKED_COVER_HOSTS) -> Column:
    return F.coalesce(host_of(c).isin(*hosts), F.lit(False))


def encode_component(c: Column) -> Column:
    """Percent-encoding of one URL component."""
    out = F.url_encode(c)
    for java, wanted in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(java), F.lit(wanted))
    return out


def resolve_cover(c: Column, width: int = 960, base: str = "/", proxy: str = config.IMAGE_PROXY_HOST) -> Column:
    """struct(src, original), or null when there is no usable cover."""
    proxied = F.concat(
        F.lit(f"https://{proxy}/?url="), encode_component(c), F.lit(f"&w={width}&fit=cover&n=-1")
    )
    src = (
        F.when(~is_http(c) & c.startswith("/"), F.concat(F.lit(base), F.substring(c, 2, 1_000_000_000)))
        .when(c.startswith("http://"), proxied)
        .otherwise(c)
    )
    usable = c.isNotNull() & (trim_ws(c) != "") & ~is_blocked_cover(c)
    return F.when(usable, F.struct(src.alias("src"), c.alias("original")))


def join_http(base: str | None, raw: str | None) -> str | None:
    """Absolute http(s) URL of `raw` seen from `base`, or None."""
    text = (raw or "").strip()
    if not text or text.startswith("data:"):
        return None
    try:
        url = urljoin(base, text) if base else text
    except ValueError:
        return None
    scheme, sep, rest = url.partition("://")
    if not sep or scheme.lower() not in ("http", "https") or not rest:
        return None
    return url if "/" in rest or "?" in rest or "#" in rest else url + "/"


#: Any address: scheme, host part, path, query, fragment.
REFERENCE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _http_or_null(c: Column) -> Column:
    """The address if it is http(s) with something after `//`; a bare host gets its `/`."""
    rest = F.regexp_extract(c, r"(?is)^https?://(.+)$", 1)
    return F.when(rest == "", F.lit(None).cast("string")).when(rest.rlike(r"[/?#]"), c).otherwise(F.concat(c, F.lit("/")))


def _without_dots(segments: Column) -> Column:
    """Path segments with `.` left out and each `..` taking back the one before it: an array folded as a stack."""
    last = F.element_at(segments, -1)

    def step(stack: Column, segment: Column) -> Column:
        back = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.when(segment == "..", back).when(segment == ".", stack).otherwise(F.concat(stack, F.array(segment)))

    done = F.aggregate(segments, F.array().cast("array<string>"), step)
    return F.when(last.isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done)


def _joined(base: Column, ref: Column) -> Column:
    """`ref` seen from `base` (RFC 3986, 5.2), before it is asked whether the result is http(s). Each part is made once."""
    names = ("scheme", "host", "path", "query", "fragment")
    of = lambda c: F.struct(*(F.regexp_extract(c, REFERENCE, k).alias(n) for k, n in enumerate(names, 1)))

    def merged(p: Column) -> Column:
        def with_folder(folder: Column) -> Column:
            kept = F.when(F.element_at(folder, -1) == "", folder).otherwise(F.slice(folder, F.lit(1), F.size(folder) - 1))
            # Where two paths meet, doubled slashes in the middle are one.
            meet = lambda both: F.filter(both, lambda s, i: (s != "") | (i == 0) | (i == F.size(both) - 1))
            return bind(F.concat(kept, F.split(p["r"]["path"], "/")), meet)

        path = p["r"]["path"]
        segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(bind(F.split(p["b"]["path"], "/"), with_folder))
        whole = bind(F.array_join(bind(segments, _without_dots), "/"), lambda m: F.when(m == "", F.lit("/")).otherwise(m))
        return F.when(p["r"]["host"] != "", path).when(path == "", p["b"]["path"]).otherwise(whole)

    def join(p: Column) -> Column:
        r, b = p["r"], p["b"]
        other = (r["scheme"] != "") & (F.lower(r["scheme"]) != F.lower(b["scheme"]))
        slash = bind(merged(p), lambda w: F.when((w != "") & ~w.startswith("/"), F.concat(F.lit("/"), w)).otherwise(w))
        asked = F.when((r["host"] == "") & (r["path"] == "") & (r["query"] == ""), b["query"]).otherwise(r["query"])
        tail = F.concat(
            bind(asked, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))), F.when(r["fragment"] != "", F.concat(F.lit("#"), r["fragment"])).otherwise(F.lit(""))
        )
        host = F.when(r["host"] != "", r["host"]).otherwise(b["host"])
        return F.when(other, p["ref"]).otherwise(F.concat(F.lower(b["scheme"]), F.lit("://"), host, slash, tail))

    return bind(F.struct(ref.alias("ref"), of(ref).alias("r"), of(base).alias("b")), join)


def absolute_url(c: Column, first_base: Column, second_base: Column | None = None) -> Column:
    """The address itself if it is absolute, else seen from the first base that makes it an http(s) address; null if none does."""

    def found(text: Column) -> Column:
        near = lambda given: F.when(given == "", text).otherwise(_joined(given, text))
        seen = lambda b: bind(bind(F.coalesce(trim_ws(b), F.lit("")), near), _http_or_null)
        tried = [_http_or_null(text), seen(first_base)] + ([] if second_base is None else [seen(second_base)])
        return F.when(F.coalesce(text, F.lit("")) != "", F.when(~text.startswith("data:"), F.coalesce(*tried)))

    return bind(trim_ws(c), found)


def best_srcset(c: Column) -> Column:
    """URL with the highest descriptor (`Nw`, or `Nx` counted as N*1000); first one on ties."""
    entries = F.filter(F.transform(F.split(c, ","), trim_ws), lambda e: e != "")

    def scored(entry: Column, i: Column) -> Column:
        words = F.split(entry, r"\s+")
        desc = F.coalesce(F.try_element_at(words, F.lit(2)), F.lit(""))
        number = F.coalesce(F.substring(desc, F.lit(1), F.length(desc) - 1).try_cast("double"), F.lit(0.0))
        score = F.when(desc.endswith("w"), number).when(desc.endswith("x"), number * 1000).otherwise(F.lit(0.0))
        return F.struct(score.alias("score"), (-i).alias("rank"), words[0].alias("url"))

    return F.array_max(F.transform(entries, scored))["url"]


TAIL_PUNCT = r"[)\]）］.,!?:;}\"'»」】。，！？：；]+$"


def trim_url_punct(c: Column) -> Column:
    """Removes sentence punctuation stuck to the end of a URL; balanced brackets stay."""

    def count(text: Column, mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    def step(acc: Column, ch: Column) -> Column:
        url = acc["url"]
        keep = ((ch == ")") & (count(url, ")") <= count(url, "("))) | (
            (ch == "）") & (count(url, "）") <= count(url, "（"))
        )
        done = acc["done"] | keep
        cut = F.substring(url, F.lit(1), F.length(url) - 1)
        return F.struct(F.when(done, url).otherwise(cut).alias("url"), done.alias("done"))

    tail = F.filter(F.split(F.reverse(F.regexp_extract(c, TAIL_PUNCT, 0)), ""), lambda x: x != "")
    start = F.struct(c.alias("url"), F.lit(False).alias("done"))
    return F.aggregate(tail, start, step, lambda acc: acc["url"])


FULLWIDTH_TAIL = (
    r"(?i)(?:%EF%BC%89|%E3%80%91|%E3%80%8D|%E3%80%82|%EF%BC%8C|%EF%BC%9A|%EF%BC%9B|%EF%BC%81|%EF%BC%9F)+$"
)


def strip_encoded_punct(c: Column) -> Column:
    """Percent-encoded sentence marks at the end; an ASCII closer goes only without its opener."""
    url = F.regexp_replace(c, FULLWIDTH_TAIL, "")
    closers = [
        F.when(~url.rlike(f"(?i){opener}"), F.lit(closer))
        for closer, opener in (("%29", "%28"), ("%5D", "%5B"), ("%7D", "%7B"))
    ]
    allowed = F.array_compact(F.array(*closers))
    pattern = F.concat(F.lit("(?i)(?:"), F.array_join(allowed, "|"), F.lit(")+$"))
    return F.when(F.size(allowed) > 0, F.regexp_replace(url, pattern, F.lit(""))).otherwise(url)


ENCODED_TAIL = r"(?i)(?:%29|%5D|%7D|%2C|%2E|%3A|%3B|%22|%27|%EF%BC%89|%E3%80%91|%E3%80%8D)+$"


def url_compare_key(c: Column) -> Column:
    """Host without `www.` plus path: two links with the same key show the same page."""
    raw = trim_ws(c)
    cleaned = F.regexp_replace(strip_encoded_punct(trim_url_punct(raw)), ENCODED_TAIL, "")
    p = _parts(cleaned)
    host = F.regexp_replace(F.regexp_replace(p["host"], r":\d+$", ""), r"^www\.", "")
    key = F.concat(host, F.regexp_replace(p["path"], "/+$", "/"))
    return F.when(raw == "", F.lit("")).when(p["ok"], key).otherwise(cleaned)


SECTION_PATH = r"^/(news|interest|feature|review|convention|column|press-release|newsfeed)/?$"


def index_page_url(c: Column) -> Column:
    """Front page, archive or section page rather than an article."""
    p = _parts(c)
    path = F.lower(p["path"])
    hit = (path == "/") | path.endswith("/archive") | path.contains("/archive/") | path.rlike(SECTION_PATH)
    return F.coalesce(p["ok"] & hit, F.lit(False))
