"""Main text of web pages by site style trees (after Yi, Liu and Li, 2003).

The trees of the pages of a host are merged: elements with the same path of tags and classes are one node.
Text belongs to the container around it: paragraphs, headings, list items and cells stand or fall together. A
container of text has content importance 1 - H, where H is the mean over its distinct texts of their entropy over
the pages, to the base of the number of pages: a menu entry found on every page has importance 0, a paragraph
found on one page has 1. Pages with the same blocks are one page, so copies do not make an article a menu. An inner node
has presentation importance, the entropy of the sequences of children it is shown with. Text of containers
below THRESHOLD is noise and removed from every page of the host; so a branch without other text goes as a whole.

Few texts make H too large: of two articles that end with the same line, a third of the texts is shared. So every
container counts as if it had shown PRIOR_TEXTS texts more, each on one page, whatever the size of its host.

Elements that are no article text by their role go at once: NOISE_TAGS, and elements named by NOISE_WORDS. A name
that only contains such a word (site-footer) counts less than the word itself (footer): it never removes the page's
frame (html, body), its main element or an article, nor what contains one, and not if another word of the
name qualifies it (no-sidebar, has-comments). Each host of two distinct pages or more is judged by its own tree
alone; a host of one page shows nothing twice, so only roles remove parts of it.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.llm.common import plain_text, stored

THRESHOLD = 0.75
MIN_PAGES = 2  # distinct pages from which a host is judged by its own tree
PRIOR_TEXTS = 2
LONG_PATH = 256  # a longer path is written as its hash, so a path of any depth has bounded size
PAGES_OF_COPY = 500  # pages that share a copy of their host's noise paths
SAME = 1e-9  # importances that differ by less are equal
WEIGHT = 0.9  # how much a child's importance counts against its parent's own

TOKEN = re.compile(
    # Possessive, so that a quote that is never closed is passed once and not tried again in every way.
    r"""<!--.*?(?:-->|\Z) | <[!?][^>]*+> | <(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)> | </?[a-zA-Z][^>]*+>""",
    re.S | re.X,
)
NAMES = re.compile(r"""(?:^|\s)(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW_TAGS = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select", "xmp"}
BLOCK_TAGS = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Opening one of the key's elements ends an open one of these, up to the nearest of the last.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr"}, {"table"}),
}
#: Elements that are parts of the container around them.
PARTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "figcaption", "hgroup"}
NOISE_TAGS = {"head", "nav", "footer", "aside", "form", "button", "dialog", "menu", "search", "fieldset"}
NOISE_WORDS = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus",
    "footer", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "replies", "reply", "share", "sidebar",
    "social", "sponsor", "sponsored", "subscribe", "widget",
}


#: Words that make of a name with a noise word the name of something else.
QUALIFIERS = {"no", "not", "non", "has", "have", "with", "without", "hide", "hidden", "hides", "is", "tag", "category", "type", "format"}
FRAME = {"html", "body", "main"}


class Page:
    """One pass over a page: `blocks` of (path, text) in order, and `children`, the child sequences shown by path.

    White space in a block is one space, character references are decoded, elements that are noise by role are
    left out. Unclosed and misplaced tags are read as browsers do where it matters to blocks. The work is linear in
    the page, however deep it is and whatever is left unclosed.
    """

    def __init__(self, source: str):
        self.found: list[tuple[str, str, tuple[int, ...]]] = []  # path, text, names around it that are noise
        self.shown: list[tuple[str, str, tuple[int, ...]]] = []
        self.kept: set[int] = set()  # such names that turned out to be of a part with the article in it
        self.names = 0
        self.stack: list[tuple[str, str, bool, tuple[int, ...], list[str]]] = [("", "", False, (), [])]  # tag, path, noise, names, labels of children
        self.places: dict[str, list[int]] = {}  # where on the stack each tag is open
        self.buffer: list[str] = []
        at, last = 0, source.rfind(">") + 1  # no tag ends later
        while m := TOKEN.search(source, at, last):
            self.buffer.append(source[at : m.start()])
            at = m.end()
            tag = (m["tag"] or "").lower()
            if not tag:
                if m[0].startswith("<!--") and not (m[0].endswith("-->") and len(m[0]) > 6):
                    at = len(source)  # a comment that is never closed
                continue
            if m["end"]:
                self._close(tag)
            elif tag in RAW_TAGS and not m["attributes"].endswith("/"):
                over = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = over.end() if over else len(source)
            elif tag in BLOCK_TAGS:
                self._open(tag, m["attributes"])
            elif tag == "br":
                self.buffer.append(" ")
        self.buffer.append(source[at:])
        self._pop_to(1)
        self._flush()
        good = lambda names: not names or self.kept.issuperset(names)
        self.blocks = [(path, text) for path, text, names in self.found if good(names)]
        self.children = Counter((path, inner) for path, inner, names in self.shown if good(names))

    def _at(self, tag: str) -> int:
        """The innermost place where a tag is open, or 0."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def _open(self, tag: str, attributes: str) -> None:
        self._flush()
        if at := self._at("p"):
            self._pop_to(at)
        ended, within = ENDS.get(tag, ((), ()))
        if ended:
            border = max(map(self._at, within))
            places = [self.places.get(t, ()) for t in ended]
            if open_ones := [p[k] for p in places if (k := bisect.bisect_right(p, border)) < len(p)]:
                self._pop_to(min(open_ones))
        if tag == "hr":
            return
        names = [w for _, *v in NAMES.findall(attributes) for w in "".join(v).lower().split()] if "=" in attributes else []
        label = ".".join([tag, *sorted(set(names))])
        _, path, noise, around, siblings = self.stack[-1]
        siblings.append(label)
        noise = noise or tag in NOISE_TAGS or (tag == "header" and not (self._at("article") or self._at("main")))
        if tag == "main":
            self.kept.update(around)
            around = ()
        if tag == "article" and not any(w in NOISE_WORDS for w in names):
            # A weak name is odd, a strong one even: an article saves what has only part of a noise word in its name.
            self.kept.update(n for n in around if n % 2)
            around = tuple(n for n in around if n % 2 == 0)
        if tag not in FRAME and (named := _noise_name(names)) and not (tag == "article" and named == 1):
            self.names += 2
            around = (*around, self.names - named % 2)
        self.stack.append((tag, path if tag in PARTS else _below(path, label), noise, around, []))
        self.places.setdefault(tag, []).append(len(self.stack) - 1)

    def _close(self, tag: str) -> None:
        if tag in BLOCK_TAGS and (at := self._at(tag)):
            self._flush()
            self._pop_to(at)

    def _pop_to(self, size: int) -> None:
        self._flush()
        while len(self.stack) > size:
            tag, path, noise, around, children = self.stack.pop()
            self.places[tag].pop()
            inner = [c for c in children if c.split(".")[0] not in PARTS]
            if inner and not noise:
                self.shown.append((path, " ".join(inner), around))

    def _flush(self) -> None:
        if self.buffer:
            text = "".join(self.buffer)
            self.buffer = []
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text and not self.stack[-1][2]:
                self.found.append((self.stack[-1][1], text, self.stack[-1][3]))


def _noise_name(names: list[str]) -> int:
    """2 if a name is a noise word, 1 if only a part of one is and nothing qualifies it, else 0."""
    if any(w in NOISE_WORDS for w in names):
        return 2
    parts = [re.split(r"[-_:]+", w) for w in names]
    return int(any(not QUALIFIERS.intersection(p) and not NOISE_WORDS.isdisjoint(p) for p in parts))


def host_of(url: Column) -> Column:
    """The host of an absolute URL in lower case, else the empty string."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def style_trees(pages: DataFrame, copies: bool = True, merged: bool = True) -> DataFrame:
    """(host, path, pages, content, presentation, importance): the merged trees, of each host and of all under a null host.

    content is null for nodes without text of their own, presentation for nodes without children. Without `copies`,
    pages with the same blocks count once, on a host and in the tree of all, and pages without text not at all;
    without `merged` there is no tree of all.
    """

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, seen = [], []
            for source in batch.column(1).to_pylist():
                page = Page(source)
                counts = Counter((path, False, _hash(text)) for path, text in page.blocks)
                counts.update({(path, True, _hash(children)): n for (path, children), n in page.children.items()})
                keys.append(_hash("\0".join(part for block in page.blocks for part in block)) if page.blocks else None)
                seen.append([{"path": path, "inner": inner, "shown": what, "times": float(n)} for (path, inner, what), n in counts.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(seen, features)], names=["host", "page", "seen"])

    features = pa.list_(pa.struct([("path", pa.string()), ("inner", pa.bool_()), ("shown", pa.int64()), ("times", pa.float64())]))
    source = pages.select(host_of(F.col("url")).alias("host"), plain_text("html").alias("html"))
    rows = source.mapInArrow(shown, "host string, page long, seen array<struct<path string, inner boolean, shown long, times double>>")
    rows = stored(rows if copies else rows.filter("page is not null").dropDuplicates(["host", "page"]), "style-tree")
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    own = _importance(_nodes(rows).join(sizes, "host"))
    if not merged:
        return own
    everything = (rows if copies else rows.dropDuplicates(["page"])).withColumn("host", F.lit(None).cast("string"))
    count = everything.agg(F.count(F.lit(1)).alias("pages"))  # one row
    return own.unionByName(_importance(_nodes(everything).join(F.broadcast(count))))


def _nodes(rows: DataFrame) -> DataFrame:
    """(host, path, content, texts, presentation): entropies in nats and distinct texts; `times` of a feature in all, `spread` the sum of n * ln(n)
    over its pages. Sums are taken before the shuffle, so a host with any number of texts is no hot spot."""
    seen = rows.select("host", F.inline("seen")).groupBy("host", "path", "inner", "shown").agg(
        F.sum("times").alias("times"), F.sum(F.col("times") * F.log("times")).alias("spread")
    )
    inner = F.when(F.col("inner"), F.col("times"))
    entropy = F.when(~F.col("inner"), F.log("times") - F.col("spread") / F.col("times"))
    return seen.groupBy("host", "path").agg(
        F.avg(entropy).alias("content"), F.count(entropy).alias("texts"),
        (F.log(F.sum(inner)) - F.sum(inner * F.log("times")) / F.sum(inner)).alias("presentation"),
    )


def _importance(nodes: DataFrame) -> DataFrame:
    """Entropies to the base of the number of pages; importance is that of a node with PRIOR_TEXTS texts of one page more."""
    base = F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    nodes = nodes.withColumn("own", F.coalesce(1 - F.col("content") / base * F.col("texts") / (F.col("texts") + PRIOR_TEXTS), F.lit(0.0)))
    own = F.col("own")
    return nodes.withColumn("content", 1 - F.col("content") / base).withColumn("presentation", F.col("presentation") / base).select(
        "host", "path", "pages", "content", "presentation",
        F.when(F.col("presentation").isNull(), own).otherwise(WEIGHT * own + (1 - WEIGHT) * F.col("presentation")).alias("importance"),
    )


def _below(path: str, label: str) -> str:
    """The path of a child; the hash of a long path stands for all of it."""
    import xxhash

    return f"{path if len(path) <= LONG_PATH else '#' + xxhash.xxh3_128_hexdigest(path)}/{label}"


def _hash(text: str) -> int:
    """A hash of 63 bits that is the same in every process."""
    import xxhash

    return xxhash.xxh3_64_intdigest(text) >> 1


def noise_paths(pages: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, pages, noise): for each host with noise its distinct pages and the hashes of paths whose text is noise, with their importance.

    Inner nodes need no entry, as a branch goes with its leaves. A path on one page only is no noise, so names made anew for each page add nothing.
    """
    trees = style_trees(pages, copies=False, merged=False).filter(F.col("content").isNotNull() & (F.col("importance") < threshold) & (F.col("pages") >= min_pages))
    one = F.struct(_path_hash(F.col("path")).alias("path"), F.col("importance").cast("float").alias("importance"))
    return trees.groupBy("host").agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list(one)).alias("noise"))


def _path_hash(path: Column) -> Column:
    """The first 60 bits of a path's MD5, as _path_number has them."""
    return F.conv(F.substring(F.md5(path.cast("binary")), 1, 15), 16, 10).cast("long")


@functools.lru_cache(1 << 16)
def _path_number(path: str) -> int:
    return int(hashlib.md5(path.encode(), usedforsecurity=False).hexdigest()[:15], 16)


def extract_text(pages: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page: its blocks outside noise, in page order, joined by a line feed.

    A null page is empty and has no text. Pages without a host, or a null URL, share one tree. A host of one distinct
    page has no tree: its page keeps all that is not noise by role. Rows that repeat
    the blocks of a page have its text, but weigh as one page in the tree, and a page whose blocks are all shared alike keeps
    them. Other columns are not looked at; an empty table gives
    an empty result.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, noise in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                gone = {n["path"]: n["importance"] for n in noise or ()}
                blocks = [(_path_number(path), text) for path, text in Page(source).blocks]
                if blocks and all(path in gone for path, _ in blocks):
                    weights = [gone[path] for path, _ in blocks]
                    if max(weights) - min(weights) < SAME:  # all shared alike: nothing tells an article from the rest
                        gone = {}
                texts.append("\n".join(text for path, text in blocks if path not in gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", plain_text("html").alias("html"), host_of(F.col("url")).alias("host"))
    # A host may have any number of pages: its noise is copied once for every PAGES_OF_COPY of them.
    noise = stored(noise_paths(pages, threshold, min_pages), "style-noise")
    rows = source.groupBy("host").agg(F.count(F.lit(1)).alias("rows")).join(noise.select("host"), "host")
    copies = stored(rows.select("host", F.ceil(F.col("rows") / PAGES_OF_COPY).alias("copies")), "style-copies")
    source = source.join(copies, "host", "left").withColumn("copy", F.pmod(F.xxhash64("page_id", "html"), F.coalesce("copies", F.lit(1))))
    each = noise.join(copies, "host").select("host", "noise", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    joined = source.join(each, ["host", "copy"], "left").select("page_id", "url", "html", "noise")
    return joined.mapInArrow(clean, "page_id long, url string, text string, n_chars long")
