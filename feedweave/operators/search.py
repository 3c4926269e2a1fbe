"""Faceted search over the search rows, and jobs over tables of saved queries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions import dates, scores
from feedweave.functions.dates import HOUR_MS
from feedweave.functions.text import WS, bind, category_alias, normalize_text, trim_ws
from feedweave.operators import boards
from feedweave.session import checkpoint


@dataclass(frozen=True)
class SearchSpec:
    """What to look for. Word lists hold normalized text; times are epoch milliseconds."""

    text: tuple = ()
    not_text: tuple = ()
    tags: tuple = ()
    not_tags: tuple = ()
    sources: tuple = ()
    not_sources: tuple = ()
    categories: tuple = ()
    not_categories: tuple = ()
    after_ms: int | None = None
    before_ms: int | None = None
    is_read: bool | None = None
    is_unread: bool | None = None
    is_fresh: bool | None = None


@dataclass(frozen=True)
class ReaderState:
    """One reader: tables for sets that grow, word lists for the few words typed by hand."""

    reads: DataFrame | None = None
    followed_sources: DataFrame | None = None
    disabled_sources: DataFrame | None = None
    follow_words: tuple = ()
    block_words: tuple = ()
    only_followed: bool = False
    only_followed_sources: bool = False
    hide_read: bool = False


@dataclass(frozen=True)
class PageFilters:
    lens_hours: int | None = None
    only_stable: bool = False
    dedup: bool = False
    sort: str = "latest"
    fresh_hours: int = 6


def _every(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions, F.lit(True))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions, F.lit(False))


def _in_source(word: str) -> Column:
    return F.col("source_name").contains(word) | F.col("source_id_norm").contains(word)


def _in_tags(word: str) -> Column:
    return F.exists("tags", lambda t: t.contains(word))


def matches(spec: SearchSpec) -> Column:
    """All text, tag and source words must match; any one of the categories is enough."""
    hay, category, at = F.col("hay"), F.col("category"), F.col("published_ms")
    parts = [hay.contains(w) for w in spec.text] + [~hay.contains(w) for w in spec.not_text]
    parts += [_in_tags(w) for w in spec.tags] + [~_in_tags(w) for w in spec.not_tags]
    parts += [_in_source(w) for w in spec.sources] + [~_in_source(w) for w in spec.not_sources]
    if spec.categories:
        parts.append(category.isin(*spec.categories))
    if spec.not_categories:
        parts.append(~category.isin(*spec.not_categories))
    if spec.after_ms is not None:
        parts.append(F.coalesce(at >= spec.after_ms, F.lit(False)))
    if spec.before_ms is not None:
        parts.append(F.coalesce(at <= spec.before_ms, F.lit(False)))
    return _every(parts)


def _fresh(spec: SearchSpec, now: Column, hours: float) -> Column:
    if spec.is_fresh is None:
        return F.lit(True)
    age = F.unix_millis(now) - F.col("published_ms")
    fresh = (age >= 0) & (age < int(hours * HOUR_MS))
    return F.coalesce(fresh if spec.is_fresh else ~fresh, F.lit(False))


def mark_read(rows: DataFrame, reads: DataFrame | None) -> DataFrame:
    """Adds `is_read`: is the item in the reader's read set?

    With a user_id on both sides each row belongs to its reader (null: to none, who has read nothing), so one job
    serves all readers; else `reads` is the set of one reader.
    """
    if reads is None:
        return rows.withColumn("is_read", F.lit(False))
    by = ["user_id"] if "user_id" in rows.columns and "user_id" in reads.columns else []
    seen = reads.select(*by, F.col("post_id").alias("id")).distinct().withColumn("_seen", F.lit(True))
    return rows.join(seen, [*by, "id"], "left").withColumn("is_read", F.coalesce("_seen", F.lit(False))).drop("_seen")


def match_sources(rows: DataFrame, state: ReaderState) -> DataFrame:
    """Drops disabled sources; with only_followed_sources keeps followed ones."""
    if state.disabled_sources is not None:
        rows = rows.join(state.disabled_sources.select("source_id").distinct(), "source_id", "left_anti")
    if state.only_followed_sources:
        if state.followed_sources is None:
            return rows.filter(F.lit(False))
        rows = rows.join(state.followed_sources.select("source_id").distinct(), "source_id", "left_semi")
    return rows


def any_word(words: tuple) -> Column:
    return _any([F.col("hay").contains(w) for w in words if w])


def _visible(rows: DataFrame, spec: SearchSpec, state: ReaderState, now: Column, fresh_hours: float) -> DataFrame:
    keep = [matches(spec), _fresh(spec, now, fresh_hours)]
    if state.only_followed:
        keep.append(any_word(state.follow_words))
    if state.block_words:
        keep.append(~any_word(state.block_words))
    found = mark_read(match_sources(rows.filter(_every(keep)), state), state.reads)
    read = F.col("is_read")
    if spec.is_read is not None:
        found = found.filter(read == spec.is_read)
    if spec.is_unread is not None:
        found = found.filter(read != spec.is_unread)
    return found.filter(~read) if state.hide_read else found


def search(index: DataFrame, spec: SearchSpec, state: ReaderState = ReaderState(), now: Column | None = None, fresh_hours: float = 6) -> DataFrame:
    """Every matching row, with `is_read`; order and limit are separate steps."""
    return _visible(index, spec, state, F.lit(None) if now is None else now, fresh_hours)


def search_limit(found: DataFrame, limit: int = 1500) -> DataFrame:
    """The first matches, newest first (ties by id)."""
    return found.orderBy(F.col("published_ms").desc_nulls_last(), "id").limit(limit)


def search_totals(rows: DataFrame, is_match: Column, limit: int = 1500, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts reported beside a limited result: all rows, matches and unread ones, and whether the limit cuts the list.

    rows: the whole index with `is_read` (mark_read); is_match: the condition of the search; by: columns that tell readers apart.
    """
    hit = F.coalesce(is_match, F.lit(False))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(hit).alias("matched"), F.count_if(hit & ~F.col("is_read")).alias("unread")
    ).withColumn("truncated", F.col("matched") > limit)


def dedup_leaders(rows: DataFrame) -> DataFrame:
    """One row per duplicate key: highest pulse, earliest on ties; rows without key all stay."""
    key = F.when(F.coalesce("dedup_key", F.lit("")) != "", F.concat(F.lit("k"), "dedup_key")).otherwise(F.concat(F.lit("i"), "id"))
    rank = F.struct(F.coalesce("pulse_score", F.lit(0)), -F.col("arrival"))
    best = rows.groupBy(key.alias("_key")).agg(F.max_by(F.struct(*rows.columns), rank).alias("best"))
    return best.select("best.*")


def page_rows(posts: DataFrame) -> DataFrame:
    """Rows of one page: the haystack is title, summary, tags and source only."""
    rows = posts.withColumn("published_ms", F.unix_millis("published_at"))
    tags = F.filter(F.transform("tags", normalize_text), lambda t: t != "")
    name = normalize_text(F.coalesce("source_name", F.lit("")))
    hay = normalize_text(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", "preview", F.lit("")), F.array_join(tags, " "), name))
    return rows.select(
        "id", "source_id", hay.alias("hay"), tags.alias("tags"), name.alias("source_name"),
        normalize_text(F.coalesce("source_id", F.lit(""))).alias("source_id_norm"),
        normalize_text(F.coalesce("category", F.lit(""))).alias("category"),
        "published_ms", "published_at", "pulse_score", "dedup_key", "source_health", "arrival",
    )


def page_filter(posts: DataFrame, spec: SearchSpec, filters: PageFilters, now: Column, state: ReaderState = ReaderState()) -> DataFrame:
    """Search on a page of enriched items, plus time lens, stable sources, duplicates and order."""
    found = _visible(page_rows(posts), spec, state, now, filters.fresh_hours)
    if filters.lens_hours is not None:
        found = found.filter(F.unix_millis(now) - F.col("published_ms") <= filters.lens_hours * HOUR_MS)
    if filters.only_stable:
        found = found.filter(scores.is_stable(F.col("source_health")))
    if filters.dedup:
        found = dedup_leaders(found)
    return boards.sort_posts(found, filters.sort)


def search_facets(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per category and in total (category null): shown, unread, and whether it is the peak; for each value of `by` (readers)."""
    counts = found.groupingSets([[*by, "category"], [*by]], *by, "category").agg(
        F.grouping("category").alias("is_total"), F.count(F.lit(1)).alias("shown"), F.count_if(~F.col("is_read")).alias("unread")
    )
    peak = F.max(F.when(F.col("is_total") == 0, F.col("shown"))).over(Window.partitionBy(*(by or [F.lit(1)])))  # one row per category
    return counts.select(
        *by, "category", "shown", "unread", ((F.col("is_total") == 0) & (F.col("shown") == peak)).alias("is_peak")
    )


WINDOW = 3


def _windows(c: str) -> Column:
    """The distinct pieces of WINDOW characters of a text, from each of its characters on; those at the end are shorter."""
    starts = F.sequence(F.lit(1), F.length(c))
    return F.array_distinct(F.when(F.length(c) > 0, F.transform(starts, lambda i: F.substring(F.col(c), i, F.lit(WINDOW)))))


def _tokens(index: DataFrame) -> DataFrame:
    """(id, token): the distinct words of each haystack."""
    return index.filter(F.col("hay") != "").select("id", F.explode(F.array_distinct(F.split("hay", " "))).alias("token"))


BUCKETS = 1 << 20  # hashes of keys that are broadcast to a table before it is shuffled, at most
FEW = 400_000  # short rows that are broadcast as they are


def _meet(rows: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """Inner join on `by` of a large table with stored keys that few of its rows have: the others are not shuffled.

    Up to FEW keys are broadcast; of more, the hashes, and rows that have the hash of a key are joined by a shuffle.
    """
    if keys.count() <= FEW:
        return rows.join(F.broadcast(keys), by)
    bucket = F.pmod(F.xxhash64(by), F.lit(BUCKETS)).alias("_bucket")
    return rows.select("*", bucket).join(F.broadcast(keys.select(bucket).distinct()), "_bucket", "left_semi").drop("_bucket").join(keys, by)


def _tokens_with(parts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(part, token): which of `vocabulary` (stored distinct tokens) each of `parts` occurs in.

    A part stands at its rarest window, or at every window that begins with it if it is shorter than one, and is
    sought in the tokens that have such a window. The windows are few, however many tokens there are.
    """
    parts = parts.select("part").distinct()
    windows = checkpoint(vocabulary.select(F.explode(_windows("token")).alias("window")).groupBy("window").agg(F.count(F.lit(1)).alias("tokens")))
    cut = F.filter(_windows("part"), lambda w: F.length(w) == WINDOW)
    # A window that no token has is the rarest of all, and its part is in no token.
    of_part = parts.filter(F.length("part") >= WINDOW).select("part", F.explode(cut).alias("window")).join(windows, "window", "left")
    rarest = of_part.groupBy("part").agg(F.min(F.struct(F.coalesce("tokens", F.lit(0)).alias("tokens"), "window")).alias("r"))
    rarest = rarest.filter("r.tokens > 0").select("part", "r.window")
    starts = windows.select("window", F.explode(F.array_distinct(F.array(*(F.substring("window", 1, n) for n in range(1, WINDOW))))).alias("part"))
    short = parts.filter(F.length("part") < WINDOW).join(starts, "part").select("part", "window")
    anchors = checkpoint(rarest.unionByName(short))
    found = _meet(vocabulary.select("token", F.explode(_windows("token")).alias("window")), anchors, "window")
    return found.filter(F.col("token").contains(F.col("part"))).select("part", "token").distinct()


def _longest_part(word: Column) -> Column:
    return F.array_max(F.transform(F.split(word, " "), lambda p: F.struct(F.length(p).alias("n"), p.alias("part"))))["part"]


def match_words(index: DataFrame, words: DataFrame) -> DataFrame:
    """Postings (word, id): which distinct words occur in which haystacks, whoever asked for them.

    A word without blanks occurs in a haystack if it occurs in one of its tokens, so tokens lead to the ids. A
    phrase is sought by its longest part, and its candidates are checked on the text.
    """
    # Many ask for the same words: they are made one and stored before they are normalized, as the filter would go below.
    asked = checkpoint(words.select("word").distinct())
    norm = asked.select(normalize_text(F.col("word")).alias("word")).filter(F.col("word") != "").distinct()
    norm = norm.select("word", _longest_part(F.col("word")).alias("part"))
    tokens = _tokens(index)
    hits = _tokens_with(norm, checkpoint(tokens.select("token").distinct()))
    # Found once for words and phrases.
    held = checkpoint(tokens.join(hits, "token").select("part", "id").distinct())
    plain = norm.filter("word = part").join(held, "part").select("word", "id")
    phrases = index.select("id", "hay").join(norm.filter("word <> part").join(held, "part"), "id").filter(F.col("hay").contains(F.col("word")))
    return plain.unionByName(phrases.select("word", "id"))


SLICE = 1_000_000  # query ids and rows of queries that are broadcast to the items at once, at most
ASKERS = 1000  # queries of the same conditions that one row stands for, at most
TASK_PAIRS = 10_000_000  # pairs of query and item that a task is to write, about
LISTS = tuple(p + k for k in ("text", "tags", "sources", "categories") for p in ("", "not_"))
LIMITS = ("after_ms", "before_ms", "is_read", "is_unread", "is_fresh")
CONDITIONS = (*LISTS, *LIMITS)
KINDS = {"text": "w", "tags": "t", "sources": "s", "categories": "c"}


def _asked_alike(queries: DataFrame, by: tuple = CONDITIONS) -> DataFrame:
    """One row (ask, conditions, query_ids) for each ASKERS queries that ask for the same."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("query_id"))
    dealt = queries.select("query_id", *by, F.floor((place - 1) / ASKERS).alias("_part"))
    alike = dealt.groupBy(*by, "_part").agg(F.collect_list("query_id").alias("query_ids"))
    return alike.drop("_part").withColumn("ask", F.monotonically_increasing_id())


def _terms(asked: DataFrame, kinds: tuple) -> DataFrame:
    """(ask, kind, neg, term): what each query asks for (neg: shuts out), of the given kinds of lists."""
    one = lambda name, neg: F.transform(F.array_distinct(("not_" if neg else "") + name), lambda w: F.struct(
        F.lit(KINDS[name]).alias("kind"), F.lit(neg).alias("neg"), w.alias("term")
    ))
    return asked.select("ask", F.explode(F.concat(*[one(k, neg) for k in kinds for neg in (False, True)])).alias("t")).select("ask", "t.*")


def _names(stored: DataFrame) -> DataFrame:
    """(item, kind, name): the category, the source and the tags of each item."""
    named = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("name"))
    own = F.concat(F.array(named("c", F.col("category")), named("s", F.col("source"))), F.transform(F.array_distinct("tags"), lambda t: named("t", t)))
    return stored.select("item", F.explode(own).alias("n")).select("item", "n.*")


def _holders(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(kind, term, name, items): the tags and sources that hold a term, and the category that is the term.

    Names are matched as tokens are, by pieces of the term.
    """
    inner = terms.filter("kind <> 'c'").select("kind", "term").distinct().withColumn("part", _longest_part(F.col("term")))
    found = _tokens_with(inner, names.filter("kind <> 'c'").select(F.col("name").alias("token")).distinct())
    inside = inner.join(found, "part").withColumnRenamed("token", "name").join(names, ["kind", "name"]).filter(F.col("name").contains(F.col("term")))
    same = terms.filter("kind = 'c'").select("kind", "term").distinct().withColumn("name", F.col("term")).join(names, ["kind", "name"])
    return inside.select("kind", "term", "name", "items").unionByName(same.select("kind", "term", "name", "items"))


def _pieces(term: Column) -> Column:
    """The words of a term, with blanks where words stand beside them: of `a b` the end `a ` of a token and the start ` b` of one."""
    words = F.split(term, " ")
    return F.transform(words, lambda w, i: F.concat(F.when(i > 0, " ").otherwise(""), w, F.when(i < F.size(words) - 1, " ").otherwise("")))


def _timely(stored: DataFrame) -> Column:
    """Can a query's dates and its word on freshness hold for any item? Known from the first and last times."""
    conditions = F.lit(False)
    at, after, before = F.col("published_ms"), F.col("after_ms"), F.col("before_ms")
    for fresh, first, last in stored.groupBy("fresh").agg(F.min(at), F.max(at)).collect():  # two rows
        held = F.col("is_fresh").isNull() | (F.col("is_fresh") == fresh)
        held &= after.isNull() | F.coalesce(after <= F.lit(last), F.lit(False))
        held &= before.isNull() | F.coalesce(before >= F.lit(first), F.lit(False))
        conditions = conditions | held
    return conditions & F.coalesce(after <= before, F.lit(True))


def _stand(alive: DataFrame, known: DataFrame) -> DataFrame:
    """The queries that can find something, with what they need, what shuts items out, and the condition they stand at.

    known: their terms with `items`, the most items that each can hold in. What no item has shuts nothing out.
    """
    need, thing = ~F.col("neg") & (F.col("kind") != "c"), F.concat("kind", "term")
    told = known.groupBy("ask").agg(
        F.min(F.when(need, F.col("items"))).alias("least"),
        F.min(F.when(need & (F.col("kind") != "t"), F.struct("items", "kind", "term"))).alias("rarest"),
        F.sum(F.when(~F.col("neg") & (F.col("kind") == "c"), F.col("items"))).alias("of_categories"),
        F.array_sort(F.collect_set(F.when(need, thing))).alias("needs"),
        F.array_sort(F.collect_set(F.when(F.col("neg") & (F.col("items") > 0), thing))).alias("bars"),
    )
    none, asks = F.array().cast("array<string>"), F.size("categories") > 0
    by_category = F.when(asks, F.struct(F.col("of_categories").alias("items"), F.lit("c").alias("kind"), F.lit("").alias("term")))
    anywhere = F.struct(F.lit(1 << 62).alias("items"), F.lit("e").alias("kind"), F.lit("").alias("term"))
    able = alive.join(told, "ask", "left").filter((F.coalesce("least", F.lit(1)) > 0) & (~asks | (F.coalesce("of_categories", F.lit(0)) > 0)))
    return able.select(
        F.explode("query_ids").alias("query_id"), F.coalesce("needs", none).alias("needs"), F.coalesce("bars", none).alias("bars"),
        F.array_sort(F.array_distinct("categories")).alias("categories"), *LIMITS, F.array_min(F.array_compact(F.array("rarest", by_category, anywhere))).alias("at"),
    )


def _placed(asks: DataFrame, holders: DataFrame) -> DataFrame:
    """The queries at their places; what is known at a place is no longer asked for there."""
    at, none = F.col("at"), F.array().cast("array<string>")
    by_word = asks.filter("at.kind = 'w'").withColumn("place", F.concat(F.lit("w"), at["term"]))
    by_word = by_word.withColumn("needs", F.array_remove("needs", F.col("place")))
    by_category = asks.filter("at.kind = 'c'").select("*", F.explode("categories").alias("category"))
    by_category = by_category.withColumn("place", F.concat(F.lit("c"), "category")).drop("category").withColumn("categories", none)
    sources = holders.filter("kind = 's'").select(F.col("term").alias("sought"), "name")
    by_source = asks.filter("at.kind = 's'").withColumn("sought", at["term"]).join(sources, "sought").drop("sought")
    in_name = lambda t: t.startswith("s") & F.col("name").contains(F.substring(t, F.lit(2), F.length(t)))
    by_source = by_source.filter(~F.exists("bars", in_name)).withColumn("needs", F.filter("needs", lambda t: ~in_name(t)))
    by_source = by_source.withColumn("place", F.concat(F.lit("s"), "name")).drop("name")
    everywhere = asks.filter("at.kind = 'e'").withColumn("place", F.lit("e"))
    return by_word.unionByName(by_category).unionByName(by_source).unionByName(everywhere).drop("at", "ask")


def _held(stored: DataFrame, sought: DataFrame, tokens: DataFrame, hits: DataFrame, words: DataFrame, holders: DataFrame) -> DataFrame:
    """(item, has): which of the things sought (a kind and a term) each item holds.

    words: (term, part): the rarest piece of each word or phrase; hits: the tokens that a piece occurs in. Phrases are checked on the text.
    """
    terms = sought.select(F.substring("thing", 1, 1).alias("kind"), F.substring("thing", 2, 1 << 30).alias("term"))
    asked = checkpoint(terms.filter("kind = 'w'").join(words, "term").select("term", "part"))
    of_token = checkpoint(hits.join(asked, "part").select(F.trim("token").alias("token"), "term").distinct())
    phrase = lambda t: t.contains(" ")
    if of_token.count() <= FEW:
        # Nothing is shuffled before the check, so the text stays beside its tokens.
        beside = stored.select("item", "hay", F.explode(F.array_distinct(F.split("hay", " "))).alias("token")).join(F.broadcast(of_token), "token")
        text = beside.filter(~phrase(F.col("term")) | F.col("hay").contains(F.col("term")))
    else:
        maybe = _meet(tokens, of_token, "token").groupBy("item").agg(F.collect_set("term").alias("terms"))
        plain = maybe.select("item", F.filter("terms", lambda t: ~phrase(t)).alias("terms"))
        phrases = maybe.select("item", F.filter("terms", phrase).alias("terms")).filter(F.size("terms") > 0).join(stored.select("item", "hay"), "item")
        phrases = phrases.select("item", F.filter("terms", lambda t: F.col("hay").contains(t)).alias("terms"))
        text = plain.unionByName(phrases).select("item", F.explode("terms").alias("term"))
    text = text.select("item", F.concat(F.lit("w"), "term").alias("thing"))
    facets = holders.filter("kind <> 'c'").join(terms, ["kind", "term"]).select("kind", "name", F.concat("kind", "term").alias("thing"))
    named = _names(stored).join(facets, ["kind", "name"]).select("item", "thing")
    return text.unionByName(named).groupBy("item").agg(F.collect_set("thing").alias("has"))


def search_many(index: DataFrame, queries: DataFrame, reads: DataFrame | None = None, now: Column | None = None, fresh_hours: float = 6) -> DataFrame:
    """(query_id, id): the items that each parsed query (parse_query_table) finds, all queries in one job.

    The queries are the index: a query that needs what no item has finds nothing, what no item has shuts nothing out, and those that
    then ask for the same are one. Each stands at its rarest required word, its categories, or the sources that hold its rarest source
    word, whichever the fewest items have; one that asks for none of these stands at one place for all items. An item has the places that queries
    stand at, and meets queries only there. What else a query needs or shuts out is found in the items once, for all queries, and
    compared as sets. Queries are few and narrow beside the pairs, so they go to the items in broadcasts of a fixed size: no pair is shuffled.
    reads: what the reader of all these queries has read.
    """
    age = F.unix_millis(F.lit(None).cast("timestamp") if now is None else now) - F.col("published_ms")
    fresh = F.coalesce((age >= 0) & (age < int(fresh_hours * HOUR_MS)), F.lit(False))
    text = lambda c: F.coalesce(c, F.lit(""))
    stored = checkpoint(mark_read(index, reads).select(
        F.monotonically_increasing_id().alias("item"), "id", text("hay").alias("hay"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.concat(text("source_name"), F.lit("\n"), text("source_id_norm")).alias("source"), text("category").alias("category"),
        "published_ms", F.col("is_read").alias("seen"), fresh.alias("fresh"),
    ))
    asked = checkpoint(_asked_alike(queries))
    # Categories, sources, tags and times are few; they rule out queries before any word is sought.
    terms = _terms(asked, ("tags", "sources", "categories"))
    names = checkpoint(_names(stored).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("items")))
    holders = checkpoint(_holders(terms, names))
    held = holders.groupBy("kind", "term").agg(F.sum("items").alias("items"))
    wanted = terms.filter("not neg").join(held, ["kind", "term"], "left")
    lost = wanted.groupBy("ask").agg(F.min(F.when(F.col("kind") != "c", F.coalesce("items", F.lit(0)))).alias("least"), F.max(F.when(F.col("kind") == "c", F.coalesce("items", F.lit(0)))).alias("most"))
    alive = checkpoint(asked.filter(_timely(stored)).join(lost.filter("least = 0 or most = 0"), "ask", "left_anti"))

    tokens = _tokens(stored.select(F.col("item").alias("id"), "hay")).withColumnRenamed("id", "item")
    vocabulary = checkpoint(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("items")).withColumn("token", F.concat(F.lit(" "), "token", F.lit(" "))))
    of_text = _terms(alive, ("text",))
    pieces = of_text.select("term").distinct().select("term", F.explode(_pieces(F.col("term"))).alias("part"))
    hits = checkpoint(_tokens_with(pieces, vocabulary.select("token")))
    of_piece = hits.join(vocabulary, "token").groupBy("part").agg(F.sum("items").alias("items"))
    words = pieces.join(of_piece, "part", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("items", F.lit(0)).alias("items"), "part")).alias("r"))
    words = checkpoint(words.filter("r.items > 0").select("term", "r.items", "r.part"))
    counts = held.unionByName(words.select(F.lit("w").alias("kind"), "term", "items"))
    known = of_text.unionByName(terms.join(alive.select("ask"), "ask", "left_semi")).join(counts, ["kind", "term"], "left").withColumn("items", F.coalesce("items", F.lit(0)))
    asks = _asked_alike(_stand(alive, known), ("needs", "bars", "categories", *LIMITS, "at"))
    placed = checkpoint(_placed(asks, holders))

    sought = placed.select(F.explode(F.concat("needs", "bars", F.array("place"))).alias("thing")).distinct()
    has = _held(stored, sought, tokens, hits, words, holders)
    items = stored.drop("hay", "tags").join(has, "item", "left")
    items = items.withColumn("has", F.concat(F.coalesce("has", F.array().cast("array<string>")), F.array(F.concat(F.lit("c"), "category"))))
    items = checkpoint(items.repartition(_tasks(placed, words, names, stored), "item"))
    rows = items.select(
        "id", "has", "category", "published_ms", "seen", "fresh", F.explode(F.concat("has", F.array(F.concat(F.lit("s"), "source"), F.lit("e")))).alias("place")
    )
    asks_for = lambda flag, value: F.coalesce(F.col(flag) == value, F.lit(True))
    checks = [
        F.col("after_ms").isNull() | F.coalesce(F.col("published_ms") >= F.col("after_ms"), F.lit(False)),
        F.col("before_ms").isNull() | F.coalesce(F.col("published_ms") <= F.col("before_ms"), F.lit(False)),
        asks_for("is_read", F.col("seen")), asks_for("is_unread", ~F.col("seen")), asks_for("is_fresh", F.col("fresh")),
        (F.size("categories") == 0) | F.array_contains("categories", F.col("category")),
        (F.size("needs") == 0) | (F.size(F.array_except("needs", "has")) == 0), (F.size("bars") == 0) | ~F.arrays_overlap("bars", "has"),
    ]
    slices = -(-(placed.agg(F.sum(F.size("query_ids") + 10)).first()[0] or 0) // SLICE) or 1
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("place", "query_ids"), F.lit(slices)))
    found = [rows.join(F.broadcast(placed.filter(F.col("slice") == k).drop("slice")), "place").filter(_every(checks)).select(F.explode("query_ids").alias("query_id"), "id") for k in range(slices)]
    return reduce(DataFrame.unionByName, found)


def _tasks(placed: DataFrame, words: DataFrame, names: DataFrame, stored: DataFrame) -> int:
    """How many tasks the pairs are dealt to: items are narrow, what they are paired with is not, so their bytes do not say."""
    at = words.select(F.concat(F.lit("w"), "term").alias("place"), "items").unionByName(names.select(F.concat("kind", "name").alias("place"), "items"))
    at = at.unionByName(stored.agg(F.count(F.lit(1)).alias("items")).select(F.lit("e").alias("place"), "items"))
    asked = placed.groupBy("place").agg(F.sum(F.size("query_ids")).alias("queries"))
    pairs = at.join(asked, "place").agg(F.sum(F.col("items").cast("double") * F.col("queries"))).first()[0] or 0
    return max(placed.sparkSession.sparkContext.defaultParallelism, int(pairs // TASK_PAIRS) + 1)


TOKEN = rf"\"[^\"]+\"|'[^']+'|[^{WS[1:-1]}]+"


def _prefix(body: Column) -> Column:
    return F.when(body.contains(":"), normalize_text(F.substring_index(body, ":", 1))).otherwise(F.lit(""))


def _value(body: Column) -> Column:
    return F.when(body.contains(":"), F.regexp_replace(body, r"(?s)^[^:]*:", "")).otherwise(body)


def _kind(key: Column) -> Column:
    kind = F.lit("text")
    for name, keys in KEYS.items():
        kind = F.when(key.isin(*keys), F.lit(name)).otherwise(kind)
    return kind


def parse_query_table(queries: DataFrame) -> DataFrame:
    """Splits each query text (query_id, query) into its lists, dates and flags."""
    raw = F.transform(F.regexp_extract_all(trim_ws(F.col("query")), F.lit(TOKEN), F.lit(0)), lambda t: trim_ws(
        F.when(t.rlike("^(\"[^\"]+\"|'[^']+')$"), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    ))

    def piece(token: Column) -> Column:
        negative = token.startswith("-")
        whole = trim_ws(F.when(negative, F.substring(token, F.lit(2), F.length(token))).otherwise(token))
        # Each step is made once: in a lambda, a step that is mentioned often runs often.
        return bind(whole, lambda body: bind(_prefix(body), lambda key: bind(_value(body), lambda value: bind(normalize_text(value), lambda norm: F.struct(
            negative.alias("neg"), _kind(key).alias("kind"),
            F.when(key.isin(*KEYS["categories"]), category_alias(norm)).otherwise(norm).alias("value"), value.alias("raw"),
        )))))

    parts = F.filter(F.transform(raw, piece), lambda p: p["value"] != "")
    t = queries.select("query_id", parts.alias("p"))

    def words(kind: str, negative: bool) -> Column:
        return F.transform(F.filter("p", lambda p: (p["kind"] == kind) & (p["neg"] == negative)), lambda p: p["value"])

    def moment(kind: str) -> Column:
        of_kind = F.filter("p", lambda p: p["kind"] == kind)
        parsed = F.filter(F.transform(of_kind, lambda p: F.unix_millis(dates.parse_published(p["raw"]))), lambda m: m.isNotNull())
        return F.try_element_at(parsed, F.lit(-1))

    def last_flag(values: tuple) -> Column:
        return F.try_element_at(F.filter("p", lambda p: (p["kind"] == "flag") & p["value"].isin(*values)), F.lit(-1))

    seen, fresh = last_flag(("read", "unread", "new")), last_flag(("fresh",))
    about_read = seen["value"] == "read"
    other = F.when(seen["neg"], F.lit(True))
    return t.select(
        "query_id",
        *[c for k, n in (("text", "text"), ("tags", "tags"), ("sources", "sources"), ("categories", "categories"))
          for c in (words(k, False).alias(n), words(k, True).alias(f"not_{n}"))],
        moment("after").alias("after_ms"), moment("before").alias("before_ms"),
        F.when(about_read, ~seen["neg"]).otherwise(other).alias("is_read"),
        F.when(about_read, other).otherwise(~seen["neg"]).alias("is_unread"),
        (~fresh["neg"]).alias("is_fresh"),
    )


# Fixed words: the prefixes of each list.
KEYS = {
    "tags": ("tag", "t"),
    "sources": ("source", "s"),
    "categories": ("cat", "c", "category"),
    "after": ("after", "since"),
    "before": ("before", "until"),
    "flag": ("is",),
}


def empty_result_suggestions(spec: SearchSpec, posts: DataFrame, categories: tuple, now: Column, spoiler_word: str = "剧透") -> DataFrame:
    """Up to five queries to try instead, each only if the query lacks that facet."""
    spark = posts.sparkSession
    one = spark.range(1)
    parts = []

    def add(order: int, df: DataFrame, preset: Column, lens: str | None = None, sort: str | None = None):
        parts.append(df.select(F.lit(order).alias("ord"), preset.alias("preset"), F.lit(lens).cast("string").alias("lens"), F.lit(sort).cast("string").alias("sort")))

    if not spec.is_unread:
        add(1, one, F.lit("is:unread"))
    if not spec.categories:
        place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category"))
        counted = posts.groupBy("category").agg(F.count(F.lit(1)).alias("n")).filter(place > 0)
        add(2, counted.orderBy(F.col("n").desc(), place).limit(1), F.concat(F.lit("cat:"), "category"))
    if not spec.tags:
        add(3, boards.top_token(boards.tag_tokens(posts)), F.concat(F.lit("tag:"), "token"))
    if not spec.sources:
        add(4, boards.top_token(boards.source_tokens(posts)), F.concat(F.lit("source:"), "token"))
    if spec.after_ms is None and spec.before_ms is None:
        day = F.date_format(F.timestamp_millis(F.unix_millis(now) - 24 * HOUR_MS), "yyyy-MM-dd")
        add(5, one, F.concat(F.lit("after:"), day), "24h", "pulse")
    if not spec.not_tags:
        add(6, one, F.lit(f"-tag:{spoiler_word}"))
    if not parts:
        return one.select(F.lit(1).alias("ord"), *[F.lit("").alias(c) for c in ("preset", "lens", "sort")]).limit(0)
    return reduce(DataFrame.unionByName, parts).orderBy("ord").limit(5)


def search_events(events: DataFrame, q: str) -> DataFrame:
    """Events whose type, path, language, device or payload contains the text."""
    hay = F.lower(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("type", "path", "lang", "device", "data")]))
    return events.filter(hay.contains(q.lower())) if q else events


def resolve_bookmarks(bookmarks: DataFrame, posts: DataFrame) -> DataFrame:
    """Bookmarked items, and ids no longer published (found = false)."""
    ids = bookmarks.select(F.col("post_id").alias("id")).distinct()
    return ids.join(posts.select("id", "title", "published_at"), "id", "left").withColumn("found", F.col("published_at").isNotNull())
