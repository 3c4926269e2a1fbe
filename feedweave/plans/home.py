"""The home board: every list of the front page from one pass over the items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.functions import text
from feedweave.functions.dates import DAY_MS, HOUR_MS
from feedweave.operators import boards, health
from feedweave.session import checkpoint

LATEST, PULSE, SPOTLIGHT, TAGS, PICK_FROM, BRIEF = 24, 6, 6, 12, 200, 10


def board_rows(posts: DataFrame, latest_runs: DataFrame, now: Column, lang: str) -> DataFrame:
    """What the lists need of each item: id, arrival, ms, pulse, covered, recent, category, and title and tags of the recent ones."""
    scored = boards.with_scores(health.attach_health(posts, health.source_health(latest_runs)), now)
    ms = F.unix_millis("published_at")
    recent = F.coalesce(ms >= F.unix_millis(now) - DAY_MS, F.lit(False))
    return scored.select(
        "id", "arrival", ms.alias("ms"), F.col("pulse_score").cast("long").alias("pulse"), (F.coalesce("cover", F.lit("")) != "").alias("covered"), recent.alias("recent"), "category",
        F.when(recent, F.col("tags")).alias("tags"), F.when(recent, text.pick_localized("title", lang)).alias("title"),
    )


def _first_rows(rows: DataFrame) -> DataFrame:
    """(list, rank, id, pulse, recent, title): the first rows of the three orders that all item lists are cut from.

    Every item stands once in each order it belongs to; ranks are cut in each task before the shuffle.
    """
    key = lambda name, *order: F.struct(F.lit(name).alias("list"), *[o.cast("long").alias(f"k{i}") for i, o in enumerate(order)])
    newest = key("newest", F.coalesce(-F.col("ms"), F.lit(2**62)), F.lit(0))
    pulse = F.when(F.col("recent"), key("pulse", -F.col("pulse"), F.lit(0)))
    spotlight = F.when(F.col("recent"), key("spotlight", F.when(F.col("covered"), 0).otherwise(1), -F.col("pulse")))
    each = rows.select("id", "arrival", "pulse", "recent", "title", F.explode(F.array_compact(F.array(newest, pulse, spotlight))).alias("at")).select("*", "at.*")
    rank = F.row_number().over(Window.partitionBy("list").orderBy("k0", "k1", "arrival"))
    most = F.create_map(*[F.lit(x) for pair in (("newest", PICK_FROM), ("pulse", PULSE), ("spotlight", SPOTLIGHT)) for x in pair])
    ranked = each.withColumn("rank", rank).filter(F.col("rank") <= max(PICK_FROM, PULSE, SPOTLIGHT))
    return ranked.filter(F.col("rank") <= most[F.col("list")]).select("list", F.col("rank").cast("long").alias("rank"), "id", "pulse", "recent", "title")


def _counters(rows: DataFrame, now: Column) -> DataFrame:
    """(list, item, count, first): time windows, categories and tags counted in one aggregate, each tag with its first place."""
    age = F.unix_millis(now) - F.col("ms")
    entry = lambda name, item, at=None: F.struct(F.lit(name).alias("list"), item.alias("item"), (F.lit(0) if at is None else at).cast("int").alias("at"))
    lens = [F.when((age >= 0) & (age <= h * HOUR_MS), entry("lens", F.lit(f"h{h}"))) for h in (2, 6, 24)]
    category = entry("category", F.col("category"))  # of older items too, so that a category without recent ones is listed
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t, i: entry("tag", t, i))
    each = rows.select("arrival", "recent", F.explode(F.concat(F.array_compact(F.array(*lens, category)), tags)).alias("e")).select("arrival", "recent", "e.*")
    counted = F.count_if(F.col("recent") | (F.col("list") != "category")).alias("count")
    return each.groupBy("list", "item").agg(counted, F.min(F.struct("arrival", "at")).alias("first"))


def home_board(posts: DataFrame, latest_runs: DataFrame, now: Column, sources: DataFrame | None = None, lang: str = "zh", seed: int = 0) -> DataFrame:
    """(section, rank, item, value) of nine lists: latest, pulse, spotlight, tag, lens, category, health, random, brief.

    The items are read and scored once, into a narrow table; three orders and one aggregate over it give all lists.
    Without `sources` the health list covers the sources with a status.
    """
    rows = checkpoint(board_rows(posts, latest_runs, now, lang))
    first = checkpoint(_first_rows(rows))  # some 200 rows
    levels = health.source_health(latest_runs)
    known = levels.select("source_id").distinct() if sources is None else sources
    out = lambda df, name, rank, item, value: df.select(F.lit(name).alias("section"), rank.cast("long").alias("rank"), item.alias("item"), value.cast("long").alias("value"))
    newest = first.filter("list = 'newest'")
    pick = newest.orderBy(F.sha1(F.concat(F.lit(f"{seed}:"), "id"))).limit(1)
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("title"))
    counts = checkpoint(_counters(rows, now))
    by_count = F.row_number().over(Window.partitionBy("list").orderBy(F.col("count").desc(), "first"))
    tags = counts.filter("list = 'tag'").withColumn("rank", by_count).filter(F.col("rank") <= TAGS)
    # Zero windows are listed too.
    lens = posts.sparkSession.createDataFrame([(1, "h2"), (2, "h6"), (3, "h24")], "rank long, item string").join(counts.filter("list = 'lens'").select("item", "count"), "item", "left")
    by_name = F.row_number().over(Window.partitionBy("list").orderBy("item"))
    states = ("excellent", "good", "warn", "down", "stable_ratio")
    summary = health.health_summary(known, levels).select(F.posexplode(F.array(*[F.struct(F.lit(s).alias("item"), F.col(s).cast("long").alias("value")) for s in states])).alias("i", "s"))
    lists = [
        out(newest.filter(F.col("rank") <= LATEST), "latest", F.col("rank"), F.col("id"), F.col("pulse")),
        *[out(first.filter(F.col("list") == name), name, F.col("rank"), F.col("id"), F.col("pulse")) for name in ("pulse", "spotlight")],
        out(tags, "tag", F.col("rank"), F.col("item"), F.col("count")),
        out(lens, "lens", F.col("rank"), F.col("item"), F.coalesce("count", F.lit(0))),
        out(counts.filter("list = 'category'").withColumn("rank", by_name), "category", F.col("rank"), F.col("item"), F.col("count")),
        out(summary, "health", F.col("i") + 1, F.col("s.item"), F.col("s.value")),
        out(pick, "random", F.lit(1), F.col("id"), F.col("pulse")),
        out(newest.filter(F.col("recent") & (F.col("rank") <= BRIEF)), "brief", F.col("rank"), line, F.lit(None)),
    ]
    board = lists[0]
    for part in lists[1:]:
        board = board.unionByName(part)
    return board
