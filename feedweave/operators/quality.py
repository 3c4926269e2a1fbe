"""Data checks: each gives rows (item, rule) for what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweave.functions.urls import is_http
from feedweave.operators import ordering
from feedweave.operators.skew import lookup_by_key
from feedweave.session import checkpoint


def _text(name: str) -> Column:
    """Is the text column filled?"""
    return F.coalesce(F.trim(F.col(name)) != "", F.lit(False))


def violations(df: DataFrame, item: Column, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule; `rules` maps a name to the condition of being wrong."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.select(item.alias("item"), F.explode(broken).alias("rule"))


def repeats(df: DataFrame, keys: dict[str, Column], order: str, item: str) -> DataFrame:
    """Rows whose key occurred before, the first occurrence being fine; `keys` maps a rule to its key (null: not asked).

    All rules are counted in one aggregate, and only keys that occur twice are kept of it.
    """
    asked = F.array_compact(F.array(*[F.when(k.isNotNull(), F.struct(F.lit(rule).alias("rule"), F.concat(F.lit(f"{rule}:"), k).alias("key"))) for rule, k in keys.items()]))
    keyed = df.select(F.col(order).alias("_ord"), F.col(item).alias("item"), F.explode(asked).alias("k")).select("_ord", "item", "k.rule", F.col("k.key").alias("_key"))
    twice = checkpoint(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_ord").alias("_first")).filter("_n > 1"))
    return lookup_by_key(keyed, twice, "_key", "_n", "item").filter("_first < _ord").select("item", "rule")


def order_violations(df: DataFrame, group: list[str], order: str, time: str, item: str, tolerance_ms: int = 1000) -> DataFrame:
    """Rows newer than the row before them (by `order`) by more than the tolerance."""
    dated = df.filter(F.col(time).isNotNull()).select(*group, order, time, F.col(item).alias("item"))
    cut = ordering.pieces(dated, group, [F.col(order)])
    near = ordering.neighbours(cut, group, [time], before="_prev")
    late = F.unix_millis(time) > F.unix_millis(F.col(f"_prev.{time}")) + tolerance_ms
    return near.filter(late).select("item", F.lit("not_newest_first").alias("rule"))


def check_posts(posts: DataFrame, sources: DataFrame, categories: tuple | None = None) -> DataFrame:
    """Rules on published items. Needs id, url, title, published_at, category, tags, source fields, cover, arrival."""
    known = sources.select("source_id").distinct().withColumn("_known", F.lit(True))
    p = posts.join(known, "source_id", "left")
    item = F.col("arrival")
    good_url = _text("url") & is_http(F.col("url"))
    bad_category = ~_text("category")
    if categories:
        bad_category = bad_category | ~F.col("category").isin(*categories)
    rules = {
        "id_missing": ~_text("id"),
        "title_missing": ~_text("title"),
        "url_not_http": ~good_url,
        "id_not_sha1_of_url": good_url & _text("id") & (F.col("id") != F.sha1("url")),
        "date_invalid": F.col("published_at").isNull(),
        "category_unknown": bad_category,
        "tags_missing": F.col("tags").isNull() | F.exists("tags", lambda t: t.isNull()),
        "source_missing": ~_text("source_id"),
        "source_unknown": _text("source_id") & F.col("_known").isNull(),
        "source_name_missing": ~_text("source_name"),
        "source_url_not_http": ~(_text("source_url") & is_http(F.col("source_url"))),
        "cover_invalid": F.col("cover").isNotNull() & ~(_text("cover") & (is_http(F.col("cover")) | F.col("cover").startswith("/"))),
    }
    keys = {"id_repeated": F.when(_text("id"), F.col("id")), "url_repeated": F.when(good_url, F.lower("url"))}
    return (
        violations(p, item, rules)
        .unionByName(repeats(posts, keys, "arrival", "arrival"))
        .unionByName(order_violations(posts, [], "arrival", "published_at", "arrival"))
    )


RUN_TEXTS = ("name", "kind")


def check_source_runs(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Rules on status rows, and sources without a row (item = source id)."""
    ids = sources.select("source_id").distinct()
    r = runs.join(ids.withColumn("_known", F.lit(True)), "source_id", "left")
    rules = {
        "id_missing": ~_text("source_id"),
        "source_not_configured": _text("source_id") & F.col("_known").isNull(),
        **{f"{n}_missing": ~_text(n) for n in RUN_TEXTS},
        "url_not_http": ~(_text("url") & is_http(F.col("url"))),
        "ok_missing": F.col("ok").isNull(),
        "item_count_missing": F.col("item_count").isNull(),
        "duration_missing": F.col("duration_ms").isNull(),
        "used_invalid": ~F.coalesce(F.col("used").isin("fetched", "cached", "fallback"), F.lit(False)),
        "error_empty": F.col("error").isNotNull() & ~_text("error"),
    }
    missing = ids.join(runs.select("source_id").distinct(), "source_id", "left_anti")
    return violations(r, F.col("source_id"), rules).unionByName(
        missing.select(F.col("source_id").alias("item"), F.lit("status_missing").alias("rule"))
    )


def check_index(index: DataFrame, posts: DataFrame) -> DataFrame:
    """Rules on search rows, and the row count against the items (item = 'index')."""
    p = index.join(posts.select("id").distinct().withColumn("_known", F.lit(True)), "id", "left")
    rules = {
        "item_unknown": F.col("_known").isNull(),
        "hay_empty": ~_text("hay"),
        "tags_missing": F.col("tags").isNull() | F.exists("tags", lambda t: t.isNull()),
        **{f"{n}_missing": ~_text(n) for n in ("source_name", "source_id", "source_id_norm", "category")},
    }
    counts = index.agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("m")).unionByName(
        posts.agg(F.lit(0).cast("bigint").alias("n"), F.count(F.lit(1)).alias("m"))
    ).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    totals = {"index_empty": F.col("n") == 0, "posts_empty": F.col("m") == 0, "count_differs": (F.col("n") > 0) & (F.col("m") > 0) & (F.col("n") != F.col("m"))}
    return violations(p, F.col("id"), rules).unionByName(violations(counts, F.lit("index"), totals))


def check_history(history: DataFrame, numbers: tuple, order: str = "arrival") -> DataFrame:
    """Rules on run summaries: time stamp, ascending order, numbers present."""
    rules = {"generated_at_missing": F.col("generated_at").isNull(), **{f"{n}_missing": F.col(n).isNull() for n in numbers}}
    cut = ordering.pieces(history.select(order, "generated_at").filter("generated_at is not null"), [], [F.col(order)])
    near = ordering.neighbours(cut, [], ["generated_at"], before="_prev")
    back = near.filter(F.col("generated_at") < F.col("_prev.generated_at"))
    return violations(history, F.col(order).cast("string"), rules).unionByName(
        back.select(F.col(order).cast("string").alias("item"), F.lit("not_ascending").alias("rule"))
    )


def check_copies(copies: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the copies of one table that must agree; `differs` marks unequal ones."""
    rows = None
    for name, df in copies.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("copy"), "rows")
        rows = part if rows is None else rows.unionByName(part)
    spread = rows.agg(F.min("rows").alias("lo"), F.max("rows").alias("hi"), F.collect_list(F.struct("copy", "rows")).alias("c"))
    return spread.select((F.col("lo") != F.col("hi")).alias("differs"), F.inline("c"))  # one row per copy


def quality_report(found: DataFrame, n: int = 60) -> DataFrame:
    """Total per rule, and which violations are among the first n shown."""
    totals = found.groupBy("rule").agg(F.count(F.lit(1)).alias("total"))
    first = found.orderBy("item", "rule").limit(n).groupBy("rule").agg(F.count(F.lit(1)).alias("shown"))
    return totals.join(first, "rule", "left").select("rule", "total", F.coalesce("shown", F.lit(0)).alias("shown"))
