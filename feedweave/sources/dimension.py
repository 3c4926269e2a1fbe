"""The source dimension and rules stored with it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SCHEMA = (
    "source_id string, name string, kind string, lang string, url string, homepage string, "
    "category string, pattern string"
)


def _pattern(rule: dict | None) -> str | None:
    """Regex text of an include rule; a rule that does not compile filters nothing."""
    if not rule or not rule.get("pattern"):
        return None
    try:
        re.compile(rule["pattern"])
    except re.error:
        return None
    return ("(?i)" if "i" in (rule.get("flags") or "") else "") + rule["pattern"]


def load_sources(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Configured sources; ids must be unique. The table is as small as its configuration file."""
    ids = [r["id"] for r in rows]
    if len(ids) != len(set(ids)):
        raise ValueError("source ids must be unique")
    data = [
        (r["id"], r["name"], r["kind"], r.get("lang") or "unknown", r["url"], r.get("homepage"), r["category"], _pattern(r.get("include")))
        for r in rows
    ]
    return spark.createDataFrame(data, SCHEMA)


def include_filter(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Keeps items whose source has no rule, or whose title or summary matches it."""
    rules = sources.select("source_id", F.col("pattern").alias("_rule"))
    blob = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("summary", F.lit("")))
    kept = items.join(rules, "source_id").filter(F.col("_rule").isNull() | F.regexp_like(blob, F.col("_rule")))
    return kept.drop("_rule")
