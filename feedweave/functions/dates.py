"""Lenient date parsing and clock predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions.text import bind, trim_ws

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS

ISO = r"^\d{4}(-\d{1,2}(-\d{1,2}([T ]\d.*)?)?)?$"
# Date texts accepted besides ISO 8601 (the weekday is removed first): shape and format.
# Each text is parsed with the one format its shape asks for.
DAY = r"^\d{1,2} [A-Za-z]{3} \d{4}"
DATE_FORMATS = (
    (DAY + r" \d\d:\d\d:\d\d [+-]\d{4}$", "d MMM yyyy HH:mm:ss xx"),
    (DAY + r" \d\d:\d\d:\d\d [A-Za-z]+$", "d MMM yyyy HH:mm:ss z"),
    (DAY + r" \d\d:\d\d [+-]\d{4}$", "d MMM yyyy HH:mm xx"),
    (DAY + r" \d\d:\d\d [A-Za-z]+$", "d MMM yyyy HH:mm z"),
    (DAY + r" \d\d:\d\d:\d\d$", "d MMM yyyy HH:mm:ss"),
    (DAY + "$", "d MMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4} \d\d:\d\d:\d\d$", "MMM d, yyyy HH:mm:ss"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d\d:\d\d:\d\d$", "yyyy/M/d HH:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
)


def parse_published(c: Column) -> Column:
    """Text to timestamp, null when no format fits; a wrong weekday is ignored."""

    def parse(t: Column) -> Column:
        out = F.when(t.rlike(ISO), F.try_to_timestamp(t))
        for shape, fmt in DATE_FORMATS:
            out = out.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(fmt)))
        return out

    return bind(F.regexp_replace(trim_ws(c), r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", ""), parse)


def to_iso(ts: Column) -> Column:
    """UTC text with milliseconds, as in the published records (session time zone UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def within_days(at: Column, days: int, now: Column) -> Column:
    """Parsable and not older than `days`; the future is kept."""
    return F.coalesce(F.unix_millis(at) >= F.unix_millis(now) - F.lit(days * DAY_MS), F.lit(False))


def is_fresh(at: Column, now: Column, hours: float = 6) -> Column:
    age = F.unix_millis(now) - F.unix_millis(at)
    return F.coalesce((age >= 0) & (age < F.lit(int(hours * HOUR_MS))), F.lit(False))
