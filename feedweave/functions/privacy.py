"""Redaction of messages, stacks and event payloads."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedweave.functions.text import WS, clamp, collapse, trim_ws

IN_URL = WS[:-1] + ")]"  # characters that end a URL inside text
BARE = "[^" + WS[1:-1] + ")?#]"


def _strip_queries(c: Column) -> Column:
    start = r"(?<![0-9A-Za-z_])(https?://" + BARE + "+)"
    cut = F.regexp_replace(c, start + "[?#][^" + WS[1:-1] + ")]*", "$1")
    host_only = r"(?<![0-9A-Za-z_])(https?://[^" + WS[1:-1] + r")/?#]+)(?=" + IN_URL + "|$)"
    return F.regexp_replace(cut, host_only, "$1/")


def redact_text(c: Column, n: int = 220) -> Column:
    """One line, URLs without query and fragment, at most n characters."""
    return clamp(collapse(_strip_queries(F.coalesce(c, F.lit("")))), n)


def redact_stack(c: Column, n: int = 900) -> Column:
    text = trim_ws(_strip_queries(c))
    return F.when(text != "", clamp(text, n))


def error_key(kind: Column, message: Column, stack: Column) -> Column:
    first_line = F.split(F.coalesce(stack, F.lit("")), "\n", 2)[0]
    return F.concat(kind, F.lit(":"), redact_text(message, 160), F.lit(":"), redact_text(first_line, 120))


# Key names that hide their value.
SENSITIVE = ("token", "secret", "password", "passwd", "authorization", "cookie", "api_key", "apikey")


@dataclass(frozen=True)
class PayloadLimits:
    """Bounds on a payload; None is no bound."""

    depth: int | None = None
    keys: int | None = None
    items: int | None = None
    text: int | None = None


def _clean_text(text: str, most: int | None) -> str:
    s = text.strip()
    s = s if most is None or len(s) <= most else s[: most - 1] + "…"
    if "://" not in s and not s.startswith("/"):
        return s
    s = re.split(r"[?#]", s, maxsplit=1)[0]
    return s + "/" if re.fullmatch(r"(?i)https?://[^/\s]+", s) else s


def _clean(value, depth: int, limits: PayloadLimits):
    if isinstance(value, str):
        return _clean_text(value, limits.text)
    if isinstance(value, (list, dict)) and limits.depth is not None and depth >= limits.depth:
        return "[max_depth]"
    if isinstance(value, list):
        return [_clean(v, depth + 1, limits) for v in value[: limits.items]]
    if isinstance(value, dict):
        hidden = {k for k in value if any(word in k.lower() for word in SENSITIVE)}
        return {
            k: "[redacted]" if k in hidden else _clean(value[k], depth + 1, limits) for k in list(value)[: limits.keys]
        }
    return value


def _clean_json(raw: str | None, limits: PayloadLimits) -> str | None:
    try:
        value = json.loads(raw) if raw else None
    except ValueError:
        return None
    cleaned = _clean(value, 0, limits) if isinstance(value, dict) else None
    return json.dumps(cleaned, ensure_ascii=False, separators=(",", ":")) if cleaned else None


def sanitize_payload(c: Column, limits: PayloadLimits = PayloadLimits()) -> Column:
    """JSON object text with secrets hidden and sizes within `limits`; null for anything else. Parsed in Arrow batches."""

    @F.pandas_udf(StringType())
    def parsed(payload: pd.Series) -> pd.Series:
        return payload.map(lambda raw: _clean_json(raw, limits), na_action="ignore").astype("object")

    return parsed(c)
