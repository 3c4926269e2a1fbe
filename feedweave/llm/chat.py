"""Conversation logs folded into messages and rendered with a template, in column expressions only.

A log is a table of events (conv_id, turn, n, seq, kind, role, text). Events of one (conv_id, turn, n) make one
message; seq orders them:
  open        starts the message anew with a role, and its text if given
  delta       adds a streamed piece of text
  edit        puts another text in place of all before
  regenerate  discards the text so far; later deltas write it again
Messages are ordered by (turn, n). They are rendered in parts of PART_TURNS turn numbers; the parts of a conversation,
in order, are its text. Messages that share a turn number, or have none, are in one part. digests() gathers the parts of
a conversation in one row to hash them, so the text of a conversation has to stay under the 2 GB of one row.

Escaping makes every control string impossible inside a text: texts hold no `<` and no `[` afterwards, and all
control strings begin with one of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART_TURNS = 256
RESETS = ("open", "edit", "regenerate")
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


@dataclass(frozen=True)
class Template:
    """Control strings around the text of a turn, by role; other roles are named in the text."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    named: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    learned: str = "assistant"  # the role whose text the loss is taken on

    def __post_init__(self):
        for mark in (*(m for pair in self.marks.values() for m in pair), *self.named):
            if mark[:1] not in ("<", "["):
                raise ValueError(f"a control string starts with < or [, not {mark!r}")

    def opening(self, role: Column) -> Column:
        out = F.concat(F.lit(self.named[0]), escape(role), F.lit(self.named[1]))
        for name, (mark, _) in self.marks.items():
            out = F.when(role == name, F.lit(mark)).otherwise(out)
        return out

    def closing(self, role: Column) -> Column:
        out = F.lit(self.named[2])
        for name, (_, mark) in self.marks.items():
            out = F.when(role == name, F.lit(mark)).otherwise(out)
        return out

    def turn_pattern(self) -> str:
        """Groups: the opening, the escaped text."""
        plain = r"[^<\[]*"
        openings = [_quoted(m) for m, _ in self.marks.values()] + [_quoted(self.named[0]) + plain + _quoted(self.named[1])]
        closings = [_quoted(m) for _, m in self.marks.values()] + [_quoted(self.named[2])]
        return f"({'|'.join(openings)})({plain})(?:{'|'.join(closings)})"


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """The final messages: conv_id, turn, n, role, text.

    A null kind opens, a null text is empty, a null role leaves the role as it is ('' if never given). Events
    with equal seq count in the order of (kind, role, text); a repeated delta repeats its text, as nothing tells
    it from a new one. Null conv_id or turn are values like others, first in order. An empty log gives no message.
    """
    event = F.struct(
        "seq", F.coalesce("kind", F.lit("open")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    log = F.array_sort(F.collect_list(event))  # the events of one message
    last_reset = F.coalesce(
        F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin(*RESETS), i))), F.lit(0)
    )
    texts = F.filter(F.slice("log", F.col("since") + 1, F.greatest(F.size("log") - F.col("since"), F.lit(0))), lambda e: e["kind"] != "regenerate")
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return (
        events.groupBy("conv_id", "turn", "n").agg(log.alias("log"))
        .withColumn("since", last_reset)
        .select(
            "conv_id", "turn", "n",
            F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
            F.array_join(F.transform(texts, lambda e: e["text"]), "").alias("text"),
        )
    )


def render(messages: DataFrame, template: Template = Template(), part_turns: int = PART_TURNS) -> DataFrame:
    """Rows (conv_id, part, n_turns, formatted, loss_spans): spans (start, length) in code points of `formatted`."""
    turn = F.struct("turn", "n", "role", "text")
    lengths = F.transform(
        "turns",
        lambda t: F.struct(
            F.length(template.opening(t["role"])).alias("open"), F.length(escape(t["text"])).alias("text"), F.length(template.closing(t["role"])).alias("close"), t["role"].alias("role")
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, length: int>>)").alias("spans"))
    spans = F.aggregate(
        lengths,
        start,
        lambda s, x: F.struct(
            (s["at"] + x["open"] + x["text"] + x["close"]).alias("at"),
            F.when(
                x["role"] == template.learned,
                F.concat(s["spans"], F.array(F.struct((s["at"] + x["open"]).alias("start"), x["text"].alias("length")))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    rendered = F.transform("turns", lambda t: F.concat(template.opening(t["role"]), escape(t["text"]), template.closing(t["role"])))
    return (
        messages.withColumn("part", F.floor(F.col("turn") / part_turns).cast("long"))
        .groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns"))  # part_turns turn numbers at most
        .select("conv_id", "part", F.size("turns").cast("long").alias("n_turns"), F.array_join(rendered, "").alias("formatted"), spans.alias("loss_spans"))
    )


def read_back(parts: DataFrame, template: Template = Template()) -> DataFrame:
    """Rows (conv_id, part, turns array<struct<role, text>>, loss) from the rendered text and the loss mask alone."""
    pattern = F.lit(template.turn_pattern())
    openings, texts = (F.regexp_extract_all("formatted", pattern, F.lit(g)) for g in (1, 2))
    def turn(o: Column, t: Column) -> Column:
        role = unescape(F.substring(o, F.lit(len(template.named[0]) + 1), F.length(o) - (len(template.named[0]) + len(template.named[1]))))
        for name, (mark, _) in template.marks.items():
            role = F.when(o == mark, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescape(t).alias("text"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"]))), "")
    return parts.select("conv_id", "part", F.zip_with(openings, texts, turn).alias("turns"), loss.alias("loss"), F.length("formatted").alias("chars"))


def events_of_rows(rows: DataFrame) -> DataFrame:
    """A table of whole turns (conv_id, turn, role, text) as the log that a stream of them leaves: open, then a delta."""
    numbered = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "n", F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text"))
    )
    none = F.lit(None).cast("string")
    both = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("open").alias("kind"), F.col("role"), none.alias("text")),
        F.struct(F.lit(1).alias("seq"), F.lit("delta").alias("kind"), none.alias("role"), F.col("text")),
    )
    return numbered.select("conv_id", "turn", "n", F.inline(both))


def digests(rows: DataFrame, template: Template = Template(), part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the rendered parts.

    Rows of a conversation are taken by turn, equal ones by (role, text). Null text and role are empty.
    """
    back = read_back(render(fold_events(events_of_rows(rows)), template, part_turns), template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = back.select("conv_id", "part", F.size("turns").cast("long").alias("n"), said.alias("said"), "loss", "chars")
    whole = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "")
    return (
        parts.groupBy("conv_id")
        .agg(F.sum("n").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("part", "said", "loss"))).alias("parts"))
        .select(
            "conv_id", "n_turns", F.sha2(whole("said").cast("binary"), 256).alias("turns_sha256"),
            F.length(whole("loss")).cast("long").alias("loss_chars"), F.sha2(whole("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
        )
    )
