"""Neighbours, positions and running values in groups of any size.

A plain window over a group runs in one task. Here rows are range-partitioned
by (group, order), so a big group is cut into pieces that each fit one task;
windows run inside the pieces, and a small table with one row per piece carries
values across the cuts. The pieces are checkpointed, because range cuts are
sampled and must not change between the two uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweave.session import checkpoint

ROW = "_row"
PIECE = "_piece"


def pieces(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Adds the global row order (_row) and the piece number (_piece)."""
    keys = [F.col(g) for g in group] + order
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = ranged.withColumn(ROW, F.monotonically_increasing_id())
    return checkpoint(ranged.withColumn(PIECE, F.shiftright(ROW, 33)))


def _carry(df: DataFrame, group: list[str], per_piece: list[Column], over: dict[str, Column]) -> DataFrame:
    """One row per (group, piece) with values taken from the other pieces of the group."""
    table = df.groupBy(*group, PIECE).agg(*per_piece)
    return table.select(*group, PIECE, *[c.alias(name) for name, c in over.items()])


def _within(group: list[str]):
    return Window.partitionBy(*group, PIECE).orderBy(ROW)


def _across(group: list[str]):
    return Window.partitionBy(*group).orderBy(PIECE)


def neighbours(df: DataFrame, group: list[str], fields: list[str], before: str | None = None, after: str | None = None) -> DataFrame:
    """Struct of `fields` of the previous row (`before`) and / or next row (`after`).

    `df` comes from pieces(); null at the ends of a group.
    """
    row = F.struct(*fields)
    parts = [F.max_by(row, ROW).alias("_last"), F.min_by(row, ROW).alias("_first")]
    over = {
        "_left": F.lag("_last").over(_across(group)),
        "_right": F.lead("_first").over(_across(group)),
    }
    out = df.join(_carry(df, group, parts, over), [*group, PIECE])
    if before:
        out = out.withColumn(before, F.coalesce(F.lag(row).over(_within(group)), "_left"))
    if after:
        out = out.withColumn(after, F.coalesce(F.lead(row).over(_within(group)), "_right"))
    return out.drop("_left", "_right")


def positions(df: DataFrame, group: list[str], name: str = "pos") -> DataFrame:
    """0-based position of each row of pieces() within its group."""
    earlier = _across(group).rowsBetween(Window.unboundedPreceding, -1)
    over = {"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0))}
    table = _carry(df, group, [F.count(F.lit(1)).alias("_n")], over)
    out = df.join(table, [*group, PIECE])
    return out.withColumn(name, F.col("_before") + F.row_number().over(_within(group)) - 1).drop("_before")


def running(df: DataFrame, group: list[str], specs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running sum / min / max from the group's first row to the current one.

    specs: output name -> ("sum" | "min" | "max", column).
    """
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    merge = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "min": F.least,
        "max": F.greatest,
    }
    earlier = _across(group).rowsBetween(Window.unboundedPreceding, -1)
    to_here = _within(group).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = [kinds[k](c).alias(f"_p_{n}") for n, (k, c) in specs.items()]
    over = {f"_c_{n}": kinds[k](f"_p_{n}").over(earlier) for n, (k, _) in specs.items()}
    out = df.join(_carry(df, group, parts, over), [*group, PIECE])
    for n, (k, c) in specs.items():
        out = out.withColumn(n, merge[k](kinds[k](c).over(to_here), F.col(f"_c_{n}")))
    return out.drop(*over)
