"""Lookups that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000  # at most this many keys are broadcast, so the broadcast size is fixed
SALTS = 64


def lookup_by_key(left: DataFrame, table: DataFrame, key: str, weight: str, spread: str) -> DataFrame:
    """Left join with a table of one row per key, whose `weight` is the key's row count in `left`.

    The HOT_KEYS heaviest keys are answered from a broadcast of that fixed
    size. Their rows are spread over the cluster by `spread` and find nothing
    in the shuffled join, which serves all other keys; no other key can hold
    more than 1/HOT_KEYS of the rows.
    """
    values = [c for c in table.columns if c != key]
    packed = table.select(key, F.col(weight).alias("_w"), F.struct(*values).alias("_value"))
    hot = packed.orderBy(F.col("_w").desc(), F.col(key)).limit(HOT_KEYS).select(key, F.col("_value").alias("_hot"))
    spread_out = F.pmod(F.xxhash64(spread), F.lit(SALTS)) + 1
    marked = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(spread_out).cast("long")
    )
    # Always 0, but not a constant: a constant would be folded away and the join dealt by the key alone.
    zero = F.pmod(F.col("_w"), F.lit(1)).cast("long")
    cold = packed.select(key, zero.alias("_salt"), F.col("_value").alias("_cold"))
    joined = marked.join(cold, [key, "_salt"], "left").withColumn("_value", F.coalesce("_hot", "_cold"))
    return joined.select(*left.columns, *[F.col(f"_value.{v}").alias(v) for v in values])
