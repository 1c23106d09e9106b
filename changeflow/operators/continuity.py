"""Gap, duplicate and order checks over sequences and positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import neighbours


def sequence_gaps(df: DataFrame, source: Sequence[str], seq: str, **split) -> DataFrame:
    """Missing ranges per source: last number before, first after, and how many are missing."""
    unique = df.select(*source, seq).distinct()
    linked = neighbours(unique, source, [seq], [seq], "__prev", **split)
    step = F.col(seq) - F.col(f"__prev.{seq}")
    return linked.filter(step > 1).select(
        *source, F.col(f"__prev.{seq}").alias("prev_seq"), F.col(seq).alias("next_seq"), (step - 1).alias("missing"))


def key_order_violations(
    df: DataFrame, key: Sequence[str], offset: str, pos: str, **split,
) -> DataFrame:
    """Messages whose position lies below that of the previous message of the same key."""
    linked = neighbours(df, key, [offset], [pos], "__prev", **split)
    return linked.withColumn("prev_pos", F.col(f"__prev.{pos}")).drop("__prev").filter(F.col(pos) < F.col("prev_pos"))


def producer_seq_check(df: DataFrame, producer: Sequence[str], seq: str, **split) -> DataFrame:
    """Numbers sent more than once, and numbers that follow a gap, per producer.

    Copies are counted before the order is looked at, so a number sent many times is one row.
    """
    counted = df.groupBy(*producer, seq).agg(F.count(F.lit(1)).alias("copies"))
    linked = neighbours(counted, producer, [seq], [seq], "__prev", **split)
    missing = F.coalesce(F.col(seq) - F.col(f"__prev.{seq}") - 1, F.lit(0))
    return linked.withColumn("missing", missing).drop("__prev").filter("copies > 1 OR missing > 0")
