"""Operators that turn one event into several, and the numbering that follows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..envelope import LAYOUT, Layout
from .skew import row_numbers


def split_pk_update(log: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """A key update becomes a delete of the old key (sub-order 0) and a create of the new (1).

    Where the log has a sub-order already (the place of a row in its transaction), it is doubled and
    the two halves follow each other in it. Only a small array of numbers is exploded; the images stay where they are.
    """
    moved = (F.col(layout.op) == "pk") | (F.col(layout.old_key).isNotNull() & (F.col(layout.old_key) != F.col(layout.key)))
    halves = log.withColumn("__moved", F.coalesce(moved, F.lit(False))).withColumn(
        "__half", F.explode(F.when(F.col("__moved"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    old = F.col("__moved") & (F.col("__half") == 0)
    new = F.col("__moved") & (F.col("__half") == 1)
    place = F.coalesce(F.col(layout.sub), F.lit(0)) * 2 + F.col("__half") if layout.sub in log.columns else F.col("__half")
    return halves.withColumns({
        layout.op: F.when(old, "d").when(new, "c").otherwise(F.col(layout.op)),
        layout.key: F.when(old, F.col(layout.old_key)).otherwise(F.col(layout.key)),
        layout.before: F.when(~new, F.col(layout.before)),
        layout.after: F.when(~old, F.col(layout.after)),
        layout.sub: place,
    }).drop("__moved", "__half", layout.old_key)


def delete_tombstones(events: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Follows each delete by a row with the same key and no value (``tombstone`` true).

    Sub-orders are doubled to make room, so the tombstone directly follows its delete.
    """
    marks = F.when(F.col(layout.op) == "d", F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    out = events.withColumn("tombstone", F.explode(marks))
    dead = F.col("tombstone")
    return out.withColumns({
        layout.sub: F.col(layout.sub) * 2 + dead.cast("int"),
        layout.before: F.when(~dead, F.col(layout.before)),
        layout.after: F.when(~dead, F.col(layout.after)),
    })


def drop_tombstones(messages: DataFrame, drop: bool = True) -> DataFrame:
    return messages.filter(~F.col("tombstone")) if drop else messages


def assign_offsets(
    messages: DataFrame, topic: str = "topic", partition: str = "partition", layout: Layout = LAYOUT,
    first: int = 0, **split,
) -> DataFrame:
    """Adds ``offset``, dense per topic partition in commit order.

    A topic has few partitions, so each is numbered in segments once it outgrows one task.
    """
    numbered = row_numbers(messages, [topic, partition], [layout.pos, layout.sub], "offset", **split)
    return numbered.withColumn("offset", F.col("offset") + F.lit(first - 1))
