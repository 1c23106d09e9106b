"""The state of rows at many positions at once: every probe finds its row as it was at its own position, in one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..envelope import LAYOUT, Layout
from .materialize import FEW_TRUNCATES, place_of
from .skew import bounded, previous_value


def state_at(
    probes: DataFrame, events: DataFrame, truncated: DataFrame, layout: Layout = LAYOUT, inclusive: bool = False,
    few_truncates: int = FEW_TRUNCATES, **split,
) -> DataFrame:
    """Adds ``was`` (image) and ``was_pos`` to probes (table, key, position, place): the row as the events before the probe left it,
    or with ``inclusive`` those at its place too. NULL where there was none, it was deleted, or its table was truncated since.

    Events and probes are merged in the order of each key; a hot key is cut into segments. ``events`` is a split log.
    """
    at = place_of(events, layout)
    marks = events.filter(F.col(layout.key).isNotNull() & (F.col(layout.op) != "t")).select(
        *layout.row_key, at.alias("__at"), F.lit(1).alias("__rank"),
        F.struct(F.col(layout.op).alias("op"), F.col(layout.after).alias("image"), at.alias("at")).alias("__mark"))
    asked = probes.withColumns({"__at": place_of(probes, layout), "__rank": F.lit(2 if inclusive else 0), "__probe": F.lit(True)})
    merged = asked.unionByName(marks, allowMissingColumns=True)
    met = previous_value(merged, layout.row_key, ["__at", "__rank"], "__mark", "__was", **split).filter("__probe").drop("__mark", "__rank")
    cut = _last_truncate(met, truncated, layout, inclusive, few_truncates, **split)
    was, gone = F.col("__was"), F.col("__cut").isNotNull() & (F.col("__cut") >= F.col("__was.at"))
    there = was.isNotNull() & (was["op"] != "d") & ~gone
    return cut.withColumns({"was": F.when(there, was["image"]), "was_pos": F.when(there, was["at"]["pos"])}).select(
        *probes.columns, "was", "was_pos")


def _last_truncate(df: DataFrame, truncated: DataFrame, layout: Layout, inclusive: bool, limit: int, **split) -> DataFrame:
    """Adds ``__cut``: the place of the last truncate of the table before ``__at``."""
    at = place_of(truncated, layout)
    few = bounded(truncated.select(layout.table, at.alias("__cut_at")), limit)
    if few is not None:
        lists = few.groupBy(layout.table).agg(F.sort_array(F.collect_set("__cut_at")).alias("__cuts"))
        earlier = F.filter("__cuts", lambda c: (c <= F.col("__at")) if inclusive else (c < F.col("__at")))
        return df.join(F.broadcast(lists), layout.table, "left").withColumn("__cut", F.try_element_at(earlier, F.lit(-1))).drop("__cuts")
    marks = truncated.select(layout.table, at.alias("__at"), F.lit(1).alias("__rank"), at.alias("__mark"))
    merged = df.withColumn("__rank", F.lit(2 if inclusive else 0)).unionByName(marks, allowMissingColumns=True)
    return previous_value(merged, [layout.table], ["__at", "__rank"], "__mark", "__cut", **split).filter(F.col("__mark").isNull()).drop("__mark", "__rank")


def before_images(updates: DataFrame, events: DataFrame, truncated: DataFrame, fields: Sequence[str], layout: Layout = LAYOUT, **split) -> DataFrame:
    """Updates of sources that deliver no before image, completed by the row as it was when they were made."""
    found = state_at(updates, events, truncated, layout, **split)
    image: Column = F.col("was")
    return found.withColumn(layout.before, F.when(image.isNotNull(), F.struct(*[image[f].alias(f) for f in fields]))).drop("was", "was_pos")
