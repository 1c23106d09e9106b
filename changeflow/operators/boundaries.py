"""Transactions by the records of their begin and end: complete ones are released, in the order of their rows.

An end record tells how many rows a transaction has, in all and by table. Rows are known by their place in it.

    COMPLETE   every place from 1 to the count was delivered, and the counts by table agree
    MISSING    fewer rows than the end record tells
    EXCESS     rows beyond the count, or in a table that the end record does not tell of
    OPEN       no end record yet
    UNKNOWN    rows without any record of their transaction

A row that was delivered more than once counts once and leaves once. A row that arrives after the end record completes its
transaction all the same, and is counted as late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..envelope import LAYOUT, Layout
from .skew import BROADCAST_ROWS, HOT_ROWS, bounded, row_numbers, skew_join

BEGIN, END = "BEGIN", "END"
COMPLETE, MISSING, EXCESS, OPEN, UNKNOWN = "COMPLETE", "MISSING", "EXCESS", "OPEN", "UNKNOWN"


def tx_verdicts(log: DataFrame, records: DataFrame, layout: Layout = LAYOUT, arrival: str = "arrival") -> DataFrame:
    """One row per transaction: verdict, rows that count, missing, repeated and late ones.

    ``log`` has the place of a row in its transaction (``layout.sub``, from 1) and its ``arrival``; ``records`` has
    transaction, kind (BEGIN or END), event_count, table_counts (array of table, n) and arrival. Rows are reduced to one for
    each place first, so a huge transaction is spread over all tasks.
    """
    tx, table, place = layout.tx, layout.table, layout.sub
    rows = log.filter(F.col(tx).isNotNull()).groupBy(tx, table, place).agg(F.count(F.lit(1)).alias("copies"), F.min(arrival).alias("first"))
    ended = records.filter(F.col("kind") == END).groupBy(tx).agg(
        F.max_by(F.struct("event_count", "table_counts", F.col(arrival).alias("at")), arrival).alias("end"))
    begun = records.filter(F.col(tx).isNotNull()).select(tx).distinct().withColumn("begun", F.lit(True))
    # Late rows need the time of the end; where ends are few they are broadcast, and otherwise the reduced rows meet them.
    times = ended.select(tx, F.col("end.at").alias("__end"))
    few = bounded(times)
    timed = rows.join(F.broadcast(few), tx, "left") if few is not None else skew_join(rows, times, [tx], "left")
    by_table = timed.groupBy(tx, table).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("copies") - 1).alias("repeated"), F.count_if(F.col("first") > F.col("__end")).alias("late"),
        F.min(place).alias("low"), F.max(place).alias("high"))
    summed = by_table.groupBy(tx).agg(
        F.sum("n").alias("rows"), F.sum("repeated").alias("repeated"), F.sum("late").alias("late"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.array_sort(F.collect_list(F.struct(F.col(table).alias("table"), "n"))).alias("counts"))
    met = begun.join(ended, tx, "left").join(summed, tx, "full")
    told = F.array_sort(F.transform("end.table_counts", lambda c: F.struct(c["table"].alias("table"), c["n"].cast("long").alias("n"))))
    count = F.coalesce(F.col("rows"), F.lit(0))
    same = F.coalesce(F.to_json("counts"), F.lit("[]")) == F.to_json(F.filter(told, lambda c: c["n"] > 0))
    verdict = (
        F.when(F.col("begun").isNull(), UNKNOWN).when(F.col("end").isNull(), OPEN)
        .when((count == F.col("end.event_count")) & same & ((count == 0) | ((F.col("low") == 1) & (F.col("high") == count))), COMPLETE)
        .when(count < F.col("end.event_count"), MISSING).otherwise(EXCESS))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return met.select(tx, verdict.alias("verdict"), zero("rows"), F.greatest(
        F.coalesce(F.col("end.event_count").cast("long"), F.lit(0)) - count, F.lit(0)).alias("missing"), zero("repeated"), zero("late"))


def release(
    log: DataFrame, verdicts: DataFrame, layout: Layout = LAYOUT, few: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS, **split,
) -> DataFrame:
    """Rows of complete transactions, once each, with ``tx_ord`` in the order of their places.

    Where few transactions are held back, their ids are broadcast and the log is not shuffled for them.
    """
    held = bounded(verdicts.filter(F.col("verdict") != COMPLETE).select(layout.tx), few)
    inside = log.filter(F.col(layout.tx).isNotNull())
    if held is not None:
        kept = inside.join(F.broadcast(held), layout.tx, "left_anti")
    else:
        kept = skew_join(inside, verdicts.filter(F.col("verdict") == COMPLETE).select(layout.tx), [layout.tx], "left_semi", hot_rows=hot_rows)
    once = kept.dropDuplicates([layout.tx, layout.table, layout.sub])
    return row_numbers(once, [layout.tx], [layout.sub, layout.table], "tx_ord", hot_rows=hot_rows, **split)
