"""Transaction outcomes: only committed work is emitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..envelope import LAYOUT, Layout
from .skew import BROADCAST_ROWS, HOT_ROWS, bounded, join_small, row_numbers, skew_join

COMMITTED, ABORTED = "COMMITTED", "ABORTED"
# Fixed value: rows from which a transaction counts as large.
LARGE_TX_ROWS = 10_000


def committed_only(
    log: DataFrame, tx: DataFrame, layout: Layout = LAYOUT, limit: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS,
    unfinished: int = BROADCAST_ROWS,
) -> DataFrame:
    """Events of committed transactions, and events outside any transaction (reads, for example).

    An event passes only if its transaction is known as committed, so one without an outcome yet is held back.
    Up to ``limit`` committed ids are broadcast. Beyond that the transactions of the log that have not committed, rolled
    back or without an outcome, are looked for by id alone and broadcast instead, so that the log itself is still read once and
    not shuffled. Where those are many too, the log meets the outcomes in a shuffle, with the rows of a huge
    transaction salted. ``log`` must be one state of its source, as a scan of files is.
    """
    done = tx.filter((F.col("status") == COMMITTED) & F.col(layout.tx).isNotNull()).select(layout.tx).distinct()
    few = bounded(done, limit)
    if few is not None:
        marked = log.join(F.broadcast(few.withColumn("__done", F.lit(True))), layout.tx, "left")
        return marked.filter(F.col("__done") | F.col(layout.tx).isNull()).select(*log.columns)
    inside = log.filter(F.col(layout.tx).isNotNull())
    held = bounded(inside.select(layout.tx).distinct().join(done, layout.tx, "left_anti"), unfinished)
    if held is not None:
        return log.join(F.broadcast(held), layout.tx, "left_anti").select(*log.columns)
    kept = skew_join(inside, done, [layout.tx], "left_semi", hot_rows=hot_rows)
    return kept.select(*log.columns).unionByName(log.filter(F.col(layout.tx).isNull()))


def rollback_leaks(emitted: DataFrame, tx: DataFrame, layout: Layout = LAYOUT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Emitted events that belong to a rolled-back transaction. Must be empty."""
    aborted = tx.filter(F.col("status") == ABORTED).select(layout.tx)
    return join_small(emitted, aborted, [layout.tx], "left_semi", hot_rows=hot_rows)


def rollback_audit(log: DataFrame, emitted: DataFrame, tx: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Per table: events of rolled-back transactions in the log, and how many of them were emitted."""
    counts = lambda df, name: rollback_leaks(df, tx, layout).groupBy(layout.table).agg(F.count(F.lit(1)).alias(name))
    logged = counts(log, "aborted_in_log").withColumn("leaked", F.lit(0).cast("long"))
    leaked = counts(emitted, "leaked").withColumn("aborted_in_log", F.lit(0).cast("long"))
    return logged.unionByName(leaked).groupBy(layout.table).agg(
        F.sum("aborted_in_log").alias("aborted_in_log"), F.sum("leaked").alias("leaked"))


def tx_order(log: DataFrame, layout: Layout = LAYOUT, **split) -> DataFrame:
    """Adds ``tx_ord``: place of an event in its transaction, from 1. Ties on position go by the place that the
    source gives, where the log has it, and then by table and key."""
    place = [layout.sub] if layout.sub in log.columns else []
    return row_numbers(log, [layout.tx], [layout.pos, *place, layout.table, layout.key], "tx_ord", **split)


def tx_summary(log: DataFrame, layout: Layout = LAYOUT, large: int = LARGE_TX_ROWS) -> DataFrame:
    return log.groupBy(layout.tx).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct(layout.table).alias("tables"),
        F.min(layout.pos).alias("first_pos"), F.max(layout.pos).alias("last_pos"),
        F.min(layout.ts).alias("begin_ts"), F.max(layout.ts).alias("end_ts"),
    ).withColumn("is_large", F.col("events") >= large)
