"""Initial and incremental snapshots reconciled with the log between two watermarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..envelope import EVENT_TYPES
from .skew import HOT_ROWS, join_small, row_numbers, skew_join

# Rows per chunk and the names of the signal types.
CHUNK_ROWS = 1024
OPEN, CLOSE, EXECUTE = "snapshot-window-open", "snapshot-window-close", "execute-snapshot"

SIGNAL_DATA = "struct<`data-collections`:array<string>,type:string,`additional-condition`:string>"


def snapshot_initial(rows: DataFrame, key: str, fields: Sequence[str], tbl: str) -> DataFrame:
    """Rows of a table as READ events."""
    return rows.select(
        F.lit(tbl).alias("tbl"), F.lit("r").alias("op"), F.lit(EVENT_TYPES["r"]).alias("event_type"),
        F.col(key).alias("key_id"), F.struct(*fields).alias("after"), F.lit(True).alias("snapshot"))


def snapshot_condition(rows: DataFrame, condition: str | None) -> DataFrame:
    """Applies the row condition of a snapshot request (trusted SQL text); empty means all rows."""
    return rows.filter(F.expr(condition)) if condition and condition.strip() else rows


def parse_signals(signals: DataFrame) -> DataFrame:
    """Signal rows ``id, type, data`` with one row per requested collection."""
    doc = F.from_json("data", SIGNAL_DATA)
    condition = doc["additional-condition"]
    return signals.select(
        "id", "type", doc["type"].alias("snapshot_type"),
        F.explode_outer(doc["data-collections"]).alias("collection"),
        F.when(condition != "", condition).alias("condition"))


def snapshot_signal(collections: Column, condition: Column, signal_id: Column) -> Column:
    """Signal row that asks for an incremental snapshot."""
    data = F.to_json(F.struct(
        collections.alias("data-collections"), F.lit("incremental").alias("type"),
        F.coalesce(condition, F.lit("")).alias("additional-condition")))
    return F.struct(signal_id.alias("id"), F.lit(EXECUTE).alias("type"), data.alias("data"))


def snapshot_windows(signals: DataFrame) -> DataFrame:
    """The last window of each ``chunk_id``: its opening, and the close that follows it.

    A window without a close after its opening is still open (``high`` is NULL), also when an earlier
    window of the chunk was closed.
    """
    low = F.max(F.when(F.col("type") == OPEN, F.col("pos")))
    close = F.max(F.when(F.col("type") == CLOSE, F.col("pos")))
    return signals.groupBy("chunk_id").agg(low.alias("low"), close.alias("close")).filter(F.col("low").isNotNull()).select(
        "chunk_id", "low", F.when(F.col("close") > F.col("low"), F.col("close")).alias("high"))


def chunk_number(key: str | Column, chunk_rows: int = CHUNK_ROWS) -> Column:
    """Chunk of an integer key, in whole numbers; keys below zero have chunks below zero."""
    key = F.col(key) if isinstance(key, str) else key
    size = F.lit(chunk_rows).cast("long")
    return F.call_function("div", key - F.pmod(key, size), size)


def chunk_plan(rows: DataFrame, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunks of equal key range: bounds and row count. No sort, one partial aggregation."""
    chunk = chunk_number(key, chunk_rows)
    return rows.groupBy(chunk.alias("chunk_id")).agg(
        F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count(F.lit(1)).alias("rows"),
    ).withColumns({
        "low_key": F.col("chunk_id") * chunk_rows, "high_key": (F.col("chunk_id") + 1) * chunk_rows})


def chunk_plan_exact(rows: DataFrame, key: str, chunk_rows: int = CHUNK_ROWS, **split) -> DataFrame:
    """Chunks of exactly ``chunk_rows`` rows in key order; the key must be unique and numeric."""
    numbered = row_numbers(rows.select(key), [], [key], "rn", **split)
    return numbered.groupBy(chunk_number(F.col("rn") - 1, chunk_rows).alias("chunk_id")).agg(
        F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count(F.lit(1)).alias("rows"))


def superseded_keys(
    chunk_rows: DataFrame, log: DataFrame, windows: DataFrame, key: str = "key_id", pos: str = "pos",
    chunk: str = "chunk_id", chunk_of: Column | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Distinct (chunk, key) that the log changed inside the window of the chunk holding the key.

    An event matters only to the chunk of its key, so the log meets the windows on the chunk and no
    range join is planned. ``chunk_of`` computes the chunk from the key of a log event (key-range
    plans); without it the chunk is looked up in ``chunk_rows``. A hot key or chunk of the log is
    salted. The outer bounds of all windows reach the scan of the log as literals. Pass a log split
    at key updates, so that both keys count as changed.
    """
    span = windows.agg(F.min("low").alias("low"), F.max(F.coalesce("high", F.lit(2**63 - 1))).alias("high")).first()
    if span["low"] is None:
        return chunk_rows.select(chunk, key).limit(0)
    events = log.filter(F.col(key).isNotNull() & (F.col(pos) > span["low"]) & (F.col(pos) < span["high"]))
    if chunk_of is None:
        events = skew_join(events.select(key, pos), chunk_rows.select(chunk, key), [key], hot_rows=hot_rows)
    else:
        events = events.select(chunk_of.alias(chunk), key, pos)
    hits = join_small(events, windows.select(chunk, "low", "high"), [chunk], hot_rows=hot_rows)
    inside = (F.col(pos) > F.col("low")) & (F.col("high").isNull() | (F.col(pos) < F.col("high")))
    return hits.filter(inside).select(chunk, key).distinct()


def dblog_reconcile(
    chunk_rows: DataFrame, log: DataFrame, windows: DataFrame, key: str = "key_id", pos: str = "pos",
    chunk: str = "chunk_id", chunk_of: Column | None = None, stamp: bool = False, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Chunk rows to emit as READ events: those the log did not touch while the chunk was read.

    Only chunks with a closed window are emitted; rows of a chunk that has no window yet, or whose
    window is open, are pending. ``stamp`` adds the position of the opening watermark, so that reads and log can be applied
    together: later events win, and a truncate inside the window removes the reads.
    """
    closed = windows.filter(F.col("high").isNotNull())
    changed = superseded_keys(chunk_rows, log, closed, key, pos, chunk, chunk_of, hot_rows)
    reads = chunk_rows.join(changed, [chunk, key], "left_anti").withColumns({
        "op": F.lit("r"), "event_type": F.lit(EVENT_TYPES["r"])})
    stamped = join_small(reads, closed.select(chunk, F.col("low").alias("__low")), [chunk], hot_rows=hot_rows)
    return stamped.withColumnRenamed("__low", pos) if stamp else stamped.drop("__low")


def merge_snapshot(reads: DataFrame, log: DataFrame) -> DataFrame:
    """Snapshot rows together with the log."""
    return reads.unionByName(log, allowMissingColumns=True)


def snapshot_progress(plan: DataFrame, done: DataFrame, seconds: str = "seconds") -> DataFrame:
    """Share of chunks finished and rows per second, in one row."""
    marked = plan.join(done.select("chunk_id", seconds), "chunk_id", "left")
    finished = F.col(seconds).isNotNull()
    return marked.agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(finished).alias("chunks_done"),
        F.sum(F.when(finished, F.col("rows")).otherwise(0)).alias("rows_done"), F.sum(seconds).alias("elapsed"),
    ).select(
        "chunks", "chunks_done", "rows_done",
        F.round(F.col("chunks_done") * 100 / F.col("chunks"), 2).alias("percent"),
        F.round(F.col("rows_done") / F.col("elapsed"), 2).alias("rows_per_second"))
