"""Stateful processors: transactions held until they end, and snapshot windows opened and closed by the log itself.

Rows travel through the state as JSON text, so that one processor serves every schema. Both work on event time: state
leaves with the watermark, on a commit, or on the close of a window, and never waits for more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..envelope import EVENT_TYPES, LAYOUT, Layout
from ..operators.commit import ABORTED, COMMITTED
from ..operators.snapshot import CLOSE, OPEN

EXPIRED, PASSED = "EXPIRED", "PASSED"
CHANGE, READ = "change", "read"
SALTS = 4
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
BUCKETS = 4096
_TOGETHER = 1000  # rows of one transaction that go to the state in one call


def _milliseconds(interval: str) -> int:
    from pyspark.sql import SparkSession
    row = SparkSession.active().sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {interval})").first()
    return row[0]


class TransactionBuffer(StatefulProcessor):
    """Keeps the events of transactions until they end: a commit lets them go, a rollback removes them, and an end that
    does not come lets them go as expired. An outcome is remembered as long as its events may be late.

    A key is a bucket of transactions: every call to the state is a message to the JVM, so a transaction that begins and ends in
    one micro-batch makes none of its own. One text holds what is open and what has ended (``held``: first event and number of
    stored parts, ``done``: status and when it is forgotten); rows of transactions that stay open are stored by transaction.
    """

    def __init__(self, max_open_ms: int, delay_ms: int):
        self.max_open, self.delay = max_open_ms, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.index = handle.getValueState("index", "held_done string")
        self.events = handle.getMapState("events", "tx string, part int", "rows array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held, done = self._read()
        ended: dict[str, int] = {}
        waiting: dict[str, list[str]] = {}
        changed = False
        for r in rows:
            tx = r.tx
            if tx is None:
                continue
            if r.status is not None:
                ended[tx] = max(r.at, ended.get(tx, r.at))
                done[tx] = [r.status, 0]
            elif tx not in done:
                kept, now = waiting.setdefault(tx, []), held.setdefault(tx, [r.at, 0])
                kept.append(r.row)
                now[0], changed = min(now[0], r.at), True
                if len(kept) == _TOGETHER:
                    self._store(held, tx, waiting.pop(tx))
            elif done[tx][0] == COMMITTED:
                yield Row(row=r.row, settled=COMMITTED)
        # The outcome has come: what was kept leaves, or is forgotten.
        for tx, end in ended.items():
            status = done[tx][0]
            done[tx] = [status, end + self.delay]
            parts = held.pop(tx, (0, 0))[1]
            if status == COMMITTED:
                for part in range(parts):
                    for row in self.events.getValue((tx, part))[0]:
                        yield Row(row=row, settled=status)
                for row in waiting.get(tx, ()):
                    yield Row(row=row, settled=status)
            for part in range(parts):
                self.events.removeKey((tx, part))
            waiting.pop(tx, None)
        for tx, kept in waiting.items():
            self._store(held, tx, kept)
        if changed or ended:
            self._write(held, done)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        held, done = self._read()
        if not held and not done:
            return
        # One timer stands for all that the watermark has passed.
        at, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        due = lambda when: when <= at or when < passed
        for tx in [tx for tx, (first, _) in held.items() if due(first + self.max_open)]:
            for part in range(held.pop(tx)[1]):
                for row in self.events.getValue((tx, part))[0]:
                    yield Row(row=row, settled=EXPIRED)
                self.events.removeKey((tx, part))
        self._write(held, {tx: kept for tx, kept in done.items() if not due(kept[1])})

    def _read(self) -> tuple[dict[str, list], dict[str, list]]:
        known = self.index.get()
        return tuple(json.loads(known[0])) if known else ({}, {})

    def _write(self, held: dict[str, list], done: dict[str, list]) -> None:
        if held or done:
            self.index.update((json.dumps([held, done]),))
            self.handle.registerTimer(min([first + self.max_open for first, _ in held.values()] + [until for _, until in done.values()]))
        else:
            self.index.clear()

    def _store(self, held: dict[str, list], tx: str, rows: list[str]) -> None:
        self.events.updateValue((tx, held[tx][1]), (rows,))
        held[tx][1] += 1

    def close(self) -> None:
        pass


def buffered_stream(
    events: DataFrame, outcomes: DataFrame, event_ts: str, outcome_ts: str, delay: str, max_open: str,
    layout: Layout = LAYOUT, salts: int = SALTS, buckets: int = BUCKETS,
) -> DataFrame:
    """Events with ``settled``: COMMITTED once their transaction has committed, EXPIRED where no outcome came within
    ``max_open``, PASSED where they belong to none. Rolled-back events leave the state with the rollback and never come out.

    The salt spreads a huge transaction over several state keys; its outcome goes to each of them. A state key is one of
    ``buckets`` groups of transactions, a number fixed for the life of a checkpoint.
    """
    inside, outside = events.filter(F.col(layout.tx).isNotNull()), events.filter(F.col(layout.tx).isNull())
    schema = events.schema
    left = inside.withWatermark(event_ts, delay).select(
        F.col(layout.tx).alias("tx"), F.pmod(F.xxhash64(layout.table, layout.pos), F.lit(salts)).cast("int").alias("salt"),
        F.col(event_ts).alias("ts"), F.unix_millis(event_ts).alias("at"), F.to_json(F.struct(*events.columns), _JSON).alias("row"),
        F.lit(None).cast("string").alias("status"))
    ended = outcomes.filter(F.col("status").isin(COMMITTED, ABORTED)).withWatermark(outcome_ts, delay)
    right = ended.select(
        F.col(layout.tx).alias("tx"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col(outcome_ts).alias("ts"),
        F.unix_millis(outcome_ts).alias("at"), F.lit(None).cast("string").alias("row"), F.col("status"))
    both = left.unionByName(right)
    keyed = both.withColumns({"bucket": F.pmod(F.xxhash64("tx", "salt"), F.lit(buckets)).cast("int"), "tx": F.col("tx").cast("string")}).drop("salt")
    settled = keyed.groupBy("bucket").transformWithState(
        TransactionBuffer(_milliseconds(max_open), _milliseconds(delay)), "row string, settled string", "append", "eventTime")
    rows = settled.select(F.from_json("row", schema, _JSON).alias("r"), "settled").select("r.*", "settled")
    return rows.unionByName(outside.withColumn("settled", F.lit(PASSED)))


class ChunkWindows(StatefulProcessor):
    """One chunk of an incremental snapshot. Its window opens and closes by signals in the log; when the watermark has passed
    the close, the rows that were read for it and not changed inside it come out.

    Signals, changes and reads may come in any order within the watermark delay. Of a key's changes that the watermark has
    passed, only the first one after the opening is kept, and none without an open window.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getMapState("opened", "low long", "seen boolean")
        self.changes = handle.getMapState("changes", "key string", "at array<bigint>")
        self.reads = handle.getMapState("reads", "low long, key string", "row string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        changed: dict[str, set[int]] = {}
        for r in rows:
            if r.kind == OPEN:
                if not self.opened.containsKey((r.pos,)):
                    self.opened.updateValue((r.pos,), (True,))
                    yield Row(chunk=key[0], low=r.pos, high=None, key=None, row=None)
            elif r.kind == CLOSE:
                self.handle.registerTimer(r.pos)
            elif r.kind == READ:
                self.reads.updateValue((r.low, r.key), (r.row,))
            else:
                changed.setdefault(r.key, set()).add(r.pos)
        if not changed:
            return
        lows = sorted(k[0] for k in self.opened.keys())
        passed = timerValues.getCurrentWatermarkInMs()
        for name, at in changed.items():
            if self.changes.containsKey((name,)):
                at |= set(self.changes.getValue((name,))[0])
            self._keep(name, at, lows, passed)

    def _keep(self, name: str, at: set[int], lows: list[int], passed: int) -> None:
        """Stores what a window may still ask about: the first change after each opening, and all beyond the watermark."""
        kept = {min((p for p in at if p > low), default=None) for low in lows} | {p for p in at if p > passed}
        kept.discard(None)
        if kept:
            self.changes.updateValue((name,), (sorted(kept),))
        elif self.changes.containsKey((name,)):
            self.changes.removeKey((name,))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        high = expiredTimerInfo.getExpiryTimeInMs()
        lows = sorted(k[0] for k in self.opened.keys())
        low = max((p for p in lows if p < high), default=None)
        changes = {k[0]: set(v[0]) for k, v in self.changes.iterator()} if self.changes.exists() else {}
        if low is not None:
            held = [(k, v[0]) for k, v in self.reads.iterator()]
            for (read_for, name), row in held:
                if read_for == low and not any(low < p < high for p in changes.get(name, ())):
                    yield Row(chunk=key[0], low=low, high=high, key=name, row=row)
            for k, _ in held:
                if k[0] <= low:
                    self.reads.removeKey(k)
            for p in lows:
                if p <= low:
                    self.opened.removeKey((p,))
        left = [p for p in lows if low is None or p > low]
        for name, at in changes.items():
            self._keep(name, at, left, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def snapshot_stream(
    log: DataFrame, signals: DataFrame, reads: DataFrame, chunk_of: Column, fields: list[str], delay: int,
    key: str = "key_id", pos: str = "pos", chunk: str = "chunk_id",
) -> DataFrame:
    """Rows ``chunk, low, high, key, fields`` of closed windows, and one row without a key for each opening.

    All three are streams: the log (key, position), the signals of ``snapshot_windows`` (chunk, type, position), and the rows
    read for a chunk (chunk, key, fields, the position ``low`` of the opening they were read for, and the position
    reached when they were read). Positions are the event time, a position a millisecond, and ``delay`` is how many of them rows may
    be out of order. A key belongs to the chunk that ``chunk_of`` gives.
    """
    when = F.timestamp_millis(F.col(pos))
    none = lambda kind: F.lit(None).cast(kind)
    parts = [
        log.filter(F.col(key).isNotNull()).select(
            chunk_of.alias("chunk"), F.lit(CHANGE).alias("kind"), F.col(key).cast("string").alias("key"), F.col(pos).alias("pos"),
            none("long").alias("low"), none("string").alias("row"), when.alias("ts")),
        signals.select(F.col(chunk).alias("chunk"), F.col("type").alias("kind"), none("string").alias("key"), F.col(pos).alias("pos"),
                       none("long").alias("low"), none("string").alias("row"), when.alias("ts")),
        reads.select(F.col(chunk).alias("chunk"), F.lit(READ).alias("kind"), F.col(key).cast("string").alias("key"), F.col(pos).alias("pos"),
                     F.col("low"), F.to_json(F.struct(key, *fields), _JSON).alias("row"), when.alias("ts"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).withWatermark("ts", f"{delay} milliseconds")
    out = rows.groupBy("chunk").transformWithState(ChunkWindows(), "chunk long, low long, high long, key string, row string", "append", "eventTime")
    held = reads.select(key, *fields).schema
    return out.select(F.col("chunk").alias(chunk), "low", "high", F.from_json("row", held, _JSON).alias("r")).select(chunk, "low", "high", "r.*")


def window_reads(rows: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """READ events of what ``snapshot_stream`` has written: of each chunk its newest window, if that is closed."""
    newest = rows.groupBy(chunk).agg(F.max("low").alias("low"))
    return rows.filter("high IS NOT NULL").join(newest, [chunk, "low"], "left_semi").drop("high").withColumns({
        "op": F.lit("r"), "event_type": F.lit(EVENT_TYPES["r"])})
