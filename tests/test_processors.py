"""Stateful processors over several micro-batches: disorder, reopened windows, rollbacks, expiry, and state that goes away."""

import pytest
from pyspark.sql import functions as F

from changeflow.operators import snapshot
from changeflow.session import work_path
from changeflow.sources import readers
from changeflow.streaming import jobs, processors

LOG = "key_id long, pos long"
SIGNALS = "chunk_id long, type string, pos long"
READS = "chunk_id long, key_id long, status string, low long, pos long"


def deliver(spark, build, schemas, batches, out_schema=None):
    """Runs ``build`` over streams that get one batch of files after the other; returns the rows written and the last query."""
    topics = [work_path(spark, "topic") for _ in schemas]
    out, ck, query = work_path(spark, "out"), work_path(spark, "ck"), None
    for batch in batches:
        for topic, schema, rows in zip(topics, schemas, batch, strict=True):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(topic)
        made = build(*[readers.stream_changes(spark, t, spark.createDataFrame([], s).schema) for t, s in zip(topics, schemas, strict=True)])

        def start(made=made):
            nonlocal query
            query = jobs.append_files(made, out, ck)
            return query
        jobs.run_stateful(spark, start, partitions=2)
    return spark.read.schema(made.schema).parquet(out), query


def windows_of(spark, batches):
    build = lambda log, signals, reads: processors.snapshot_stream(log, signals, reads, snapshot.chunk_number("key_id", 10), ["status"], delay=100)
    rows, _ = deliver(spark, build, (LOG, SIGNALS, READS), batches)
    return {(r["chunk_id"], r["key_id"], r["low"]) for r in processors.window_reads(rows).collect()}


def reconciled(spark, batches):
    log, signals, reads = ([r for b in batches for r in b[i]] for i in range(3))
    windows = snapshot.snapshot_windows(spark.createDataFrame(signals, SIGNALS))
    chunk_rows = spark.createDataFrame(reads, READS).join(windows.select("chunk_id", "low"), ["chunk_id", "low"], "left_semi").select("chunk_id", "key_id", "status")
    rows = snapshot.dblog_reconcile(chunk_rows, spark.createDataFrame(log, LOG), windows, chunk_of=snapshot.chunk_number("key_id", 10), stamp=True)
    return {(r["chunk_id"], r["key_id"], r["pos"]) for r in rows.collect()}


def reads_of(chunk, low, pos, keys=range(10)):
    return [(chunk, chunk * 10 + k, "s", low, pos) for k in keys]


def test_windows_in_one_batch(spark):
    batches = [([(1, 1000), (2, 1011), (3, 1050), (4, 1060), (12, 1020), (1, 5000)], [(0, snapshot.OPEN, 1010), (0, snapshot.CLOSE, 1055)], reads_of(0, 1010, 1030))]
    got = windows_of(spark, batches)
    assert got == reconciled(spark, batches) == {(0, k, 1010) for k in range(10) if k not in (2, 3)}


def test_windows_out_of_order_and_over_batches(spark):
    """The close comes before the opening, changes after the close, reads last of all; a second chunk stays open."""
    batches = [
        ([(1, 1000), (5, 1040)], [(0, snapshot.CLOSE, 1055), (1, snapshot.OPEN, 1030)], []),
        ([(2, 1011), (3, 1056), (14, 1058)], [(0, snapshot.OPEN, 1010)], reads_of(1, 1030, 1050)),
        ([(6, 1050), (7, 1010)], [], reads_of(0, 1010, 1052)),
        ([(1, 9000)], [], []),
    ]
    got = windows_of(spark, batches)
    assert got == reconciled(spark, batches) == {(0, k, 1010) for k in range(10) if k not in (2, 5, 6)}


def test_reopened_windows_in_a_stream(spark):
    """Read, closed, opened again: the first reading no longer counts, and the second comes out when it is closed."""
    first = ([(2, 1011)], [(0, snapshot.OPEN, 1010), (0, snapshot.CLOSE, 1055)], reads_of(0, 1010, 1030))
    on = ([(1, 2000)], [], [])
    again = ([(3, 2150)], [(0, snapshot.OPEN, 2100)], reads_of(0, 2100, 2120))
    closed = ([(4, 9000)], [(0, snapshot.CLOSE, 2200)], [])
    assert windows_of(spark, [first, on]) == reconciled(spark, [first, on]) == {(0, k, 1010) for k in range(10) if k != 2}
    assert windows_of(spark, [first, on, again]) == reconciled(spark, [first, on, again]) == set()
    every = [first, on, again, closed]
    assert windows_of(spark, every) == reconciled(spark, every) == {(0, k, 2100) for k in range(10) if k != 3}


def test_only_witnesses_are_kept():
    class Kept(processors.ChunkWindows):
        def __init__(self):
            self.changes = self
            self.held = {}

        def updateValue(self, key, value):
            self.held[key[0]] = value[0]

        def containsKey(self, key):
            return key[0] in self.held

        def removeKey(self, key):
            del self.held[key[0]]

    kept = Kept()
    kept._keep("a", set(range(0, 1000, 7)), [100, 500], 900)
    assert kept.held == {"a": [105, 504, *range(903, 1000, 7)]}
    kept._keep("a", {5, 6}, [], 900)
    assert kept.held == {}


EVENTS = "tx_id long, tbl string, pos long, ts timestamp, amount decimal(12,2)"
OUTCOMES = "tx_id long, status string, ended timestamp"


def at(second, micro=0):
    import datetime
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second, microseconds=micro)


def event(tx, pos, second):
    from decimal import Decimal
    return (tx, "t", pos, at(second, 123456), Decimal("1.50"))


def buffered(spark, batches):
    build = lambda e, o: processors.buffered_stream(e, o, "ts", "ended", "10 seconds", "60 seconds")
    return deliver(spark, build, (EVENTS, OUTCOMES), batches)


def test_transactions_leave_with_their_outcome(spark):
    """1 commits before its last event comes, 2 is rolled back, 3 never ends, 4 ends in a later batch, one event has none."""
    batches = [
        ([event(1, 1, 0), event(2, 2, 0), event(3, 3, 1), event(4, 4, 2), event(None, 5, 2), event(2, 6, 3)], [(1, "COMMITTED", at(3)), (2, "ABORTED", at(4))]),
        ([event(1, 7, 4), event(2, 8, 4)], [(4, "COMMITTED", at(9)), (9, "IN DOUBT", at(5))]),
        ([event(5, 9, 500)], [(5, "ABORTED", at(500))]),
        ([event(6, 10, 900)], [(6, "COMMITTED", at(900))]),
    ]
    rows, query = buffered(spark, batches)
    got = {(r["pos"], r["settled"]) for r in rows.collect()}
    assert got == {(1, "COMMITTED"), (7, "COMMITTED"), (4, "COMMITTED"), (3, "EXPIRED"), (5, "PASSED"), (10, "COMMITTED")}
    assert rows.filter("pos = 1").first()["ts"] == at(0, 123456) and str(rows.first()["amount"]) == "1.50"


def test_nothing_is_kept_of_a_rollback(spark):
    """A thousand events of a rolled-back transaction; once the watermark has passed it, the state is empty."""
    batches = [([event(1, i, 0) for i in range(1000)], [(7, "ABORTED", at(0))]), ([event(None, 5000, 1)], [(1, "ABORTED", at(1))]),
               ([event(2, 6000, 500)], [(2, "ABORTED", at(500))]), ([event(3, 7000, 1000)], [(3, "ABORTED", at(1000))])]
    rows, query = buffered(spark, batches)
    assert [r["pos"] for r in rows.collect()] == [5000]
    left = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert left[-1] <= 4 * 4  # the outcome of the last transaction and its timer, by salt


def test_a_huge_transaction_is_split(spark):
    batches = [([event(1, i, 0) for i in range(4000)], [(1, "COMMITTED", at(1))])]
    rows, _ = buffered(spark, batches)
    assert rows.count() == 4000
    salts = spark.range(4000).select(F.pmod(F.xxhash64(F.lit("t"), "id"), F.lit(processors.SALTS)).alias("s")).groupBy("s").count().collect()
    assert len(salts) == processors.SALTS and max(r["count"] for r in salts) < 1200


class Held:
    """A handle of dictionaries that counts the calls a processor makes."""

    def __init__(self):
        self.calls, self.timers, self.held = 0, [], {}

    def state(self, name, *_):
        def call(given):
            self.calls += 1
            return self.held.setdefault(name, {}), given
        return type("State", (), {
            "get": lambda _: call(0)[0].get(0), "exists": lambda _: bool(call(0)[0]), "clear": lambda _: call(0)[0].clear(),
            "update": lambda _, v: call(0)[0].update({0: v}), "updateValue": lambda _, k, v: call(0)[0].update({k: v}),
            "getValue": lambda _, k: call(0)[0][k], "removeKey": lambda _, k: call(0)[0].pop(k),
            "appendList": lambda _, v: call(0)[0].setdefault(0, []).extend(v)})()

    getValueState = getListState = getMapState = state

    def registerTimer(self, when):
        self.calls += 1
        self.timers.append(when)


def test_what_ends_in_its_batch_makes_no_calls_of_its_own():
    """A thousand transactions in one key: a few calls for all that end, and one for each that stays open."""
    from types import SimpleNamespace
    handle, buffer = Held(), processors.TransactionBuffer(60_000, 10_000)
    buffer.init(handle)
    row = lambda tx, at, status=None: SimpleNamespace(tx=tx, at=at, status=status, row=None if status else f"{tx}@{at}")
    put = lambda rows, now=0: [(r["row"], r["settled"]) for r in buffer.handleInputRows((0,), iter(rows), SimpleNamespace(getCurrentWatermarkInMs=lambda: now))]
    fire = lambda at: [(r["row"], r["settled"]) for r in buffer.handleExpiredTimer(
        (0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: at), SimpleNamespace(getExpiryTimeInMs=lambda: at))]
    ends = [row(str(i), 5, "COMMITTED" if i % 2 else "ABORTED") for i in range(1000)]
    got = put([row(str(i), i) for i in range(1000)] + ends + [row("1", 7), row("2", 7), row("open", 9), row("gone", 9), row(None, 1, "ABORTED")])
    assert sorted(got) == sorted([(f"{i}@{i}", "COMMITTED") for i in range(1, 1000, 2)] + [("1@7", "COMMITTED")])
    assert handle.calls <= 5
    # Later rows of an open transaction, its end, an end of nothing, and what the watermark passes.
    assert put([row("open", 8), row("3", 11), row("4", 11)]) == [("3@11", "COMMITTED")]
    assert put([row("open", 12, "COMMITTED"), row("new", 12, "COMMITTED")]) == [("open@9", "COMMITTED"), ("open@8", "COMMITTED")]
    assert fire(10_006) == [] and put([row("5", 11)]) == [] and put([row("open", 13)]) == [("open@13", "COMMITTED")]
    assert sorted(fire(70_020)) == [("5@11", "EXPIRED"), ("gone@9", "EXPIRED")]
    assert not any(handle.held.values())
