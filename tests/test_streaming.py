"""Streaming forms: resume, replay, late rows, bounded intake, isolation of bad rows."""

import pytest
from pyspark.sql import functions as F

from changeflow.operators import materialize
from changeflow.operators.deadletter import parse_messages
from changeflow.operators.expand import split_pk_update
from changeflow.session import CHECKPOINT_SETTING, keep_state_on_disk, shared_folder, work_path
from changeflow.sources import readers, sinks
from changeflow.sources.fixtures import change_log, transactions
from changeflow.operators.commit import committed_only
from changeflow.streaming import jobs


@pytest.fixture(scope="module")
def committed(spark, sf):
    log = change_log(spark, sf)
    path = work_path(spark, "committed")
    committed_only(log, transactions(log)).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get(CHECKPOINT_SETTING)
    assert work_path(spark, "x") != work_path(spark, "x")


def test_replayed_and_folded_batches_leave_the_state(spark, committed):
    path = work_path(spark, "state")
    want = rows_of(materialize.materialize(committed).select("tbl", "key_id", "after", "pos"))
    for i in range(3):
        sinks.apply_batch(committed.filter(F.col("pos") % 3 == i), i, path)
    assert rows_of(sinks.read_applied(spark, path)) == want
    sinks.apply_batch(committed.filter(F.col("pos") % 3 == 1), 1, path)
    assert rows_of(sinks.read_applied(spark, path)) == want
    sinks.fold_batches(spark, path, 1)
    assert rows_of(sinks.read_applied(spark, path)) == want
    sinks.fold_batches(spark, path, 2)
    sinks.fold_batches(spark, path, 2)
    assert rows_of(sinks.read_applied(spark, path)) == want


def test_restart_takes_in_only_new_files(spark, committed):
    topic, path, ck = (work_path(spark, n) for n in ("topic", "state", "ck"))
    seen = []
    for i in range(2):
        committed.filter(F.col("pos") % 2 == i).coalesce(1).write.mode("append").parquet(topic)
        stream = readers.stream_changes(spark, topic, committed.schema, max_files=1)
        q = jobs.finish(jobs.materialize_stream(stream, path, ck))
        seen.append(sum(p.numInputRows for p in q.recentProgress))
    assert sum(seen) == committed.count() and min(seen) > 0
    assert rows_of(sinks.read_applied(spark, path)) == rows_of(materialize.materialize(committed).select("tbl", "key_id", "after", "pos"))


def test_intake_is_bounded_per_batch(spark, committed):
    topic, out = work_path(spark, "topic"), work_path(spark, "out")
    committed.repartition(6).write.parquet(topic)
    stream = readers.stream_changes(spark, topic, committed.schema, max_files=2)
    q = jobs.finish(jobs.append_files(stream.select("tbl", "pos"), out, work_path(spark, "ck")))
    assert len([p for p in q.recentProgress if p.numInputRows]) == 3
    assert spark.read.parquet(out).count() == committed.count()


def test_late_rows_are_counted(spark):
    topic, ck, out = (work_path(spark, n) for n in ("topic", "ck", "out"))
    make = lambda *seconds: spark.createDataFrame([(s,) for s in seconds], "s bigint").select(
        F.timestamp_seconds("s").alias("ts"), F.lit(1).alias("value"))
    late = 0
    for seconds in ((10, 20, 7200), (15,), (7300,)):
        make(*seconds).coalesce(1).write.mode("append").parquet(topic)
        stream = readers.stream_changes(spark, topic, make(1).schema)
        q = jobs.finish(jobs.append_files(
            jobs.windowed_signals(stream, "ts", "1 minute", "1 minute", {"total": F.sum("value")}), out, ck))
        late += jobs.late_rows(q)
    assert late == 1
    first = spark.read.parquet(out).orderBy("window_start").first()
    assert first["events"] == 2 and first["total"] == 2


def test_rolled_back_and_open_transactions_never_leave(spark):
    keep_state_on_disk(spark)
    events_path, outcomes_path, out, ck = (work_path(spark, n) for n in ("events", "outcomes", "out", "ck"))
    ts = F.timestamp_seconds(F.lit(1000) + F.col("pos"))
    log = spark.range(4000).select(
        F.lit("t").alias("tbl"), F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 4 + 1).cast("long").alias("tx_id"))
    log = log.withColumn("source_ts", ts)
    outcomes = spark.createDataFrame([(1, "COMMITTED"), (2, "ABORTED")], "tx_id bigint, status string").withColumn(
        "ended", F.timestamp_seconds(F.lit(2000)))

    def run():
        e = readers.stream_changes(spark, events_path, log.schema)
        o = readers.stream_changes(spark, outcomes_path, outcomes.schema)
        joined = jobs.committed_stream(e, o, "source_ts", "ended", "1 day", "1 day", salts=4)
        jobs.finish(jobs.append_files(joined.select("pos", "tx_id"), out, ck))
        return spark.read.schema("pos bigint, tx_id bigint").parquet(out)

    log.write.parquet(events_path)
    outcomes.filter("tx_id = 2").write.parquet(outcomes_path)
    assert run().count() == 0
    outcomes.filter("tx_id = 1").write.mode("append").parquet(outcomes_path)
    flushed = run()
    assert flushed.count() == flushed.distinct().count() == log.filter("tx_id = 1").count()
    assert [r[0] for r in flushed.select("tx_id").distinct().collect()] == [1]


def test_bad_rows_do_not_block_good_ones(spark):
    topic, path = (work_path(spark, n) for n in ("raw", "routed"))
    raw = spark.createDataFrame(
        [(1, bytearray(b"\xff\x00")), (2, bytearray(b'\x00\x00\x00\x00\x2a{"id":2}')), (3, bytearray(b"\x00\x00\x00\x00\x2a{bad")), (4, None)],
        "n int, value binary")
    raw.write.parquet(topic)
    parsed = parse_messages(readers.stream_changes(spark, topic, raw.schema), "id int")
    jobs.finish(jobs.route_stream(parsed, path, work_path(spark, "ck")))
    routed = spark.read.parquet(path)
    assert sorted((r["n"], r["doc"] and r["doc"]["id"]) for r in routed.filter("route = 'main'").collect()) == [(2, 2), (4, None)]
    assert sorted((r["n"], r["reason"]) for r in routed.filter("route = 'dlq'").collect()) == [(1, "BAD_HEADER"), (3, "BAD_JSON")]


def test_stateless_operators_accept_streams(spark, committed):
    path = work_path(spark, "c")
    committed.write.parquet(path)
    stream = readers.stream_changes(spark, path, committed.schema)
    assert split_pk_update(stream).isStreaming


def test_events_of_no_transaction_pass_and_expired_ones_are_kept(spark):
    """Reads without a transaction leave a stream as they leave the batch form; an open transaction's event gets a file of its own."""
    events = [("orders", 1, 10, "2024-01-01 00:00:00"), ("orders", 2, 20, "2024-01-01 00:01:00"), ("orders", 3, 30, "2024-01-01 00:02:00"),
              ("orders", 4, None, "2024-01-01 00:03:00"), ("orders", 5, None, "2023-01-01 00:00:00"), ("orders", 6, 40, "2024-01-05 00:00:00")]
    outcomes = [(10, "COMMITTED", "2024-01-01 00:05:00"), (20, "ABORTED", "2024-01-01 00:05:00"), (40, "COMMITTED", "2024-01-05 00:00:00")]
    log = spark.createDataFrame(events, "tbl string, pos long, tx_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    tx = spark.createDataFrame(outcomes, "tx_id long, status string, ended string").withColumn("ended", F.col("ended").cast("timestamp"))
    for name, rows in (("all", log), ("inside", log.filter("tx_id IS NOT NULL"))):
        paths = {n: work_path(spark, f"{name}-{n}") for n in ("log", "tx", "settled", "committed", "ck1", "ck2")}
        rows.write.parquet(paths["log"])
        tx.write.parquet(paths["tx"])
        e, o = (readers.stream_changes(spark, paths[n], df.schema) for n, df in (("log", rows), ("tx", tx)))
        settled = jobs.settled_stream(e, o, "ts", "ended", "1 minute", "1 day", salts=2)
        jobs.run_stateful(spark, lambda: jobs.settled_files(settled, paths["settled"], paths["ck1"]), 2)
        committed = jobs.committed_stream(e, o, "ts", "ended", "1 minute", "1 day", salts=2)
        jobs.run_stateful(spark, lambda: jobs.append_files(committed, paths["committed"], paths["ck2"]), 2)
        of = lambda *outcome: [r["pos"] for r in jobs.settled_rows(spark, paths["settled"], settled.schema, *outcome).orderBy("pos").collect()]
        assert of("EXPIRED") == [3] and of("ABORTED") == [2] and of("COMMITTED") == [1, 6]
        assert of("PASSED") == ([4, 5] if name == "all" else [])
        assert rows_of(spark.read.parquet(paths["committed"])) == rows_of(committed_only(rows, tx).select(*rows.columns))
