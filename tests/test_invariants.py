"""Properties that hold for any change log, checked against a row-by-row model."""

import random

import pytest
from pyspark.sql import functions as F

from changeflow.operators import commit, continuity, expand, materialize, signals, snapshot
from changeflow.sources.fixtures import change_log, transactions

SCHEMA = ("tbl string, op string, key_id bigint, old_key_id bigint, before struct<v:bigint>, after struct<v:bigint>, "
          "pos bigint, tx_id bigint, source_ts timestamp_ntz")


def random_log(seed):
    """A valid history of two tables with key moves, truncates and rolled-back transactions; key 0 is hot."""
    rnd, live, rows, outcome = random.Random(seed), {"a": {}, "b": {}}, [], {}
    for pos in range(1, 160):
        tx = pos // 4
        outcome.setdefault(tx, rnd.choice(["COMMITTED"] * 4 + ["ABORTED", None]))
        tbl, key = rnd.choice("ab"), 0 if rnd.random() < 0.4 else rnd.randrange(8)
        state, done = live[tbl], outcome[tx] == "COMMITTED"
        v = rnd.randrange(1000)
        if rnd.random() < 0.03:
            rows.append((tbl, "t", None, None, None, None, pos, tx, None))
            if done:
                state.clear()
        elif key not in state:
            rows.append((tbl, "c", key, None, None, (v,), pos, tx, None))
            if done:
                state[key] = v
        else:
            old, kind = state[key], rnd.choice(["u", "u", "d", "pk"])
            to = rnd.randrange(8, 12)
            if kind == "pk" and to in state:
                kind = "u"
            if kind == "u":
                rows.append((tbl, "u", key, None, (old,), (v,), pos, tx, None))
                if done:
                    state[key] = v
            elif kind == "d":
                rows.append((tbl, "d", key, None, (old,), None, pos, tx, None))
                if done:
                    del state[key]
            else:
                rows.append((tbl, "pk", to, key, (old,), (old,), pos, tx, None))
                if done:
                    state[to] = state.pop(key)
    want = {(t, k): v for t, s in live.items() for k, v in s.items()}
    return rows, [(t, s) for t, s in outcome.items() if s], want


@pytest.mark.parametrize("seed", range(6))
def test_state_equals_row_by_row_model(spark, seed):
    rows, outcomes, want = random_log(seed)
    log = spark.createDataFrame(rows, SCHEMA)
    tx = spark.createDataFrame(outcomes, "tx_id bigint, status string")
    got = {(r["tbl"], r["key_id"]): r["after"]["v"] for r in materialize.materialize(log, tx).collect()}
    assert got == want
    twice = log.unionByName(log)
    again = {(r["tbl"], r["key_id"]): r["after"]["v"] for r in materialize.materialize(twice, tx).collect()}
    assert again == want
    committed = commit.committed_only(log, tx)
    assert commit.rollback_leaks(committed, tx).count() == 0
    history = materialize.change_history(expand.split_pk_update(committed).withColumn("source_ts", F.timestamp_seconds("pos")),
                                         materialize.truncates(committed).withColumn("source_ts", F.timestamp_seconds("pos")))
    current = {(r["tbl"], r["key_id"]): r["after"]["v"] for r in history.filter("valid_to IS NULL").collect()}
    assert current == want
    end = 80
    upto = {(r["tbl"], r["key_id"]) for r in materialize.state_as_of(log, end, tx).collect()}
    from_history = history.filter(f"pos <= {end}").filter(
        F.col("valid_to").isNull() | (F.col("valid_to") > F.timestamp_seconds(F.lit(end)))).select("tbl", "key_id").collect()
    assert upto == {tuple(r) for r in from_history}


@pytest.mark.parametrize("seed", range(4))
def test_incremental_snapshot_and_log_give_the_state(spark, seed):
    """Capture starts at position 30; the rows before it are only seen through chunk reads, each at
    some point inside its window. Applied together with the log they give the full state."""
    rows, outcomes, want = random_log(100 + seed)
    log = spark.createDataFrame(rows, SCHEMA).filter("tbl = 'a'")
    tx = spark.createDataFrame(outcomes, "tx_id bigint, status string")
    committed = commit.committed_only(log, tx)
    rnd, chunks, windows = random.Random(seed), None, []
    for chunk in range(3):
        low = rnd.randrange(30, 100)
        high = low + rnd.randrange(2, 50)
        windows.append((chunk, low, high))
        seen = materialize.state_as_of(committed, rnd.randrange(low, high)).filter(F.floor(F.col("key_id") / 4) == chunk)
        part = seen.select(F.lit(chunk).cast("bigint").alias("chunk_id"), "key_id", "after")
        chunks = part if chunks is None else chunks.unionByName(part)
    frames = spark.createDataFrame(windows, "chunk_id bigint, low bigint, high bigint")
    captured = expand.split_pk_update(committed.filter("pos > 30"))
    for chunk_of in (None, F.floor(F.col("key_id") / 4)):
        reads = snapshot.dblog_reconcile(chunks, captured, frames, chunk_of=chunk_of, stamp=True)
        reads = reads.drop("event_type", "chunk_id").withColumn("tbl", F.lit("a")).withColumn("old_key_id", F.lit(None).cast("bigint"))
        merged = snapshot.merge_snapshot(reads, committed.filter("pos > 30"))
        got = {r["key_id"]: r["after"]["v"] for r in materialize.materialize(merged).collect()}
        assert got == {k: v for (t, k), v in want.items() if t == "a"}


@pytest.fixture(scope="module")
def log(spark, sf):
    return change_log(spark, sf)


def test_state_at_last_position_is_current(spark, log):
    tx = transactions(log)
    last = log.agg(F.max("pos")).first()[0]
    now, then = materialize.materialize(log, tx), materialize.state_as_of(log, last, tx)
    assert now.exceptAll(then).isEmpty() and then.exceptAll(now).isEmpty()


def test_offsets_are_dense(spark, log):
    events = expand.delete_tombstones(expand.split_pk_update(log)).withColumns(
        {"topic": F.col("tbl"), "partition": F.coalesce(F.col("key_id") % 3, F.lit(0))})
    for split in ({}, {"hot_rows": 100, "segment_rows": 100}):
        rows = expand.assign_offsets(events, **split).groupBy("topic", "partition").agg(
            F.min("offset").alias("lo"), F.max("offset").alias("hi"), F.count_distinct("offset").alias("n")).collect()
        assert rows and all(r["lo"] == 0 and r["hi"] + 1 == r["n"] for r in rows)


def test_compaction_keeps_live_keys(spark, log):
    orders = commit.committed_only(log, transactions(log)).filter("tbl = 'orders'")
    split = expand.split_pk_update(orders)
    compacted = {r["key_id"] for r in materialize.compact_log(split).collect()}
    state = {r["key_id"] for r in materialize.materialize(orders).collect()}
    assert compacted == state


def test_net_changes_from_the_start_are_the_state(spark, log):
    orders = expand.split_pk_update(commit.committed_only(log, transactions(log)).filter("tbl = 'orders'"))
    net = materialize.net_changes(orders)
    assert {r["net_op"] for r in net.select("net_op").distinct().collect()} == {"c"}
    assert net.count() == 1415


def test_retention_keeps_the_window(spark):
    df = spark.range(20).select(F.timestamp_seconds(F.col("id") * 86400).alias("ts"))
    assert materialize.retention_filter(df, "ts").count() == 8
    assert materialize.retention_filter(df, "ts", days=1, now="1970-01-11 00:00:00").count() == 11
    assert materialize.retention_filter(df.limit(0), "ts").count() == 0


def test_gap_and_duplicate_reports(spark):
    seq = spark.createDataFrame([("s", n) for n in (1, 2, 2, 5, 6, 9)] + [("t", 7)], "server string, seq bigint")
    for split in ({}, {"hot_rows": 2, "segment_rows": 2}):
        gaps = sorted(tuple(r) for r in continuity.sequence_gaps(seq, ["server"], "seq", **split).collect())
        assert gaps == [("s", 2, 5, 2), ("s", 6, 9, 2)]
        bad = sorted(tuple(r) for r in continuity.producer_seq_check(seq, ["server"], "seq", **split).select("seq", "copies", "missing").collect())
        assert bad == [(2, 2, 0), (5, 1, 2), (9, 1, 2)]


def test_weighted_percentiles_equal_plain_ones(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 91).cast("double").alias("v"), F.lit("x").alias("g"))
    got = signals.latency_percentiles(df, F.col("v"), ["g"]).first()
    want = df.agg(F.percentile("v", F.array(F.lit(0.95), F.lit(0.99))).alias("p")).first()["p"]
    assert [got["p95_latency_ms"], got["p99_latency_ms"]] == want


def test_size_labels(spark):
    sizes = [0, 1023, 1024, 5 * 2**20, 3 * 2**30]
    df = spark.createDataFrame([(s,) for s in sizes], "s bigint")
    assert [r[0] for r in df.select(signals.size_label(F.col("s"))).collect()] == ["0 B", "1023 B", "1 KB", "5 MB", "3 GB"]
