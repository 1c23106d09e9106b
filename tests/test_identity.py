"""Shapes that real change logs have: NULL groups, text order, ties, rows without a transaction, many rows at a position."""

import pytest
from pyspark.sql import functions as F

from changeflow.envelope import ENVELOPE
from changeflow.functions.wire import wire_encode
from changeflow.operators import commit, deadletter, expand, materialize, schema_gov, signals, skew, snapshot
from changeflow.sources import engines
from changeflow.sources.engines import Source


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    return spark.range(1200).select(
        F.when(n % 4 == 0, None).when(n % 4 == 1, n % 40).otherwise(1).cast("long").alias("grp"), n.alias("number"),
        F.lpad(n.cast("string"), 6, "0").alias("text"), F.when(n % 3 != 0, n.cast("string")).alias("mixed"), (n % 2).alias("tied"), n.alias("id"))


@pytest.mark.parametrize("order", [["number"], ["text"], ["mixed", "id"], ["tied", "text"]])
def test_segments_change_nothing(rows, order):
    def results(**split):
        ranked = skew.row_numbers(rows, ["grp"], order, "rn", **split)
        near = skew.neighbours(ranked, ["grp"], order, ["id"], "before", **split)
        after = skew.neighbours(near, ["grp"], order, ["id"], "after", following=True, **split)
        marked = after.withColumn("mark", F.when(F.col("id") % 97 == 0, F.col("id")))
        filled = skew.next_value(marked, ["grp"], order, "mark", "upcoming", **split)
        return {tuple(map(str, r)) for r in filled.select("id", "rn", "before", "after", "upcoming").collect()}

    plain = results()
    assert len(plain) == 1200
    assert results(hot_rows=50, segment_rows=40) == plain


def test_cuts_are_taken_per_group(spark):
    n = F.col("id")
    rows = spark.range(2000).select((n % 2).alias("grp"), F.when(n % 2 == 0, n).otherwise(n + 10**9).alias("pos"))
    marked, split = skew._segmented(rows, ["grp"], ["pos"], 100, 100)
    sizes = [r["n"] for r in marked.groupBy("grp", "__seg").agg(F.count("*").alias("n")).collect()]
    assert split and len(sizes) >= 12 and max(sizes) < 300


def test_wide_rows_are_measured_before_they_move(spark):
    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    assert skew.bounded(wide, 100, 5000) is None
    assert skew.bounded(wide, 100, 50_000).count() == 10
    assert skew.bounded(wide, 9, 50_000) is None


@pytest.mark.parametrize("limit", [100, 0])
def test_rows_outside_transactions_pass(spark, limit):
    log = spark.createDataFrame([(1, "orders", 1), (2, "orders", 2), (3, "orders", None), (4, "orders", 9)], "pos long, tbl string, tx_id long")
    tx = spark.createDataFrame([(1, "COMMITTED"), (2, "ABORTED"), (None, "COMMITTED")], "tx_id long, status string")
    assert sorted(r["pos"] for r in commit.committed_only(log, tx, limit=limit).collect()) == [1, 3]


def test_many_rows_at_one_position(spark):
    raw = spark.createDataFrame(
        [("t", "INSERT", "a:7", None, {"id": str(i)}, i) for i in range(3)] + [("t", "UPDATE", "a:7", {"id": "1"}, {"id": "9"}, 3)],
        "table string, op string, gtid string, before map<string,string>, after map<string,string>, row_ord int")
    for engine, gtid in (("mysql", "gtid"), ("mariadb", "gtid")):
        shaped = raw if engine == "mysql" else raw.withColumn("gtid", F.lit("0-1-7"))
        envelope = engines.normalize(engine, shaped, Source("db", ["id"]))
        assert materialize.dedupe_events(envelope.unionByName(envelope)).count() == 4
        state = materialize.materialize(engines.from_envelope(envelope))
        assert sorted(r["key_id"] for r in state.collect()) == ['{"id":"0"}', '{"id":"2"}', '{"id":"9"}']
        assert set(envelope.columns) == {f.name for f in ENVELOPE}


def test_keyless_events_stay_apart(spark):
    rows = [("t", "t", None, 5, 0), ("t", "DDL_ADD_COL", None, 6, 0), ("t", "c", 1, 7, 0)]
    events = spark.createDataFrame(rows, "tbl string, op string, key_id long, pos long, sub_order int")
    assert sorted(r["op"] for r in materialize.compact_log(events).collect()) == ["DDL_ADD_COL", "c", "t"]


def test_place_in_transaction_survives_the_key_split(spark):
    log = spark.createDataFrame([("t", "pk", "b", "a", 1, 3), ("t", "c", "c", None, 1, 4)],
                                "tbl string, op string, key_id string, old_key_id string, pos long, sub_order int")
    log = log.withColumn("before", F.lit(None).cast("string")).withColumn("after", F.lit("x"))
    got = sorted((r["sub_order"], r["op"], r["key_id"]) for r in expand.split_pk_update(log).collect())
    assert got == [(6, "d", "a"), (7, "c", "b"), (8, "c", "c")]


def test_tombstones_are_good(spark):
    parsed = deadletter.parse_messages(spark.createDataFrame([(None,), (bytearray(b"\x01"),)], "value binary"), "id int")
    assert sorted(str(r["reason"]) for r in parsed.collect()) == ["BAD_HEADER", "None"]


def test_large_schema_ids_are_refused(spark):
    with pytest.raises(Exception, match="four bytes"):
        spark.range(1).select(wire_encode(F.lit(2**32 + 5), F.lit("x"))).collect()


def test_unknown_schemas_are_quarantined(spark):
    registry = spark.createDataFrame(
        [("s", 1, "a", "int", False), ("s", 3, "a", "int", False), ("s", 3, "b", "int", None), ("s", 4, "a", "int", False)],
        "subject string, version int, field string, type string, has_default boolean")
    verdicts = {r["version"]: r["compatible"] for r in schema_gov.schema_verdicts(registry).collect()}
    assert verdicts == {1: True, 3: False, 4: False}
    events = spark.createDataFrame([("s", v) for v in (1, 2, 3, 4)], "subject string, version int")
    routes = {r["version"]: r["route"] for r in schema_gov.quarantine_split(events, schema_gov.schema_verdicts(registry)).collect()}
    assert routes == {1: "main", 2: "dlq", 3: "dlq", 4: "dlq"}


def test_reopened_windows_are_open(spark):
    signals_ = spark.createDataFrame([(1, snapshot.OPEN, 10), (1, snapshot.CLOSE, 20), (1, snapshot.OPEN, 30)], "chunk_id int, type string, pos long")
    assert [tuple(r) for r in snapshot.snapshot_windows(signals_).collect()] == [(1, 30, None)]


def test_chunks_of_large_and_negative_keys(spark):
    keys = spark.createDataFrame([(2**62 + 1023,), (2**62,), (-1,), (-1024,), (0,)], "k long")
    got = {r["k"]: r["c"] for r in keys.select("k", snapshot.chunk_number("k").alias("c")).collect()}
    assert got == {2**62 + 1023: 2**52, 2**62: 2**52, -1: -1, -1024: -1, 0: 0}


def test_lag_of_high_positions(spark):
    slots = spark.createDataFrame([("s", "0/1")], "slot_name string, confirmed_lsn string")
    log = spark.createDataFrame([("FFFFFFFF/FFFFFFFF",)], "lsn string")
    assert int(signals.slot_lag(slots, log).first()["lag_bytes"]) == 2**64 - 2
