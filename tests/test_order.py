"""The order of changes: places within a transaction, and positions of several servers."""

import pytest
from pyspark.sql import functions as F

from changeflow.operators import commit, expand, materialize, skew
from changeflow.sources import engines
from changeflow.sources.engines import Source
from changeflow.sources.sinks import apply_batch, fold_batches, read_applied

LOG = "tbl string, op string, key_id long, old_key_id long, before string, after string, pos long, sub_order int, source_ts timestamp"


def log_of(spark, *rows):
    """Rows (op, key, after, place) of one transaction after a row of an earlier one."""
    full = [("t", "c", 1, None, None, "old", 1, 0, None)] + [("t", op, key, None, None, after, 5, place, None) for op, key, after, place in rows]
    return spark.createDataFrame(full, LOG).withColumn("source_ts", F.timestamp_seconds(F.col("pos") * 100 + F.col("sub_order")))


CASES = [
    ([("t", None, None, 0), ("c", 2, "new", 1)], {2}, {(5, 0): 1}),
    ([("c", 2, "new", 0), ("t", None, None, 1)], set(), {(5, 2): 2}),
    ([("c", 2, "a", 0), ("t", None, None, 1), ("c", 2, "b", 2), ("t", None, None, 3), ("c", 3, "c", 4)], {3}, {(5, 2): 2, (5, 6): 1}),
    ([("t", None, None, 0), ("t", None, None, 0)], set(), {(5, 0): 1}),
]


@pytest.mark.parametrize("rows,alive,purged", CASES)
@pytest.mark.parametrize("few", [1000, 0])
def test_truncate_within_a_transaction(spark, rows, alive, purged, few):
    log = log_of(spark, *rows)
    assert {r["key_id"] for r in materialize.materialize(log).collect()} == alive
    events = expand.split_pk_update(log)
    cuts = materialize.truncates(events)
    counts = materialize.truncate_counts(events, cuts.distinct(), few_truncates=few).collect()
    assert {(r["truncate_pos"], r["truncate_sub"]): r["purged"] for r in counts} == purged
    history = materialize.change_history(events, cuts, few_truncates=few)
    assert {r["key_id"] for r in history.filter("valid_to IS NULL").collect()} == alive
    feed = materialize.search_feed(events, cuts).collect()
    assert {r["key_id"] for r in feed if r["action"] == "UPSERT"} == alive


@pytest.mark.parametrize("rows,alive,purged", CASES)
def test_truncate_within_a_transaction_in_batches(spark, tmp_path, rows, alive, purged):
    """Every row in a batch of its own, the later ones first; folded in between."""
    for i, row in enumerate(reversed(log_of(spark, *rows).collect())):
        apply_batch(spark.createDataFrame([row], LOG), i, str(tmp_path))
        if i % 2:
            fold_batches(spark, str(tmp_path), i)
        expected = read_applied(spark, str(tmp_path))
    assert {r["key_id"] for r in expected.collect()} == alive


def test_state_within_a_transaction(spark):
    log = log_of(spark, ("c", 2, "a", 0), ("t", None, None, 1), ("c", 3, "b", 2))
    keys = lambda place: {r["key_id"] for r in materialize.state_as_of(log, 5, place=place).collect()}
    assert [keys(p) for p in (0, 1, 2, None)] == [{1, 2}, set(), {3}, {3}]


def test_order_of_a_transaction_by_place(spark):
    rows = spark.createDataFrame([(7, 5, f"t{6 - i}", i, 9 - i) for i in range(6)], "tx_id long, pos long, tbl string, sub_order int, key_id long")
    got = {r["sub_order"]: r["tx_ord"] for r in commit.tx_order(rows).collect()}
    assert got == {i: i + 1 for i in range(6)}


def test_same_place_under_one_gtid(spark):
    """From raw changes on: a truncate and an insert with one GTID."""
    raw = spark.createDataFrame([("t", "INSERT", "a:1", {"id": "1"}, 0), ("t", "TRUNCATE", "a:2", None, 0), ("t", "INSERT", "a:2", {"id": "2"}, 1)],
                                "table string, op string, gtid string, after map<string,string>, row_ord int")
    state = materialize.materialize(engines.from_envelope(engines.normalize("mysql", raw, Source("db", ["id"]))))
    assert [r["key_id"] for r in state.collect()] == ['{"id":"2"}']


def test_ties_are_cut_too(spark):
    tied = spark.range(4000).select(F.lit(1).alias("grp"), F.lit(5).alias("pos"), "id")
    marked, split = skew._segmented(*[skew._tied(tied, ["pos"])[0], ["grp"], skew._tied(tied, ["pos"])[1]], 100, 100)
    sizes = [r["n"] for r in marked.groupBy("__seg").agg(F.count("*").alias("n")).collect()]
    assert split and max(sizes) < 600
    plain, cut = (skew.neighbours(skew.row_numbers(tied, ["grp"], ["pos"], "rn", **s), ["grp"], ["pos"], ["id"], "prev", **s)
                  for s in ({}, {"hot_rows": 100, "segment_rows": 100}))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(plain) == rows(cut)
