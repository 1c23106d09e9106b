"""Transaction boundaries and rows at many positions, against plain Python and against one state per position."""

import random

import pytest
from pyspark.sql import functions as F

from changeflow.operators import asof, boundaries, expand, materialize

ROWS = "tx_id long, tbl string, sub_order int, arrival long, v string"
RECORDS = "tx_id long, kind string, event_count long, table_counts array<struct<table:string,n:long>>, arrival long"


def end(tx, counts, at=100):
    return (tx, "END", sum(counts.values()), list(counts.items()), at)


CASES = [
    ("complete", [(1, "a"), (2, "b")], [end(1, {"a": 1, "b": 1})], "COMPLETE", (2, 0, 0, 0)),
    ("unordered and repeated", [(2, "b"), (1, "a"), (2, "b"), (2, "b")], [end(1, {"b": 1, "a": 1})], "COMPLETE", (2, 0, 2, 0)),
    ("one is missing", [(1, "a"), (3, "a")], [end(1, {"a": 3})], "MISSING", (2, 1, 0, 0)),
    ("a gap that a surplus hides", [(1, "a"), (3, "a")], [end(1, {"a": 2})], "EXCESS", (2, 0, 0, 0)),
    ("too many", [(1, "a"), (2, "a")], [end(1, {"a": 1})], "EXCESS", (2, 0, 0, 0)),
    ("wrong table", [(1, "a"), (2, "b")], [end(1, {"a": 2})], "EXCESS", (2, 0, 0, 0)),
    ("empty", [], [end(1, {"a": 0})], "COMPLETE", (0, 0, 0, 0)),
    ("not ended", [(1, "a")], [(1, "BEGIN", None, None, 0)], "OPEN", (1, 0, 0, 0)),
    ("unknown", [(1, "a")], [end(2, {"a": 1})], "UNKNOWN", (1, 0, 0, 0)),
    ("ended twice alike", [(1, "a")], [end(1, {"a": 1}), end(1, {"a": 1}, 150)], "COMPLETE", (1, 0, 0, 0)),
]


@pytest.mark.parametrize("name,rows,records,verdict,counts", CASES, ids=[c[0] for c in CASES])
def test_verdicts(spark, name, rows, records, verdict, counts):
    log = spark.createDataFrame([(1, t, i, 10, f"{t}{i}") for i, t in rows], ROWS)
    verdicts = boundaries.tx_verdicts(log, spark.createDataFrame(records, RECORDS))
    got = {r["tx_id"]: r for r in verdicts.collect()}[1]
    assert got["verdict"] == verdict and (got["rows"], got["missing"], got["repeated"], got["late"]) == counts
    released = boundaries.release(log, verdicts).orderBy("tx_ord").collect()
    if verdict == "COMPLETE":
        assert [r["sub_order"] for r in released] == [r["tx_ord"] for r in released] == sorted({i for i, _ in rows})
    else:
        assert released == []


def test_late_rows_complete_their_transaction(spark):
    log = spark.createDataFrame([(1, "a", 1, 10, "x"), (1, "a", 2, 500, "y"), (1, "a", 1, 600, "x"), (None, "a", 1, 5, "n")], ROWS)
    verdicts = boundaries.tx_verdicts(log, spark.createDataFrame([end(1, {"a": 2})], RECORDS))
    assert tuple(verdicts.first()) == (1, "COMPLETE", 2, 0, 1, 1)
    assert boundaries.release(log, verdicts).count() == 2


def test_release_of_many_and_of_huge_transactions(spark):
    log = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("tx_id"), F.lit("a").alias("tbl"),
                                   F.when(F.col("id") < 2000, F.col("id") + 1).otherwise(1).cast("int").alias("sub_order"), F.col("id").alias("arrival"))
    counts = log.groupBy("tx_id").agg(F.count("*").alias("event_count")).filter("tx_id % 3 = 0").select(
        "tx_id", F.lit("END").alias("kind"), "event_count", F.array(F.struct(F.lit("a").alias("table"), F.col("event_count").alias("n"))).alias("table_counts"),
        F.lit(10**6).alias("arrival"))
    verdicts = boundaries.tx_verdicts(log, counts)
    forms = [boundaries.release(log, verdicts), boundaries.release(log, verdicts, few=5, hot_rows=100, segment_rows=90)]
    rows = [sorted(tuple(r) for r in f.select("tx_id", "sub_order", "tx_ord").collect()) for f in forms]
    assert rows[0] == rows[1] and len(rows[0]) == 2000 + 333 and all(s == o for _, s, o in rows[0])


LOG = "tbl string, op string, key_id long, old_key_id long, before struct<v:string>, after struct<v:string>, pos long, sub_order int, source_ts timestamp"


@pytest.mark.parametrize("form", [{}, {"few_truncates": 0}, {"few_truncates": 0, "hot_rows": 20, "segment_rows": 15}])
def test_rows_at_many_positions(spark, form):
    """Equal to one ``state_as_of`` per position, before and after the changes at it."""
    rng = random.Random(4)
    rows = []
    for pos in range(1, 61):
        op = "t" if pos % 17 == 0 else rng.choice("cuuudp")
        rows.append((rng.choice("ab"), {"p": "pk"}.get(op, op), None if op == "t" else rng.randrange(6), rng.randrange(6) if op == "p" else None,
                     None, None if op in "dt" else (f"v{pos}",), pos, 0, None))
    log = spark.createDataFrame(rows, LOG)
    events = expand.split_pk_update(log)
    probes = [(t, k, pos, 9) for t in "ab" for k in range(6) for pos in range(0, 62, 4)]
    asked = spark.createDataFrame(probes, "tbl string, key_id long, pos long, sub_order int")
    got = {tuple(r)[:3]: (r["was"] and r["was"]["v"], r["was_pos"]) for r in asof.state_at(
        asked, events, materialize.truncates(events), inclusive=True, **form).collect()}
    for pos in range(0, 62, 4):
        state = {(r["tbl"], r["key_id"]): (r["after"]["v"], r["pos"]) for r in materialize.state_as_of(log, pos).collect()} if pos % 12 == 0 else None
        if state is not None:
            assert {(t, k): got[t, k, pos] for t in "ab" for k in range(6) if got[t, k, pos][0]} == state
    assert len(got) == len(probes)
    exclusive = {tuple(r)[:3]: r["was_pos"] for r in asof.state_at(asked.withColumn("sub_order", F.lit(-1)), events, materialize.truncates(events), **form).collect()}
    assert {p: v for p, v in exclusive.items() if p[2] and v is not None and v >= p[2]} == {}


def test_updates_without_a_before_image(spark):
    rows = [("t", "c", 1, None, None, ("a",), 1, 0, None), ("t", "u", 1, None, None, ("b",), 1, 1, None), ("t", "u", 1, None, None, ("c",), 2, 0, None),
            ("t", "t", None, None, None, None, 3, 0, None), ("t", "u", 1, None, None, ("d",), 4, 0, None)]
    events = expand.split_pk_update(spark.createDataFrame(rows, LOG))
    updates = events.filter("op = 'u'").drop("before")
    full = asof.before_images(updates, events, materialize.truncates(events), ["v"])
    assert {r["after"]["v"]: r["before"] and r["before"]["v"] for r in full.collect()} == {"b": "a", "c": "b", "d": None}
