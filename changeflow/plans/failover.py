"""Positions of several servers: the state after failovers, and arithmetic on sets of executed positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import materialize, position_sets
from ..sources import engines
from ..sources.engines import Source
from ..sources.fixtures import table
from .registry import query

A, B = "3e11fa47-71ca-11e1-9e33-c80aa9429562", "9d1c2b3a-0000-11ee-be56-0242ac120002"


def _image(status: Column) -> Column:
    return F.struct(F.col("o_orderkey").cast("string").alias("id"), status.alias("status"))


def failover_log(spark, sf) -> DataFrame:
    """Orders are created on server A (high numbers), every second one is updated on B (low numbers) after a failover, every
    sixth deleted on A again. Every tenth create is delivered once more while B is in charge."""
    k = F.col("o_orderkey")
    t = F.floor(k / 10)
    row = _image(F.col("o_orderstatus"))
    none = F.when(F.lit(False), row)
    step = lambda given, server, seq, at, op, after: F.when(given, F.struct(
        F.concat_ws(":", F.lit(server), seq.cast("string")).alias("gtid"), (at + t).alias("at"), F.lit(op).alias("op"), after.alias("after")))
    steps = F.array_compact(F.array(
        step(F.lit(True), A, t + 900_000, F.lit(0), "INSERT", row),
        step(k % 2 == 0, B, t + 5, F.lit(1_000_000_000), "UPDATE", _image(F.lit("SHIPPED"))),
        step(k % 10 == 1, A, t + 900_000, F.lit(1_500_000_000), "INSERT", row),
        step(k % 6 == 0, A, t + 3_000_000_000, F.lit(2_000_000_000), "DELETE", none)))
    rows = table(spark, sf, "orders").select("o_orderkey", F.explode(steps).alias("s"))
    before = F.when(F.col("s.op") != "INSERT", F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit("seen").alias("status")))
    return rows.select(
        F.lit("orders").alias("table"), "s.op", "s.gtid", before.alias("before"), "s.after", (F.col("o_orderkey") % 10).cast("int").alias("row_ord"),
        F.timestamp_seconds("s.at").alias("capture_ts"))


@query("gtid_set_state", """
SELECT '{"id":"' || o_orderkey || '"}' AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'SHIPPED' ELSE o_orderstatus END AS status
FROM orders WHERE o_orderkey % 6 <> 0""", shared=False)
def gtid_set_state(spark, sf):
    """State over two failovers: B's low numbers win over A's high ones, and a late repetition does not come back."""
    log = engines.from_envelope(engines.normalize("mysql", failover_log(spark, sf), Source("shop", ["id"])))
    return materialize.materialize(log).select(F.col("key_id").alias("key"), F.col("after")["status"].alias("status"))


def executed(spark, sf) -> DataFrame:
    """Positions of a primary: one per event, three servers."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("srv-"), (F.col("user_id") % 3).cast("string")).alias("server"), F.floor(F.col("event_id") / 2).alias("seq"), "event_id")


_POSITIONS = """
WITH p AS (SELECT 'srv-' || (user_id % 3) AS server, event_id // 2 AS seq, event_id FROM events),
a AS (SELECT DISTINCT server, seq FROM p WHERE event_id % 50 <> 7),
b AS (SELECT DISTINCT server, seq FROM p WHERE event_id % 11 <> 3)
"""
_ISLANDS = """SELECT server, MIN(seq) AS low, MAX(seq) AS high
FROM (SELECT server, seq, seq - ROW_NUMBER() OVER (PARTITION BY server ORDER BY seq) AS island FROM {0}) GROUP BY server, island"""


def _two_sets(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = executed(spark, sf)
    return tuple(position_sets.positions_to_set(rows.filter(F.col("event_id") % m != r)) for m, r in ((50, 7), (11, 3)))


@query("gtid_set_intervals", _POSITIONS + _ISLANDS.format("a"), shared=False)
def gtid_set_intervals(spark, sf):
    return _two_sets(spark, sf)[0]


@query("gtid_set_difference", _POSITIONS + ", d AS (SELECT * FROM a EXCEPT SELECT * FROM b) " + _ISLANDS.format("d"), shared=False)
def gtid_set_difference(spark, sf):
    """What a replica still lacks."""
    return position_sets.difference(*_two_sets(spark, sf))


@query("gtid_set_union", _POSITIONS + ", d AS (SELECT * FROM a UNION SELECT * FROM b) " + _ISLANDS.format("d"), shared=False)
def gtid_set_union(spark, sf):
    return position_sets.union(*_two_sets(spark, sf))


@query("gtid_set_missing", _POSITIONS + """
SELECT server, COUNT(*) AS positions, COUNT(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.server = a.server AND b.seq = a.seq)) AS missing,
       COUNT(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.server = a.server AND b.seq = a.seq)) = 0 AS contained
FROM a GROUP BY server""", shared=False)
def gtid_set_missing(spark, sf):
    """By server: is everything that the primary has executed on the replica too?"""
    left, right = _two_sets(spark, sf)
    named = [s.withColumn("node", F.col("server")) for s in (left, right)]
    return position_sets.missing_from(*named, ["node"]).withColumnRenamed("node", "server")


@query("gtid_set_text", _POSITIONS + """
, i AS (""" + _ISLANDS.format("b") + """)
SELECT server, server || ':' || string_agg(CASE WHEN low = high THEN CAST(low AS VARCHAR) ELSE low || '-' || high END, ':' ORDER BY low) AS positions
FROM i GROUP BY server""", shared=False)
def gtid_set_text(spark, sf):
    """Sets as text, read back and written again."""
    sets = position_sets.set_text(_two_sets(spark, sf)[1].withColumn("node", F.col("server")), ["node"])
    parsed = sets.select(F.explode(position_sets.parse_position_set(F.col("positions"))).alias("i")).select("i.*")
    return position_sets.set_text(parsed.withColumn("node", F.col("server")), ["node"]).select(F.col("node").alias("server"), "positions")


@query("gtid_not_executed", _POSITIONS + """
SELECT p.event_id, p.server, p.seq FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.server = p.server AND b.seq = p.seq)""", shared=False)
def gtid_not_executed(spark, sf):
    """Events that a replica has still to apply."""
    return position_sets.not_executed(executed(spark, sf), _two_sets(spark, sf)[1]).select("event_id", "server", "seq")
