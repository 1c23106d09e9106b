"""Truncates and rows of one transaction: the place in the transaction decides, as all of it has one position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import commit, expand, materialize
from ..session import work_path
from ..sources import sinks
from ..sources.fixtures import table
from ..streaming import jobs
from .registry import query
from .streams import staged

# Where a transaction truncates its table, by its number modulo four: between its rows, before them, not at all, after them.
TRUNCATE_AT = {0: 25, 1: 0, 3: 100}
MOVED = 1000


def staging_log(spark, sf) -> DataFrame:
    """Ten orders to a transaction, which has one position, over forty tables. An order is created, and by its key
    updated, moved to another key or deleted; most transactions truncate their table too."""
    k = F.col("o_orderkey")
    t, d = F.floor(k / 10), k % 10
    row = F.col("o_orderstatus")
    change = lambda place, op, status, key=F.lit(0), given=F.lit(True): F.when(given, F.struct(
        F.lit(op).alias("op"), (5 * d + place).cast("int").alias("sub_order"), key.cast("long").alias("shift"), status.alias("status")))
    moved = k % 3 == 0
    none = F.lit(None).cast("string")
    changes = F.array_compact(F.array(
        change(1, "c", row), change(2, "u", F.lit("SHIPPED"), given=k % 4 == 0), change(3, "pk", F.lit("MOVED"), F.lit(MOVED), moved),
        change(4, "d", none, given=(k % 7 == 0) & ~moved)))
    base = table(spark, sf, "orders").select(t.alias("pos"), d.alias("d"), F.explode(changes).alias("c"))
    key = F.floor(F.col("pos") / 40) % 2 * 100 + F.col("d")
    rows = base.select(
        F.concat(F.lit("stage_"), F.col("pos") % 40).alias("tbl"), "c.op", (key + F.col("c.shift")).alias("key_id"),
        F.when(F.col("c.op") == "pk", key).alias("old_key_id"), F.when(F.col("c.op") != "c", F.struct(F.lit("seen").alias("status"))).alias("before"),
        F.when(F.col("c.op") != "d", F.struct("c.status")).alias("after"), "pos", "c.sub_order")
    place = F.when(F.col("pos") % 4 == 0, TRUNCATE_AT[0]).when(F.col("pos") % 4 == 1, TRUNCATE_AT[1]).otherwise(TRUNCATE_AT[3])
    cleared = rows.filter("pos % 4 <> 2").select("tbl", "pos").distinct().select("tbl", F.lit("t").alias("op"), "pos", place.alias("sub_order"))
    log = rows.unionByName(cleared, allowMissingColumns=True).withColumn("tx_id", F.col("pos"))
    return log.withColumn("source_ts", F.timestamp_millis(F.col("pos") * 1000 + F.col("sub_order")))


STAGING = f"""
WITH b AS (
  SELECT 'stage_' || (t % 40) AS tbl, t AS pos, t // 40 % 2 * 100 + k % 10 AS key, k, k % 10 AS d, s
  FROM (SELECT o_orderkey AS k, o_orderkey // 10 AS t, o_orderstatus AS s FROM orders)),
e AS (
  SELECT tbl, 'c' AS op, key AS key_id, NULL AS old, pos, 5 * d + 1 AS ord, s AS status FROM b
  UNION ALL SELECT tbl, 'u', key, NULL, pos, 5 * d + 2, 'SHIPPED' FROM b WHERE k % 4 = 0
  UNION ALL SELECT tbl, 'pk', key + {MOVED}, key, pos, 5 * d + 3, 'MOVED' FROM b WHERE k % 3 = 0
  UNION ALL SELECT tbl, 'd', key, NULL, pos, 5 * d + 4, NULL FROM b WHERE k % 7 = 0 AND k % 3 <> 0
  UNION ALL SELECT DISTINCT tbl, 't', NULL, NULL, pos, CASE pos % 4 WHEN 0 THEN {TRUNCATE_AT[0]} WHEN 1 THEN {TRUNCATE_AT[1]} ELSE {TRUNCATE_AT[3]} END, NULL
    FROM b WHERE pos % 4 <> 2),
s AS (
  SELECT tbl, op, key_id, pos, ord * 2 AS sub, status, pos * 1000 + ord AS mark FROM e WHERE op <> 'pk'
  UNION ALL SELECT tbl, 'd', old, pos, ord * 2, NULL, pos * 1000 + ord FROM e WHERE op = 'pk'
  UNION ALL SELECT tbl, 'c', key_id, pos, ord * 2 + 1, status, pos * 1000 + ord FROM e WHERE op = 'pk'),
c AS (SELECT tbl, pos, sub, mark FROM s WHERE op = 't'),
rows AS (SELECT * FROM s WHERE op <> 't')
"""
STAGING_STATE = STAGING + """
SELECT r.tbl, r.key_id, r.status, r.pos FROM rows r LEFT JOIN (SELECT tbl, MAX(mark) AS mark FROM c GROUP BY tbl) l ON r.tbl = l.tbl
WHERE l.mark IS NULL OR r.mark > l.mark
QUALIFY ROW_NUMBER() OVER (PARTITION BY r.tbl, r.key_id ORDER BY r.pos DESC, r.sub DESC) = 1 AND r.op <> 'd'"""


@query("truncate_same_tx_state", STAGING_STATE, shared=False)
def truncate_same_tx_state(spark, sf):
    state = materialize.materialize(staging_log(spark, sf))
    return state.select("tbl", "key_id", F.col("after.status").alias("status"), "pos")


@query("truncate_same_tx_counts", STAGING + """
, seen AS (
  SELECT r.tbl, r.key_id, r.op, c.pos AS truncate_pos, c.sub AS truncate_sub FROM rows r ASOF JOIN c ON r.tbl = c.tbl AND r.mark < c.mark
  QUALIFY ROW_NUMBER() OVER (PARTITION BY r.tbl, c.mark, r.key_id ORDER BY r.mark DESC, r.sub DESC) = 1)
SELECT c.tbl, c.pos AS truncate_pos, c.sub AS truncate_sub, COUNT(s.key_id) AS purged
FROM c LEFT JOIN seen s ON s.tbl = c.tbl AND s.truncate_pos = c.pos AND s.op <> 'd' GROUP BY c.tbl, c.pos, c.sub""", shared=False)
def truncate_same_tx_counts(spark, sf):
    """Rows that each truncate removed, those before it in its own transaction among them."""
    events = expand.split_pk_update(staging_log(spark, sf))
    return materialize.truncate_counts(events, materialize.truncates(events))


@query("truncate_same_tx_history", STAGING + """
, linked AS (SELECT *, LEAD(mark) OVER (PARTITION BY tbl, key_id ORDER BY mark, sub) AS nxt FROM rows)
SELECT l.tbl, l.key_id, l.pos, l.sub, l.status, epoch_ms(LEAST(l.nxt, c.mark)) AS valid_to
FROM linked l ASOF LEFT JOIN c ON l.tbl = c.tbl AND l.mark < c.mark WHERE l.op <> 'd'""", shared=False)
def truncate_same_tx_history(spark, sf):
    """A version ends with the next one or with a truncate, whichever comes first in the transaction."""
    events = expand.split_pk_update(staging_log(spark, sf))
    rows = materialize.change_history(events, materialize.truncates(events))
    return rows.select("tbl", "key_id", "pos", F.col("sub_order").alias("sub"), F.col("after.status").alias("status"),
                       F.col("valid_to").cast("timestamp_ntz").alias("valid_to"))


@query("stream_truncate_same_tx", STAGING_STATE, shared=False)
def stream_truncate_same_tx(spark, sf):
    """The same state from micro-batches, folded after every second one."""
    path = work_path(spark, "staging")
    jobs.finish(jobs.materialize_stream(staged(staging_log(spark, sf), "staging_topic", 2**20), path, work_path(spark, "ck"), fold_every=2))
    return sinks.read_applied(spark, path).select("tbl", "key_id", F.col("after.status").alias("status"), "pos")


@query("tx_order_in_place", STAGING + """
SELECT pos AS tx_id, tbl, sub, key_id, ROW_NUMBER() OVER (PARTITION BY pos ORDER BY sub) AS tx_ord FROM s""", shared=False)
def tx_order_in_place(spark, sf):
    """Rows of one position are numbered by their place, not by their table or key."""
    events = expand.split_pk_update(staging_log(spark, sf))
    return commit.tx_order(events).select("tx_id", "tbl", F.col("sub_order").alias("sub"), "key_id", "tx_ord")
