"""Queries over transactions, expansion, joins, compaction and table state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.routing import event_id, partition_of, topic_name
from ..operators import commit, expand, materialize
from ..operators.transforms import gtid_source_filter
from ..sources import fixtures
from ..sources.fixtures import change_log, ddl_log, table, transactions
from .registry import committed_log, flat, query, split_log

FIELDS = ("customer_id", "status", "amount_cents")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Split log with tombstones, topic and partition."""
    rows = expand.delete_tombstones(split_log(spark, sf))
    topic = topic_name(F.lit("local"), F.lit("ecommerce"), F.lit("orders_db"), F.lit("public"), F.col("tbl"))
    return rows.withColumns({"topic": topic, "partition": partition_of(F.coalesce("key_id", F.lit(0)))})


@query("materialize_table", "SELECT tbl, key_id, a_customer_id AS customer_id, a_status AS status, a_amount_cents AS amount_cents, pos FROM state")
def materialize_table(spark, sf):
    log = change_log(spark, sf)
    return materialize.materialize(log, transactions(log)).select("tbl", "key_id", *flat("", "after"), "pos")


@query("table_state_summary", """
SELECT tbl, a_status AS status, COUNT(*) AS rows, CAST(SUM(a_amount_cents) AS BIGINT) AS amount_cents FROM state GROUP BY tbl, a_status""")
def table_state_summary(spark, sf):
    return materialize_table(spark, sf).groupBy("tbl", "status").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("amount_cents").alias("amount_cents"))


AS_OF = 2_500_000_000


@query("state_as_of", f"""
, upto AS (SELECT * FROM split WHERE pos <= {AS_OF} AND key_id IS NOT NULL),
bar AS (SELECT tbl, MAX(pos) AS tpos FROM truncs WHERE pos <= {AS_OF} GROUP BY tbl),
l AS (SELECT u.* FROM upto u LEFT JOIN bar b ON u.tbl = b.tbl WHERE b.tpos IS NULL OR u.pos > b.tpos
      QUALIFY ROW_NUMBER() OVER (PARTITION BY u.tbl, u.key_id ORDER BY u.pos DESC, u.sub_order DESC) = 1)
SELECT tbl, key_id, a_customer_id AS customer_id, a_status AS status, a_amount_cents AS amount_cents, pos FROM l WHERE op <> 'd'""")
def state_as_of(spark, sf):
    log = change_log(spark, sf)
    return materialize.state_as_of(log, AS_OF, transactions(log)).select("tbl", "key_id", *flat("", "after"), "pos")


@query("committed_only", "SELECT tbl, op, key_id, pos, tx_id FROM committed")
def committed_only(spark, sf):
    return committed_log(spark, sf).select("tbl", "op", "key_id", "pos", "tx_id")


@query("rollback_leaks", """
SELECT c.tbl, COUNT(*) AS aborted_in_log,
       CAST(COUNT(*) FILTER (WHERE c.pos IN (SELECT pos FROM committed e WHERE e.tbl = c.tbl)) AS BIGINT) AS leaked
FROM change_log c JOIN tx ON c.tx_id = tx.tx_id AND tx.status = 'ABORTED' GROUP BY c.tbl""")
def rollback_leaks(spark, sf):
    log = change_log(spark, sf)
    tx = transactions(log)
    return commit.rollback_audit(log, commit.committed_only(log, tx), tx)


@query("split_pk_update", """
SELECT tbl, op, key_id, pos, sub_order, b_status, a_status, a_amount_cents FROM split""")
def split_pk_update(spark, sf):
    return split_log(spark, sf).select(
        "tbl", "op", "key_id", "pos", "sub_order", F.col("before.status").alias("b_status"),
        F.col("after.status").alias("a_status"), F.col("after.amount_cents").alias("a_amount_cents"))


@query("delete_tombstone", "SELECT tbl, op, key_id, pos, sub_order, tombstone, a_status FROM messages")
def delete_tombstone(spark, sf):
    return expand.delete_tombstones(split_log(spark, sf)).select(
        "tbl", "op", "key_id", "pos", "sub_order", "tombstone", F.col("after.status").alias("a_status"))


@query("drop_tombstones", "SELECT tbl, op, key_id, pos, sub_order FROM messages WHERE NOT tombstone")
def drop_tombstones(spark, sf):
    rows = expand.delete_tombstones(split_log(spark, sf))
    return expand.drop_tombstones(rows).select("tbl", "op", "key_id", "pos", "sub_order")


@query("assign_offsets", 'SELECT topic, partition, "offset", key_id, op, tombstone, pos, sub_order FROM offsets')
def assign_offsets(spark, sf):
    return expand.assign_offsets(messages(spark, sf)).select(
        "topic", "partition", "offset", "key_id", "op", "tombstone", "pos", "sub_order")


@query("tx_order", """
SELECT tx_id, tbl, pos, key_id, ROW_NUMBER() OVER (PARTITION BY tx_id ORDER BY pos, tbl, key_id) AS tx_ord FROM committed""")
def tx_order(spark, sf):
    return commit.tx_order(committed_log(spark, sf)).select("tx_id", "tbl", "pos", "key_id", "tx_ord")


@query("truncate_counts", """
, seen AS (
  SELECT s.tbl, t.pos AS truncate_pos, s.op, s.key_id FROM truncs t JOIN split s
    ON s.tbl = t.tbl AND s.key_id IS NOT NULL AND s.pos < t.pos
   AND NOT EXISTS (SELECT 1 FROM truncs p WHERE p.tbl = t.tbl AND p.pos < t.pos AND p.pos > s.pos)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY s.tbl, t.pos, s.key_id ORDER BY s.pos DESC, s.sub_order DESC) = 1)
SELECT t.tbl, t.pos AS truncate_pos, COUNT(s.key_id) AS purged
FROM truncs t LEFT JOIN seen s ON s.tbl = t.tbl AND s.truncate_pos = t.pos AND s.op <> 'd' GROUP BY t.tbl, t.pos""")
def truncate_counts(spark, sf):
    events = split_log(spark, sf)
    return materialize.truncate_counts(events, materialize.truncates(events)).select("tbl", "truncate_pos", "purged")


@query("truncate_barrier", "SELECT tbl, op, key_id, pos, sub_order FROM after_barrier")
def truncate_barrier(spark, sf):
    events = split_log(spark, sf)
    return materialize.truncate_barrier(events, materialize.truncates(events)).select("tbl", "op", "key_id", "pos", "sub_order")


@query("update_lookup", """
SELECT u.tbl, u.key_id, u.pos, u.a_status AS partial_status, s.a_customer_id AS customer_id, s.a_status AS status,
       s.a_amount_cents AS amount_cents
FROM committed u LEFT JOIN state s ON u.tbl = s.tbl AND u.key_id = s.key_id WHERE u.op = 'u'""")
def update_lookup(spark, sf):
    log = change_log(spark, sf)
    tx = transactions(log)
    updates = commit.committed_only(log.filter("op = 'u'"), tx).select(
        "tbl", "key_id", "pos", F.col("after.status").alias("partial_status"))
    full = materialize.update_lookup(updates, materialize.materialize(log, tx))
    return full.select("tbl", "key_id", "pos", "partial_status", *flat("", "full"))


@query("idempotent_apply", """
SELECT DISTINCT event_id, user_id, event_type FROM events WHERE event_id % 4 <> 0""")
def idempotent_apply(spark, sf):
    events = table(spark, sf, "events")
    delivered = events.unionByName(events.filter("event_id % 10 = 0"))
    ledger = events.filter("event_id % 4 = 0").select("event_id")
    return materialize.idempotent_apply(delivered, ledger).select("event_id", "user_id", "event_type")


@query("dedupe_events", "SELECT event_id, user_id, event_type, value FROM events")
def dedupe_events(spark, sf):
    events = table(spark, sf, "events")
    return materialize.dedupe_events(events.unionByName(events.filter("event_id % 10 = 0"))).select(
        "event_id", "user_id", "event_type", "value")


@query("compact_log", """
SELECT tbl, op, key_id, pos, a_status AS status FROM split
QUALIFY ROW_NUMBER() OVER (PARTITION BY tbl, key_id ORDER BY pos DESC, sub_order DESC) = 1 AND op <> 'd'""")
def compact_log(spark, sf):
    slim = split_log(spark, sf).select("tbl", "op", "key_id", "pos", "sub_order", F.col("after.status").alias("status"))
    return materialize.compact_log(slim).select("tbl", "op", "key_id", "pos", "status")


@query("retention_filter", """
SELECT tbl, op, key_id, pos FROM committed WHERE source_ts >= (SELECT MAX(source_ts) FROM committed) - INTERVAL 7 DAY""")
def retention_filter(spark, sf):
    return materialize.retention_filter(committed_log(spark, sf), "source_ts").select("tbl", "op", "key_id", "pos")


@query("net_changes", """
, f AS (SELECT tbl, key_id, b_status FROM split WHERE key_id IS NOT NULL
        QUALIFY ROW_NUMBER() OVER (PARTITION BY tbl, key_id ORDER BY pos, sub_order) = 1),
fb AS (SELECT s.tbl, s.key_id, s.b_customer_id IS NOT NULL AS has_b FROM split s WHERE key_id IS NOT NULL
       QUALIFY ROW_NUMBER() OVER (PARTITION BY tbl, key_id ORDER BY pos, sub_order) = 1),
l AS (SELECT tbl, key_id, a_customer_id IS NOT NULL AS has_a, a_status, a_amount_cents FROM split WHERE key_id IS NOT NULL
      QUALIFY ROW_NUMBER() OVER (PARTITION BY tbl, key_id ORDER BY pos DESC, sub_order DESC) = 1),
n AS (SELECT tbl, key_id, COUNT(*) AS events FROM split WHERE key_id IS NOT NULL GROUP BY tbl, key_id)
SELECT l.tbl, l.key_id, n.events, CASE WHEN has_b AND has_a THEN 'u' WHEN has_a THEN 'c' ELSE 'd' END AS net_op,
       f.b_status, l.a_status, l.a_amount_cents
FROM l JOIN fb USING (tbl, key_id) JOIN f USING (tbl, key_id) JOIN n USING (tbl, key_id) WHERE has_a OR has_b""")
def net_changes(spark, sf):
    return materialize.net_changes(split_log(spark, sf)).select(
        "tbl", "key_id", "events", "net_op", F.col("before.status").alias("b_status"),
        F.col("after.status").alias("a_status"), F.col("after.amount_cents").alias("a_amount_cents"))


NET_FROM = 1_500_000_000


@query("net_changes_since", f"""
, span AS (SELECT * FROM split WHERE key_id IS NOT NULL AND pos > {NET_FROM}),
f AS (SELECT * FROM span QUALIFY ROW_NUMBER() OVER (PARTITION BY tbl, key_id ORDER BY pos, sub_order) = 1),
l AS (SELECT * FROM span QUALIFY ROW_NUMBER() OVER (PARTITION BY tbl, key_id ORDER BY pos DESC, sub_order DESC) = 1)
SELECT l.tbl, l.key_id, f.b_status, l.a_status,
       CASE WHEN f.b_customer_id IS NOT NULL AND l.a_customer_id IS NOT NULL THEN 'u' WHEN l.a_customer_id IS NOT NULL THEN 'c' ELSE 'd' END AS net_op
FROM f JOIN l USING (tbl, key_id) WHERE f.b_customer_id IS NOT NULL OR l.a_customer_id IS NOT NULL""")
def net_changes_since(spark, sf):
    span = split_log(spark, sf).filter(F.col("pos") > NET_FROM)
    return materialize.net_changes(span).select(
        "tbl", "key_id", F.col("before.status").alias("b_status"), F.col("after.status").alias("a_status"), "net_op")


@query("change_history", """
, linked AS (
  SELECT *, LEAD(pos) OVER w AS npos, LEAD(source_ts) OVER w AS nts FROM split WHERE key_id IS NOT NULL
  WINDOW w AS (PARTITION BY tbl, key_id ORDER BY pos, sub_order)),
cut AS (
  SELECT l.*, (SELECT MIN(t.pos) FROM truncs t WHERE t.tbl = l.tbl AND t.pos > l.pos) AS cpos FROM linked l WHERE op <> 'd')
SELECT c.tbl, c.key_id, c.op, c.pos, c.a_status AS status, CAST(c.source_ts AS VARCHAR) AS valid_from,
       CAST(CASE WHEN cpos IS NOT NULL AND (npos IS NULL OR cpos < npos)
            THEN (SELECT t.source_ts FROM truncs t WHERE t.tbl = c.tbl AND t.pos = c.cpos) ELSE nts END AS VARCHAR) AS valid_to
FROM cut c""")
def change_history(spark, sf):
    slim = split_log(spark, sf).select(
        "tbl", "op", "key_id", "pos", "sub_order", "source_ts", F.col("after.status").alias("status"))
    rows = materialize.change_history(slim, materialize.truncates(slim))
    return rows.select("tbl", "key_id", "op", "pos", "status",
                       F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))


@query("status_transitions", """
SELECT tbl, key_id, pos, b_status AS old_value, a_status AS new_value, CAST(source_ts AS VARCHAR) AS source_ts
FROM committed WHERE op = 'u' AND b_status IS DISTINCT FROM a_status""")
def status_transitions(spark, sf):
    updates = committed_log(spark, sf).filter("op = 'u'")
    return materialize.transitions(updates, "status", FIELDS).withColumn("source_ts", F.col("source_ts").cast("string"))


@query("search_feed", """
SELECT tbl, key_id, CASE WHEN op = 'd' THEN 'REMOVE' ELSE 'UPSERT' END AS action, pos, a_status AS status FROM last_event
UNION ALL SELECT tbl, NULL, 'CLEAR', MAX(pos), NULL FROM truncs GROUP BY tbl
UNION ALL SELECT tbl, NULL, 'MAPPING_UPDATE', pos, NULL FROM ddl_log""")
def search_feed(spark, sf):
    rows = split_log(spark, sf)
    events = rows.unionByName(ddl_log(spark, sf), allowMissingColumns=True)
    return materialize.search_feed(events, materialize.truncates(rows)).select(
        "tbl", "key_id", "action", "pos", F.col("after.status").alias("status"))


@query("position_order", "SELECT tbl, key_id, op, pos, sub_order FROM split")
def position_order(spark, sf):
    return materialize.position_order(split_log(spark, sf).select("tbl", "key_id", "op", "pos", "sub_order"))


@query("recent_events", """
SELECT tbl, op, key_id, pos FROM committed ORDER BY pos DESC, tbl LIMIT 25""")
def recent_events(spark, sf):
    return materialize.recent_events(committed_log(spark, sf)).select("tbl", "op", "key_id", "pos")


@query("event_ids", """
SELECT 'evt_' || substr(sha256(concat_ws('|', 'postgres', tbl, CAST(pos AS VARCHAR), CAST(sub_order AS VARCHAR))), 1, 26) AS event_id,
       tbl, pos, sub_order FROM split""")
def event_ids(spark, sf):
    return split_log(spark, sf).select(
        event_id(F.lit("postgres"), F.col("tbl"), F.col("pos"), F.col("sub_order")).alias("event_id"), "tbl", "pos", "sub_order")


@query("gtid_source_filter", """
SELECT event_id, mariadb_gtid, CASE WHEN event_id % 7 = 0 THEN 'DDL_ADD_COL' ELSE 'u' END AS op FROM positions
WHERE event_id % 7 = 0 OR user_id % 3 IN (0, 2)""")
def gtid_source_filter_query(spark, sf):
    from ..functions.positions import parse_mariadb_gtid
    rows = fixtures.positions(spark, sf).select(
        "event_id", "mariadb_gtid", F.when(F.col("event_id") % 7 == 0, "DDL_ADD_COL").otherwise("u").alias("op"))
    return gtid_source_filter(rows, [0, 2], parse_mariadb_gtid(F.col("mariadb_gtid"))["domain"])
