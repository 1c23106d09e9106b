"""Queries over initial and incremental snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import snapshot
from ..sources.fixtures import table
from .registry import committed_log, query

CHUNK = snapshot.CHUNK_ROWS


def order_rows(spark, sf) -> DataFrame:
    """Rows of ``orders`` with the chunk each one belongs to."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        snapshot.chunk_number(k, CHUNK).alias("chunk_id"), k.alias("key_id"), F.col("o_orderstatus").alias("status"))


def window_signals(spark, sf) -> DataFrame:
    """An open and a close signal per chunk; neighbouring windows overlap."""
    ids = order_rows(spark, sf).select("chunk_id").distinct()
    low = F.lit(2_000_000_000) + F.col("chunk_id") * CHUNK
    high = F.lit(2_000_000_000) + (F.col("chunk_id") + 1) * CHUNK + 512
    marks = F.array(
        F.struct(F.lit(snapshot.OPEN).alias("type"), low.alias("pos")), F.struct(F.lit(snapshot.CLOSE).alias("type"), high.alias("pos")))
    return ids.select("chunk_id", F.explode(marks).alias("m")).select("chunk_id", "m.*")


WINDOWS = """
, chunks AS (SELECT o_orderkey // 1024 AS chunk_id, o_orderkey AS key_id, o_orderstatus AS status FROM orders),
windows AS (SELECT DISTINCT chunk_id, 2000000000 + chunk_id * 1024 AS low, 2000000000 + (chunk_id + 1) * 1024 + 512 AS high FROM chunks),
touched AS (SELECT DISTINCT w.chunk_id, l.key_id FROM windows w JOIN committed l
            ON l.tbl = 'orders' AND l.pos > w.low AND l.pos < w.high),
reads AS (SELECT c.* FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.chunk_id = c.chunk_id AND t.key_id = c.key_id))
"""


@query("snapshot_initial", """
SELECT 'orders' AS tbl, 'r' AS op, 'READ' AS event_type, o_orderkey AS key_id, o_custkey AS customer_id, o_orderstatus AS status, TRUE AS snapshot
FROM orders""", shared=False)
def snapshot_initial(spark, sf):
    rows = table(spark, sf, "orders").withColumnsRenamed({"o_custkey": "customer_id", "o_orderstatus": "status"})
    events = snapshot.snapshot_initial(rows, "o_orderkey", ["customer_id", "status"], "orders")
    return events.select("tbl", "op", "event_type", "key_id", "after.*", "snapshot")


@query("snapshot_condition", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'", shared=False)
def snapshot_condition(spark, sf):
    return snapshot.snapshot_condition(
        table(spark, sf, "orders"), "o_totalprice > 100000 AND o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")


@query("signal_parse", """
SELECT 's' || o_orderkey AS id, 'execute-snapshot' AS type, 'incremental' AS snapshot_type, c AS collection,
       CASE WHEN o_orderkey % 2 = 0 THEN 'id > ' || o_orderkey END AS condition
FROM orders, UNNEST(['public.orders', 'public.customers_' || o_custkey]) AS t(c)""", shared=False)
def signal_parse(spark, sf):
    k = F.col("o_orderkey")
    signal = snapshot.snapshot_signal(
        F.array(F.lit("public.orders"), F.concat(F.lit("public.customers_"), "o_custkey")),
        F.when(k % 2 == 0, F.concat(F.lit("id > "), k)), F.concat(F.lit("s"), k))
    return snapshot.parse_signals(table(spark, sf, "orders").select(signal.alias("s")).select("s.*"))


@query("snapshot_windows", WINDOWS + "SELECT * FROM windows")
def snapshot_windows(spark, sf):
    return snapshot.snapshot_windows(window_signals(spark, sf))


REOPENED = """
, chunks AS (SELECT o_orderkey // 1024 AS chunk_id, o_orderkey AS key_id, o_orderstatus AS status FROM orders),
spans AS (SELECT DISTINCT chunk_id, 2000000000 + chunk_id * 1024 AS low, 2000000000 + (chunk_id + 1) * 1024 + 512 AS high FROM chunks),
windows AS (
  SELECT chunk_id, CASE WHEN chunk_id % 4 IN (1, 2) THEN high + 700 ELSE low END AS low,
         CASE chunk_id % 4 WHEN 1 THEN NULL WHEN 2 THEN high + 1400 ELSE high END AS high FROM spans WHERE chunk_id % 4 <> 3)
"""


def reopened_signals(spark, sf) -> DataFrame:
    """By chunk number: 0 one window, 1 closed and opened again, 2 closed twice, 3 no window at all."""
    c = F.col("chunk_id") % 4
    spans = window_signals(spark, sf).filter(c != 3)
    high = F.lit(2_000_000_000) + (F.col("chunk_id") + 1) * CHUNK + 512
    extra = F.array_compact(F.array(
        F.when(c.isin(1, 2), F.struct(F.lit(snapshot.OPEN).alias("type"), (high + 700).alias("pos"))),
        F.when(c == 2, F.struct(F.lit(snapshot.CLOSE).alias("type"), (high + 1400).alias("pos")))))
    again = spans.select("chunk_id").distinct().select("chunk_id", F.explode(extra).alias("m")).select("chunk_id", "m.*")
    return spans.unionByName(again)


@query("snapshot_windows_reopened", REOPENED + "SELECT chunk_id, low, high FROM windows")
def snapshot_windows_reopened(spark, sf):
    return snapshot.snapshot_windows(reopened_signals(spark, sf))


@query("dblog_pending", REOPENED + """
, touched AS (SELECT DISTINCT w.chunk_id, l.key_id FROM windows w JOIN committed l ON l.tbl = 'orders' AND l.pos > w.low AND l.pos < w.high),
reads AS (SELECT c.*, w.low FROM chunks c JOIN windows w ON c.chunk_id = w.chunk_id AND w.high IS NOT NULL
          WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.chunk_id = c.chunk_id AND t.key_id = c.key_id))
SELECT TRUE AS stamped, chunk_id, key_id, status, low AS pos FROM reads
UNION ALL SELECT FALSE, chunk_id, key_id, status, NULL FROM reads""")
def dblog_pending(spark, sf):
    """Chunks without a closed window wait, with and without the stamp."""
    log = committed_log(spark, sf).filter("tbl = 'orders'")
    windows = snapshot.snapshot_windows(reopened_signals(spark, sf))
    reads = lambda stamp: snapshot.dblog_reconcile(
        order_rows(spark, sf), log, windows, chunk_of=snapshot.chunk_number("key_id", CHUNK), stamp=stamp)
    rows = reads(False).withColumn("pos", F.lit(None).cast("long"))
    return reads(True).withColumn("stamped", F.lit(True)).unionByName(rows.withColumn("stamped", F.lit(False))).select(
        "stamped", "chunk_id", "key_id", "status", "pos")


@query("chunk_plan", """
SELECT o_orderkey // 1024 AS chunk_id, MIN(o_orderkey) AS first_key, MAX(o_orderkey) AS last_key, COUNT(*) AS rows,
       o_orderkey // 1024 * 1024 AS low_key, (o_orderkey // 1024 + 1) * 1024 AS high_key
FROM orders GROUP BY o_orderkey // 1024""", shared=False)
def chunk_plan(spark, sf):
    return snapshot.chunk_plan(table(spark, sf, "orders"), "o_orderkey")


@query("chunk_plan_exact", """
WITH n AS (SELECT event_id, (ROW_NUMBER() OVER (ORDER BY event_id) - 1) // 1024 AS chunk_id FROM events)
SELECT chunk_id, MIN(event_id) AS first_key, MAX(event_id) AS last_key, COUNT(*) AS rows FROM n GROUP BY chunk_id""", shared=False)
def chunk_plan_exact(spark, sf):
    """Cut into segments even at this size."""
    return snapshot.chunk_plan_exact(table(spark, sf, "events"), "event_id", hot_rows=1000, segment_rows=1000)


@query("dblog_reconcile", WINDOWS + "SELECT chunk_id, key_id, status, 'r' AS op, 'READ' AS event_type FROM reads")
def dblog_reconcile(spark, sf):
    log = committed_log(spark, sf).filter("tbl = 'orders'")
    windows = snapshot.snapshot_windows(window_signals(spark, sf))
    return snapshot.dblog_reconcile(order_rows(spark, sf), log, windows, chunk_of=snapshot.chunk_number("key_id", CHUNK))


@query("dblog_reconcile_lookup", WINDOWS + "SELECT chunk_id, key_id, status FROM reads")
def dblog_reconcile_lookup(spark, sf):
    """The same with the chunk of a key looked up, as needed for chunks of exact size."""
    log = committed_log(spark, sf).filter("tbl = 'orders'")
    windows = snapshot.snapshot_windows(window_signals(spark, sf))
    return snapshot.dblog_reconcile(order_rows(spark, sf), log, windows).select("chunk_id", "key_id", "status")


@query("snapshot_merge", WINDOWS + """
SELECT chunk_id, key_id, 'r' AS op, NULL::BIGINT AS pos, status FROM reads
UNION ALL SELECT NULL, key_id, op, pos, a_status FROM committed WHERE tbl = 'orders'""")
def snapshot_merge(spark, sf):
    log = committed_log(spark, sf).filter("tbl = 'orders'")
    reads = dblog_reconcile(spark, sf).drop("event_type")
    return snapshot.merge_snapshot(reads, log.select("key_id", "op", "pos", F.col("after.status").alias("status"))).select(
        "chunk_id", "key_id", "op", "pos", "status")


@query("snapshot_progress", """
WITH p AS (SELECT o_orderkey // 1024 AS chunk_id, COUNT(*) AS rows FROM orders GROUP BY 1),
d AS (SELECT chunk_id, 0.05 + (chunk_id % 5) * 0.01 AS seconds FROM p WHERE chunk_id % 3 <> 0)
SELECT COUNT(*) AS chunks, COUNT(d.seconds) AS chunks_done, CAST(SUM(CASE WHEN d.seconds IS NOT NULL THEN rows ELSE 0 END) AS BIGINT) AS rows_done,
       round(COUNT(d.seconds) * 100 / COUNT(*), 2) AS percent,
       round(SUM(CASE WHEN d.seconds IS NOT NULL THEN rows ELSE 0 END) / CAST(SUM(d.seconds) AS DOUBLE), 2) AS rows_per_second
FROM p LEFT JOIN d USING (chunk_id)""", shared=False)
def snapshot_progress(spark, sf):
    plan = snapshot.chunk_plan(table(spark, sf, "orders"), "o_orderkey")
    done = plan.filter("chunk_id % 3 <> 0").select("chunk_id", (0.05 + F.col("chunk_id") % 5 * 0.01).alias("seconds"))
    return snapshot.snapshot_progress(plan, done)
