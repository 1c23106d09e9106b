"""Queries over scans, engine dialects, log positions and sequence checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..envelope import ENVELOPE, canonical_mssql_op
from ..functions import positions as pos
from ..operators import continuity
from ..operators.skew import neighbours
from ..session import work_path
from ..sources import engines, readers, sinks
from ..sources.engines import Source
from ..sources.fixtures import change_log, positions, table
from .registry import query
from .state import messages


@query("scan_change_log", """
SELECT 'evt_' || substr(sha256(concat_ws('|', 'postgres', tbl, CAST(pos AS VARCHAR), '0')), 1, 26) AS event_id,
       CASE op WHEN 'c' THEN 'CREATE' WHEN 'u' THEN 'UPDATE' WHEN 'd' THEN 'DELETE' WHEN 't' THEN 'TRUNCATE' ELSE 'PK_UPDATE' END AS event_type,
       tbl, pos, CAST(key_id AS VARCHAR) AS id, b_status, a_status, CAST(a_amount_cents AS VARCHAR) AS a_amount_cents,
       CAST(source_ts AS VARCHAR) AS source_ts FROM change_log""")
def scan_change_log(spark, sf):
    path = work_path(spark, "change_log_json")
    readers.to_envelope(change_log(spark, sf)).write.json(path)
    scanned = readers.scan_changes(spark, path, ENVELOPE, "json")
    return scanned.select(
        "event_id", "event_type", F.col("source.table").alias("tbl"), F.col("pos_ord").cast("long").alias("pos"),
        F.col("key")["id"].alias("id"), F.col("before")["status"].alias("b_status"), F.col("after")["status"].alias("a_status"),
        F.col("after")["amount_cents"].alias("a_amount_cents"), F.col("source_ts").cast("string").alias("source_ts"))


@query("topic_sink", """
SELECT topic, partition, "offset", CASE WHEN key_id IS NULL THEN tbl ELSE '{"id":' || key_id || '}' END AS key, tombstone,
       CASE WHEN NOT tombstone THEN op END AS op, a_status AS status, pos FROM offsets""")
def topic_sink(spark, sf):
    """Every event reaches the topic, those without a key too; values are read back from the files."""
    from ..operators.expand import assign_offsets
    path = work_path(spark, "topics")
    rows = sinks.keyed_messages(assign_offsets(messages(spark, sf)))
    sinks.write_topic(rows.select("topic", "partition", "offset", "key", "value", "headers"), path)
    doc = F.from_json("value", "op string, after struct<status:string>")
    return spark.read.parquet(path).select(
        "topic", "partition", "offset", "key", F.col("value").isNull().alias("tombstone"), doc["op"].alias("op"),
        doc["after"]["status"].alias("status"), F.col("headers")["pos"].cast("long").alias("pos"))


def raw_changes(spark, sf) -> dict[str, tuple[DataFrame, Source]]:
    """Raw changes of the six engines, each derived from one of the given tables."""
    orders, part = table(spark, sf, "orders"), table(spark, sf, "part")
    supplier, customer, pages = (table(spark, sf, t) for t in ("supplier", "customer", "pages"))
    ok, pk, ck = F.col("o_orderkey"), F.col("p_partkey"), F.col("c_custkey")
    order_row = lambda status: F.struct(ok.alias("id"), F.col("o_custkey").alias("customer_id"), status.alias("status"))
    ordinal = ok * 1_000_003
    postgres = orders.select(
        F.lit("orders").alias("table"),
        F.when(ok % 4 != 0, order_row(F.lit("PENDING"))).alias("old_tuple"),
        F.when(ok % 4 != 1, order_row(F.col("o_orderstatus"))).alias("new_tuple"),
        F.concat(F.hex(F.floor(ordinal / 2**32)), F.lit("/"), F.hex(ordinal % 2**32)).alias("lsn"),
        F.floor(ok / 10).alias("tx_id"))
    product = lambda qty: F.struct(pk.cast("string").alias("product_id"), F.col("p_brand").alias("sku"), qty.alias("stock_qty"))
    mysql = part.select(
        F.lit("products").alias("table"), F.lit("UPDATE").alias("op"),
        F.concat(F.lit("3e11fa47-71ca-11e1-9e33-c80aa9429562:"), pk).alias("gtid"),
        F.to_json(product(F.col("p_size"))).alias("before"), F.to_json(product(F.col("p_size") - 1)).alias("after"))
    mariadb = supplier.select(
        F.lit("products").alias("table"), F.lit("c").alias("op"),
        F.concat(F.lit("0-184055-"), F.col("s_suppkey")).alias("gtid"),
        F.struct(F.concat(F.lit("SKU-"), F.col("s_suppkey")).alias("sku"), F.col("s_name").alias("name")).alias("after"))
    invoice = F.struct(ck.alias("INVOICE_ID"), F.col("c_name").alias("VENDOR"), F.lit("APPROVED").alias("STATUS"))
    oracle = customer.select(
        F.lit("FINANCE").alias("owner"), F.lit("INVOICES").alias("table"),
        F.when(ck % 2 == 0, "INSERT").otherwise("DELETE").alias("operation"), (ck + 18934812).cast("string").alias("scn"),
        F.when(ck % 2 == 1, invoice).alias("before"), F.when(ck % 2 == 0, invoice).alias("after"))
    lead = lambda status: F.struct(ck.alias("lead_id"), status.alias("status"))
    change = lambda code, status: F.struct(F.lit(code).alias("operation"), lead(F.lit(status)).alias("columns"))
    codes = F.when(ck % 4 == 1, F.array(change(2, "NEW"))).when(ck % 4 == 2, F.array(change(1, "LOST"))).otherwise(
        F.array(change(3, "NEW"), change(4, "QUALIFIED")))
    sqlserver = customer.select(
        F.lit("Leads").alias("table"),
        F.concat_ws(":", F.lpad(F.hex(ck), 8, "0"), F.lit("00000198"), F.lit("0001")).alias("start_lsn"),
        F.hex(ck).alias("seqval"), F.explode(codes).alias("c")).select("table", "start_lsn", "seqval", "c.*")
    pg = F.col("page_id")
    document = F.struct(F.concat(F.lit("item_"), pg).alias("_id"), F.col("url").alias("name"))
    mongodb = pages.select(
        F.lit("items").alias("collection"),
        F.when(pg % 3 == 0, "insert").when(pg % 3 == 1, "replace").otherwise("delete").alias("operation_type"),
        F.concat(F.lit("8263A29B"), F.lpad(F.hex(pg), 8, "0"), F.lit("2B0229296E04")).alias("token"),
        F.struct(F.concat(F.lit("item_"), pg).alias("_id")).alias("document_key"),
        F.when(pg % 3 != 2, document).alias("full_document"))
    return {
        "postgres": (postgres, Source("orders_db", ["id"], "public", "prod-postgres-cluster", "debezium-pg-orders")),
        "mysql": (mysql, Source("inventory", ["product_id"])),
        "mariadb": (mariadb, Source("store_catalog", ["sku"])),
        "oracle": (oracle, Source("ORCLPDB", ["INVOICE_ID"], "FINANCE", "prod-oracle-rac", "debezium-oracle-finance")),
        "sqlserver": (sqlserver, Source("CRM", ["lead_id"], "dbo", "prod-sqlserver-ag", "debezium-sqlserver-leads")),
        "mongodb": (mongodb, Source("catalog", ["_id"], None, "mongo-replica-set", "debezium-mongo-catalog")),
    }


@query("normalize_engines", """
WITH e AS (
  SELECT 'postgres' AS engine, 'orders' AS tbl, 'public' AS sch, CASE o_orderkey % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'd' ELSE 'u' END AS op,
    'LSN' AS position_type, concat(hex(CAST(FLOOR(o_orderkey * 1000003 / 4294967296) AS BIGINT)), '/', hex((o_orderkey * 1000003) % 4294967296)) AS position,
    CAST(o_orderkey * 1000003 AS VARCHAR) AS pos_ord, '{"id":"' || o_orderkey || '"}' AS key_json,
    CASE WHEN o_orderkey % 4 <> 0 THEN '{"id":"' || o_orderkey || '","customer_id":"' || o_custkey || '","status":"PENDING"}' END AS before_json,
    CASE WHEN o_orderkey % 4 <> 1 THEN '{"id":"' || o_orderkey || '","customer_id":"' || o_custkey || '","status":"' || o_orderstatus || '"}' END AS after_json,
    CAST(CAST(FLOOR(o_orderkey / 10) AS BIGINT) AS VARCHAR) AS tx FROM orders
  UNION ALL
  SELECT 'mysql', 'products', NULL, 'u', 'GTID', '3e11fa47-71ca-11e1-9e33-c80aa9429562:' || p_partkey, CAST(p_partkey AS VARCHAR),
    '{"product_id":"' || p_partkey || '"}', '{"product_id":"' || p_partkey || '","sku":"' || p_brand || '","stock_qty":"' || p_size || '"}',
    '{"product_id":"' || p_partkey || '","sku":"' || p_brand || '","stock_qty":"' || (p_size - 1) || '"}', NULL FROM part
  UNION ALL
  SELECT 'mariadb', 'products', NULL, 'c', 'GTID', '0-184055-' || s_suppkey, CAST(s_suppkey AS VARCHAR), '{"sku":"SKU-' || s_suppkey || '"}', NULL,
    '{"sku":"SKU-' || s_suppkey || '","name":"' || s_name || '"}', NULL FROM supplier
  UNION ALL
  SELECT 'oracle', 'INVOICES', 'FINANCE', CASE c_custkey % 2 WHEN 0 THEN 'c' ELSE 'd' END, 'SCN', CAST(c_custkey + 18934812 AS VARCHAR),
    CAST(c_custkey + 18934812 AS VARCHAR), '{"INVOICE_ID":"' || c_custkey || '"}',
    CASE c_custkey % 2 WHEN 1 THEN '{"INVOICE_ID":"' || c_custkey || '","VENDOR":"' || c_name || '","STATUS":"APPROVED"}' END,
    CASE c_custkey % 2 WHEN 0 THEN '{"INVOICE_ID":"' || c_custkey || '","VENDOR":"' || c_name || '","STATUS":"APPROVED"}' END, NULL FROM customer
  UNION ALL
  SELECT 'sqlserver', 'Leads', 'dbo', CASE c_custkey % 4 WHEN 1 THEN 'c' WHEN 2 THEN 'd' ELSE 'u' END, 'LSN',
    lpad(hex(c_custkey), 8, '0') || ':00000198:0001',
    CAST(CAST(c_custkey AS HUGEINT) * 281474976710656 + 408 * 65536 + 1 AS VARCHAR), '{"lead_id":"' || c_custkey || '"}',
    CASE WHEN c_custkey % 4 = 2 THEN '{"lead_id":"' || c_custkey || '","status":"LOST"}'
         WHEN c_custkey % 4 <> 1 THEN '{"lead_id":"' || c_custkey || '","status":"NEW"}' END,
    CASE WHEN c_custkey % 4 = 1 THEN '{"lead_id":"' || c_custkey || '","status":"NEW"}'
         WHEN c_custkey % 4 <> 2 THEN '{"lead_id":"' || c_custkey || '","status":"QUALIFIED"}' END, NULL FROM customer
  UNION ALL
  SELECT 'mongodb', 'items', NULL, CASE page_id % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'u' ELSE 'd' END, 'RESUME_TOKEN',
    '8263A29B' || lpad(hex(page_id), 8, '0') || '2B0229296E04', NULL, '{"_id":"item_' || page_id || '"}', NULL,
    CASE WHEN page_id % 3 <> 2 THEN '{"_id":"item_' || page_id || '","name":"' || url || '"}' END, NULL FROM pages)
SELECT engine, tbl, sch AS "schema", op, CASE op WHEN 'c' THEN 'CREATE' WHEN 'u' THEN 'UPDATE' ELSE 'DELETE' END AS event_type,
       position_type, position, pos_ord, key_json, before_json, after_json, tx FROM e""", shared=False)
def normalize_engines(spark, sf):
    out = engines.normalize_all(raw_changes(spark, sf))
    return out.select(
        F.col("source.type").alias("engine"), F.col("source.table").alias("tbl"), F.col("source.schema").alias("schema"),
        "op", "event_type", F.col("position.type").alias("position_type"), F.col("position.value").alias("position"),
        F.col("pos_ord").cast("string").alias("pos_ord"), F.to_json("key").alias("key_json"),
        F.to_json("before").alias("before_json"), F.to_json("after").alias("after_json"), F.col("tx.id").alias("tx"))


@query("pair_mssql_updates", """
SELECT c_custkey AS lead_id, CASE c_custkey % 4 WHEN 1 THEN 'c' WHEN 2 THEN 'd' ELSE 'u' END AS op,
       CASE c_custkey % 4 WHEN 1 THEN NULL WHEN 2 THEN 'LOST' ELSE 'NEW' END AS old_status,
       CASE c_custkey % 4 WHEN 1 THEN 'NEW' WHEN 2 THEN NULL ELSE 'QUALIFIED' END AS new_status FROM customer""", shared=False)
def pair_mssql_updates(spark, sf):
    paired = engines.pair_mssql(raw_changes(spark, sf)["sqlserver"][0])
    return paired.select(
        F.coalesce("after.lead_id", "before.lead_id").alias("lead_id"), canonical_mssql_op(F.col("operation")).alias("op"),
        F.col("before.status").alias("old_status"), F.col("after.status").alias("new_status"))


@query("parse_lsn", "SELECT event_id, lsn, lsn_ord AS ordinal FROM positions")
def parse_lsn(spark, sf):
    return positions(spark, sf).select("event_id", "lsn", pos.parse_lsn(F.col("lsn")).cast("long").alias("ordinal"))


@query("parse_gtid", """
SELECT event_id, string_split(gtid, ':')[1] AS server, CAST(string_split(gtid, ':')[2] AS BIGINT) AS seq FROM positions""")
def parse_gtid(spark, sf):
    return positions(spark, sf).select("event_id", pos.parse_gtid(F.col("gtid")).alias("g")).select("event_id", "g.*")


@query("parse_mariadb_gtid", """
SELECT event_id, CAST(string_split(mariadb_gtid, '-')[1] AS BIGINT) AS domain, CAST(string_split(mariadb_gtid, '-')[2] AS BIGINT) AS server,
       CAST(string_split(mariadb_gtid, '-')[3] AS BIGINT) AS seq FROM positions""")
def parse_mariadb_gtid(spark, sf):
    return positions(spark, sf).select("event_id", pos.parse_mariadb_gtid(F.col("mariadb_gtid")).alias("g")).select("event_id", "g.*")


@query("parse_scn", "SELECT event_id, 18934812 + event_id AS scn FROM positions")
def parse_scn(spark, sf):
    text = (F.col("event_id") + 18934812).cast("string")
    return positions(spark, sf).select("event_id", pos.parse_scn(text).cast("long").alias("scn"))


@query("parse_mssql_lsn", """
SELECT event_id, CAST(CAST(event_id AS HUGEINT) * 281474976710656 + CAST(user_id AS HUGEINT) * 65536 + event_id % 16 AS VARCHAR) AS ordinal
FROM positions""")
def parse_mssql_lsn(spark, sf):
    return positions(spark, sf).select("event_id", pos.parse_mssql_lsn(F.col("mssql_lsn")).cast("string").alias("ordinal"))


@query("token_order", """
, t AS (SELECT user_id, concat('8263A29B', lpad(hex(event_id), 8, '0'), '2B0229296E04') AS token FROM positions)
SELECT CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id % 4 END AS part, token,
       LAG(token) OVER (PARTITION BY CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id % 4 END ORDER BY token) AS previous
FROM t""")
def token_order(spark, sf):
    """The token before each token, in groups large enough to be cut; tokens order as text, and one group is NULL."""
    rows = positions(spark, sf).select(
        F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 4).alias("part"),
        F.concat(F.lit("8263A29B"), F.lpad(F.hex("event_id"), 8, "0"), F.lit("2B0229296E04")).alias("token"))
    linked = neighbours(rows, ["part"], ["token"], ["token"], "before", hot_rows=100, segment_rows=50)
    return linked.select("part", "token", F.col("before.token").alias("previous"))


@query("resume_token_order", """
SELECT user_id, MAX(concat('8263A29B', lpad(hex(event_id), 8, '0'), '2B0229296E04')) AS last_token, COUNT(*) AS events
FROM positions GROUP BY user_id""")
def resume_token_order(spark, sf):
    token = F.concat(F.lit("8263A29B"), F.lpad(F.hex("event_id"), 8, "0"), F.lit("2B0229296E04"))
    return positions(spark, sf).groupBy("user_id").agg(F.max(token).alias("last_token"), F.count(F.lit(1)).alias("events"))


@query("gtid_gaps", """
, s AS (SELECT string_split(gtid, ':')[1] AS server, CAST(string_split(gtid, ':')[2] AS BIGINT) AS seq FROM positions WHERE event_id % 50 <> 0),
l AS (SELECT server, seq, LAG(seq) OVER (PARTITION BY server ORDER BY seq) AS prev_seq FROM s)
SELECT server, prev_seq, seq AS next_seq, seq - prev_seq - 1 AS missing FROM l WHERE seq - prev_seq > 1""")
def gtid_gaps(spark, sf):
    # Every 50th event is left out, so that there are gaps to find.
    rows = positions(spark, sf).filter("event_id % 50 <> 0").select(pos.parse_gtid(F.col("gtid")).alias("g")).select("g.*")
    return continuity.sequence_gaps(rows, ["server"], "seq")


@query("key_order_violations", """
, arrived AS (SELECT tbl, key_id, pos, CASE WHEN op = 'u' AND key_id % 10 = 0 THEN pos - 1500000000 ELSE pos END AS arrival
              FROM change_log WHERE key_id IS NOT NULL),
l AS (SELECT *, LAG(pos) OVER (PARTITION BY tbl, key_id ORDER BY arrival) AS prev_pos FROM arrived)
SELECT tbl, key_id, pos, prev_pos FROM l WHERE pos < prev_pos""")
def key_order_violations(spark, sf):
    early = (F.col("op") == "u") & (F.col("key_id") % 10 == 0)
    arrived = change_log(spark, sf).filter("key_id IS NOT NULL").select(
        "tbl", "key_id", "pos", F.when(early, F.col("pos") - 1_500_000_000).otherwise(F.col("pos")).alias("arrival"))
    return continuity.key_order_violations(arrived, ["tbl", "key_id"], "arrival", "pos").select("tbl", "key_id", "pos", "prev_pos")


@query("producer_seq_check", """
, sent AS (SELECT event_id % 4 AS producer, CAST(FLOOR(event_id / 4) AS BIGINT) AS seq FROM events WHERE event_id % 50 <> 0
           UNION ALL SELECT event_id % 4, CAST(FLOOR(event_id / 4) AS BIGINT) FROM events WHERE event_id % 50 <> 0 AND event_id % 10 = 0),
c AS (SELECT producer, seq, COUNT(*) AS copies FROM sent GROUP BY producer, seq),
l AS (SELECT *, COALESCE(seq - LAG(seq) OVER (PARTITION BY producer ORDER BY seq) - 1, 0) AS missing FROM c)
SELECT producer, seq, copies, missing FROM l WHERE copies > 1 OR missing > 0""")
def producer_seq_check(spark, sf):
    sent = table(spark, sf, "events").filter("event_id % 50 <> 0").select(
        "event_id", (F.col("event_id") % 4).alias("producer"), F.floor(F.col("event_id") / 4).alias("seq"))
    delivered = sent.unionByName(sent.filter("event_id % 10 = 0"))
    return continuity.producer_seq_check(delivered, ["producer"], "seq")
