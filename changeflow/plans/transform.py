"""Queries over stateless transforms: masking, diffing, wire format, routing and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..envelope import canonical_op, event_type
from ..functions import masking, routing, wire
from ..functions.diffing import diff_fields
from ..operators import transforms
from ..sources.fixtures import change_log, customer_images, ddl_log, image_maps, raw_messages, table
from .registry import committed_log, query, split_log

SALT = masking.SALT


@query("mask_email_hash", f"SELECT key_id, substr(sha256(email || ':{SALT}'), 1, 16) AS masked FROM customer_images")
def mask_email_hash(spark, sf):
    return customer_images(spark, sf).select("key_id", masking.email_hash(F.col("email")).alias("masked"))


CARD_SQL = """CASE WHEN length(regexp_replace({0}, '[^0-9]', '', 'g')) >= 4
  THEN 'XXXX-XXXX-XXXX-' || right(regexp_replace({0}, '[^0-9]', '', 'g'), 4) ELSE 'XXXX-XXXX-XXXX-XXXX' END"""


@query("redact_card", f"SELECT key_id, {CARD_SQL.format('credit_card')} AS card, {CARD_SQL.format('tax_id')} AS tax FROM customer_images")
def redact_card(spark, sf):
    return customer_images(spark, sf).select(
        "key_id", masking.redact_card(F.col("credit_card")).alias("card"), masking.redact_card(F.col("tax_id")).alias("tax"))


@query("mask_static", """
SELECT key_id, CASE WHEN email = '' THEN '' ELSE 'REDACTED_PII' END AS email, 'XXXX-XXXX-XXXX-XXXX' AS credit_card,
       'XXXX-XXXX-XXXX-XXXX' AS tax_id, segment FROM customer_images""")
def mask_static(spark, sf):
    rows = customer_images(spark, sf).select("key_id", "email", "credit_card", "tax_id", "segment")
    return masking.mask_columns(rows, mode=masking.STATIC)


@query("mask_email_pseudonym", "SELECT key_id, substr(sha256(email), 1, 16) || '@masked.com' AS masked FROM customer_images")
def mask_email_pseudonym(spark, sf):
    return customer_images(spark, sf).select("key_id", masking.email_pseudonym(F.col("email")).alias("masked"))


def email_sql(field: str) -> str:
    return f"CASE WHEN {field} = '' THEN '' ELSE substr(sha256({field} || ':{SALT}'), 1, 16) END"


@query("mask_image", f"""
, x AS (SELECT key_id, json_extract_string(after_json, 'email') AS e, json_extract_string(after_json, 'credit_card') AS c,
               json_extract_string(after_json, 'tax_id') AS t, json_extract_string(after_json, 'segment') AS s,
               json_extract_string(after_json, 'loyalty_tier') AS l FROM customer_images)
SELECT key_id, {email_sql('e')} AS email, {CARD_SQL.format('c')} AS credit_card, {CARD_SQL.format('t')} AS tax_id,
       s AS segment, l AS loyalty_tier FROM x""")
def mask_image(spark, sf):
    masked = image_maps(customer_images(spark, sf)).select("key_id", masking.mask_image(F.col("after")).alias("m"))
    return masked.select("key_id", *[
        F.col("m")[f].alias(f) for f in ("email", "credit_card", "tax_id", "segment", "loyalty_tier")])


@query("masked_fields", """
SELECT key_id, CASE WHEN json_extract_string(after_json, 'email') = '' THEN 'credit_card,tax_id' ELSE 'credit_card,email,tax_id' END AS fields
FROM customer_images""")
def masked_fields(spark, sf):
    return image_maps(customer_images(spark, sf)).select(
        "key_id", F.array_join(masking.masked_fields(F.col("after")), ",").alias("fields"))


DIFF_SQL = """array_to_string(list_sort(list_filter(list_distinct(list_concat(json_keys(before_json), json_keys(after_json))),
  lambda k: json_extract_string(before_json, k) IS DISTINCT FROM json_extract_string(after_json, k))), ',')"""


@query("diff_fields", f"SELECT key_id, {DIFF_SQL} AS fields FROM customer_images")
def diff_fields_query(spark, sf):
    return image_maps(customer_images(spark, sf)).select(
        "key_id", F.array_join(diff_fields(F.col("before"), F.col("after")), ",").alias("fields"))


@query("smt_transform", f"""
, x AS (SELECT key_id, {DIFF_SQL} AS diff, json_extract_string(after_json, 'email') AS ae, json_extract_string(before_json, 'email') AS be,
               json_extract_string(after_json, 'credit_card') AS c FROM customer_images)
SELECT key_id, diff, {email_sql('be')} AS before_email, {email_sql('ae')} AS after_email, {CARD_SQL.format('c')} AS after_card,
       CASE WHEN ae = '' THEN 'credit_card,tax_id' ELSE 'credit_card,email,tax_id' END AS masked FROM x""")
def smt_transform(spark, sf):
    out = transforms.smt_transform(image_maps(customer_images(spark, sf)))
    return out.select(
        "key_id", F.array_join("diff_fields", ",").alias("diff"), F.col("before")["email"].alias("before_email"),
        F.col("after")["email"].alias("after_email"), F.col("after")["credit_card"].alias("after_card"),
        F.array_join("masked_fields", ",").alias("masked"))


@query("smt_transform_parity", f"""
, x AS (SELECT key_id, json_extract_string(before_json, 'email') AS be, json_extract_string(after_json, 'email') AS ae,
               json_extract_string(before_json, 'segment') AS bs, json_extract_string(after_json, 'segment') AS s,
               json_extract_string(after_json, 'loyalty_tier') AS l FROM customer_images)
SELECT key_id, be AS before_email, {email_sql('ae')} AS after_email,
       array_to_string(list_filter(['credit_card', CASE WHEN be IS DISTINCT FROM ({email_sql('ae')}) THEN 'email' END,
         CASE WHEN l IS NOT NULL THEN 'loyalty_tier' END, CASE WHEN bs <> s THEN 'segment' END, 'tax_id'],
         lambda v: v IS NOT NULL), ',') AS diff FROM x""")
def smt_transform_parity(spark, sf):
    out = transforms.smt_transform(image_maps(customer_images(spark, sf)), images=("after",), diff_raw=False)
    return out.select("key_id", F.col("before")["email"].alias("before_email"), F.col("after")["email"].alias("after_email"),
                      F.array_join("diff_fields", ",").alias("diff"))


@query("wire_encode", """
SELECT o_orderkey AS key_id, '00' || lpad(hex(CAST(42 + o_orderkey % 3 AS BIGINT)), 8, '0') ||
       hex(concat('{"id":', CAST(o_orderkey AS VARCHAR), ',"status":"', o_orderstatus, '"}')) AS value_hex FROM orders""", shared=False)
def wire_encode(spark, sf):
    k = F.col("o_orderkey")
    payload = F.concat(F.lit('{"id":'), k, F.lit(',"status":"'), F.col("o_orderstatus"), F.lit('"}'))
    return table(spark, sf, "orders").select(k.alias("key_id"), F.hex(wire.wire_encode(42 + k % 3, payload)).alias("value_hex"))


@query("wire_decode", "SELECT key_id, valid, schema_id, body FROM decoded")
def wire_decode(spark, sf):
    return raw_messages(spark, sf).select("key_id", wire.wire_decode(F.unhex("value_hex")).alias("w")).select(
        "key_id", "w.valid", "w.schema_id", F.col("w.payload").cast("string").alias("body"))


@query("route_topic", """
SELECT l_orderkey, l_linenumber, concat_ws('.', 'cdc', 'local', 'ecommerce', db, CASE WHEN sch <> db THEN sch END, tbl) AS topic
FROM (SELECT l_orderkey, l_linenumber, CASE l_suppkey % 3 WHEN 0 THEN 'orders_db' WHEN 1 THEN 'inventory' ELSE 'store' END AS db,
             CASE l_suppkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'inventory' END AS sch, 'lines_' || l_returnflag AS tbl FROM lineitem)""", shared=False)
def route_topic(spark, sf):
    kind = F.col("l_suppkey") % 3
    db = F.when(kind == 0, "orders_db").when(kind == 1, "inventory").otherwise("store")
    schema = F.when(kind == 0, "public").when(kind == 1, "inventory")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        routing.topic_name(F.lit("local"), F.lit("ecommerce"), db, schema, F.concat(F.lit("lines_"), "l_returnflag")).alias("topic"))


@query("route_logical_table", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 4 = 0 THEN 'lines_shard_archive' ELSE 'lines' END AS logical_table,
       CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_suppkey % 16 AS INTEGER) END AS shard FROM lineitem""", shared=False)
def route_logical_table(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn(
        "t", F.when(F.col("l_suppkey") % 4 == 0, "lines_shard_archive").otherwise(F.concat(F.lit("lines_shard_"), F.col("l_suppkey") % 16)))
    return rows.select("l_orderkey", "l_linenumber", routing.logical_table(F.col("t")).alias("logical_table"),
                       routing.shard_id(F.col("t")).alias("shard"))


@query("assign_partition", "SELECT tbl, key_id, pos, CAST(key_id % 3 AS INTEGER) AS partition FROM change_log WHERE key_id IS NOT NULL")
def assign_partition(spark, sf):
    return change_log(spark, sf).filter("key_id IS NOT NULL").select(
        "tbl", "key_id", "pos", routing.partition_of(F.col("key_id")).alias("partition"))


@query("assign_partition_text", """
SELECT page_id, CAST(CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % 3 AS INTEGER) AS partition FROM pages""", shared=False)
def assign_partition_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", routing.partition_of_text(F.col("url")).alias("partition"))


@query("filter_category", """
SELECT 'DML' AS choice, tbl, op, pos FROM change_log
UNION ALL SELECT 'DDL', tbl, op, pos FROM ddl_log
UNION ALL SELECT 'u', tbl, op, pos FROM change_log WHERE op = 'u'
UNION ALL SELECT 'ALL', tbl, op, pos FROM change_log UNION ALL SELECT 'ALL', tbl, op, pos FROM ddl_log""")
def filter_category(spark, sf):
    cols = ("tbl", "op", "pos")
    events = change_log(spark, sf).select(*cols).unionByName(ddl_log(spark, sf).select(*cols))
    out = None
    for choice in ("ALL", "DML", "DDL", "u"):
        one = transforms.filter_category(events, choice).select(F.lit(choice).alias("choice"), *cols)
        out = one if out is None else out.unionByName(one)
    return out


@query("event_category", """
SELECT tbl, op, pos, 'DML' AS category FROM change_log UNION ALL SELECT tbl, op, pos, 'DDL' FROM ddl_log""")
def event_category(spark, sf):
    cols = ("tbl", "op", "pos")
    return transforms.with_category(change_log(spark, sf).select(*cols).unionByName(ddl_log(spark, sf).select(*cols)))


@query("canonical_op", """
, named AS (SELECT tbl, pos, CASE op WHEN 'c' THEN CASE WHEN key_id % 3 = 0 THEN 'INSERT' WHEN key_id % 3 = 1 THEN 'LARGE_TX' ELSE 'CREATE' END
     WHEN 'u' THEN 'UPDATE' WHEN 'd' THEN 'DELETE' WHEN 't' THEN 'TRUNCATE' ELSE 'PK_UPDATE' END AS name, op FROM change_log)
SELECT tbl, pos, name, op, CASE op WHEN 'c' THEN 'CREATE' WHEN 'u' THEN 'UPDATE' WHEN 'd' THEN 'DELETE' WHEN 't' THEN 'TRUNCATE'
     ELSE 'PK_UPDATE' END AS event_type FROM named""")
def canonical_op_query(spark, sf):
    op, third = F.col("op"), F.col("key_id") % 3
    name = (F.when(op == "c", F.when(third == 0, "INSERT").when(third == 1, "LARGE_TX").otherwise("CREATE"))
            .when(op == "u", "UPDATE").when(op == "d", "DELETE").when(op == "t", "TRUNCATE").otherwise("PK_UPDATE"))
    named = change_log(spark, sf).select("tbl", "pos", name.alias("name"))
    code = canonical_op(F.col("name"))
    return named.select("tbl", "pos", "name", code.alias("op"), event_type(code).alias("event_type"))


@query("unwrap_after", """
SELECT tbl, op, key_id, pos, CAST(source_ts AS VARCHAR) AS source_ts, a_customer_id AS customer_id, a_status AS status,
       a_amount_cents AS amount_cents FROM split""")
def unwrap_after(spark, sf):
    rows = split_log(spark, sf).withColumn("source_ts", F.col("source_ts").cast("string"))
    return transforms.unwrap_after(rows, ["tbl", "op", "key_id", "pos", "source_ts"])


@query("extract_key", "SELECT key_id, CAST(key_id AS VARCHAR) AS id, json_extract_string(after_json, 'segment') AS segment FROM customer_images")
def extract_key(spark, sf):
    rows = image_maps(customer_images(spark, sf)).select(
        "key_id", transforms.extract_key(F.col("before"), F.col("after"), ["id", "segment"]).alias("k"))
    return rows.select("key_id", F.col("k")["id"].alias("id"), F.col("k")["segment"].alias("segment"))


@query("compaction_key", """SELECT key_id, '{"id":"' || key_id || '"}' AS compaction_key FROM customer_images""")
def compaction_key(spark, sf):
    rows = image_maps(customer_images(spark, sf))
    key = transforms.extract_key(F.col("before"), F.col("after"), ["id"])
    return rows.select("key_id", transforms.compaction_key(key).alias("compaction_key"))


@query("stamp_metadata", """
SELECT tbl, op, pos, 'debezium-pg-orders' AS connector, 42 AS schema_id, 2 AS schema_version, FALSE AS snapshot,
       'EMITTED_TO_KAFKA' AS status FROM committed""")
def stamp_metadata(spark, sf):
    return transforms.stamp_metadata(committed_log(spark, sf).select("tbl", "op", "pos"), "debezium-pg-orders", 42, 2)


@query("render_payload", """
SELECT tbl, pos, '{"eventId":"evt_' || pos || '","eventType":' ||
  CASE op WHEN 'c' THEN '"CREATE"' WHEN 'u' THEN '"UPDATE"' WHEN 'd' THEN '"DELETE"' WHEN 't' THEN '"TRUNCATE"' ELSE '"PK_UPDATE"' END ||
  ',"source":{"type":"postgres","topic":"' || tbl || '"},"position":{"type":"LSN","value":"' || pos || '"},"key":{"id":' ||
  COALESCE(CAST(key_id AS VARCHAR), 'null') || '},"before":' ||
  CASE WHEN b_customer_id IS NULL THEN 'null' ELSE '{"customer_id":' || b_customer_id || ',"status":"' || b_status || '","amount_cents":' || b_amount_cents || '}' END ||
  ',"after":' ||
  CASE WHEN a_customer_id IS NULL THEN 'null' ELSE '{"customer_id":' || a_customer_id || ',"status":"' || a_status || '","amount_cents":' || a_amount_cents || '}' END ||
  ',"metadata":{"schemaId":43,"schemaVersion":2,"timestamp":"' || CAST(source_ts AS VARCHAR) || '"}}' AS payload
FROM change_log""")
def render_payload(spark, sf):
    pos = F.col("pos").cast("string")
    body = transforms.render_payload(
        F.concat(F.lit("evt_"), pos), event_type(F.col("op")),
        F.struct(F.lit("postgres").alias("type"), F.col("tbl").alias("topic")),
        F.struct(F.lit("LSN").alias("type"), pos.alias("value")),
        F.struct(F.col("key_id").alias("id")), F.col("before"), F.col("after"),
        F.struct(F.lit(43).alias("schemaId"), F.lit(2).alias("schemaVersion"), F.col("source_ts").cast("string").alias("timestamp")))
    return change_log(spark, sf).select("tbl", "pos", body.alias("payload"))


@query("decimal_to_double", """
SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS price,
       CAST(CAST(l_discount AS DECIMAL(6,2)) AS DOUBLE) AS discount FROM lineitem""", shared=False)
def decimal_to_double(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_discount").cast("decimal(6,2)").alias("discount"))
    return transforms.decimals_to_double(rows)


@query("unwrap_schema_payload", "SELECT o_orderkey AS key_id, o_orderkey AS id, o_orderstatus AS status, o_custkey AS customer_id FROM orders", shared=False)
def unwrap_schema_payload(spark, sf):
    k = F.col("o_orderkey")
    payload = F.struct(k.alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer_id"))
    schema = F.struct(F.lit("struct").alias("type"), F.lit("orders").alias("name"))
    docs = table(spark, sf, "orders").select(
        k.alias("key_id"), F.to_json(F.struct(schema.alias("schema"), payload.alias("payload"))).alias("value"))
    return transforms.unwrap_payload(docs, "value", "struct<id:bigint,status:string,customer_id:bigint>")


@query("table_include_filter", "SELECT tbl, op, pos FROM change_log WHERE tbl = 'staging_orders'")
def table_include_filter(spark, sf):
    return transforms.include_tables(
        change_log(spark, sf), "public.customers,public.staging_.*", F.lit("public"), F.col("tbl")).select("tbl", "op", "pos")


