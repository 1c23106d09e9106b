"""Queries over schema versions, verdicts and reads across versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import schema_gov
from ..operators.deadletter import parse_messages
from ..sources.fixtures import change_log, customer_images, ddl_log, raw_messages, table
from .registry import query


def _field(version: int, name: str, kind, has_default: bool = False):
    return F.struct(
        F.lit(version).alias("version"), F.lit(name).alias("field"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), F.lit(has_default).alias("has_default"))


def registry(spark, sf) -> DataFrame:
    """Two versions of one subject per part; the second one changes by the part key:
    0 adds with default, 1 adds without, 2 drops, 3 widens, 4 narrows, 5 stays."""
    k = F.col("p_partkey") % 6
    fields = F.array_compact(F.array(
        _field(1, "id", "int"), _field(1, "amount_cents", F.when(k == 4, "long").otherwise("int")), _field(1, "notes", "string"),
        _field(2, "id", "int"), _field(2, "amount_cents", F.when(k == 3, "long").otherwise("int")),
        F.when(k != 2, _field(2, "notes", "string")),
        F.when(k == 0, _field(2, "priority_level", "string", True)), F.when(k == 1, _field(2, "priority_level", "string", False))))
    return table(spark, sf, "part").select(
        F.concat(F.lit("part_"), "p_partkey", F.lit("-value")).alias("subject"), F.explode(fields).alias("f")).select("subject", "f.*")


REGISTRY = """
WITH registry AS (
  SELECT 'part_' || p_partkey || '-value' AS subject, p_partkey, v.version, v.field,
         CASE WHEN v.field = 'amount_cents' AND ((v.version = 1 AND p_partkey % 6 = 4) OR (v.version = 2 AND p_partkey % 6 = 3)) THEN 'long'
              WHEN v.field IN ('id', 'amount_cents') THEN 'int' ELSE 'string' END AS type,
         v.field = 'priority_level' AND p_partkey % 6 = 0 AS has_default
  FROM part, (VALUES (1, 'id'), (1, 'amount_cents'), (1, 'notes'), (2, 'id'), (2, 'amount_cents'), (2, 'notes'), (2, 'priority_level')) v(version, field)
  WHERE NOT (v.version = 2 AND v.field = 'notes' AND p_partkey % 6 = 2) AND NOT (v.field = 'priority_level' AND p_partkey % 6 > 1)),
diff AS (
  SELECT COALESCE(n.subject, o.subject) AS subject, 2 AS version, COALESCE(n.field, o.field) AS field, o.type AS old_type, n.type AS new_type,
         n.has_default, CASE WHEN o.field IS NULL THEN 'ADDED' WHEN n.field IS NULL THEN 'DROPPED' WHEN o.type <> n.type THEN 'ALTERED' ELSE 'SAME' END AS change
  FROM (SELECT * FROM registry WHERE version = 2) n FULL JOIN (SELECT * FROM registry WHERE version = 1) o USING (subject, field)),
judged AS (
  SELECT *, CASE WHEN change = 'ALTERED' THEN (old_type || '>' || new_type) IN
    ('int>long', 'int>float', 'int>double', 'long>float', 'long>double', 'float>double') END AS widening FROM diff),
verdicts AS (
  SELECT subject, version, NOT bool_or(change = 'DROPPED' OR (change = 'ADDED' AND NOT has_default) OR (change = 'ALTERED' AND NOT widening)) AS compatible,
    NOT bool_or(change = 'DROPPED') AS parity_compatible,
    NOT bool_or((change = 'ADDED' AND NOT has_default) OR (change = 'ALTERED' AND NOT widening)) AS avro_compatible,
    COALESCE(string_agg(field, ',' ORDER BY field) FILTER (WHERE change = 'ADDED'), '') AS added,
    COALESCE(string_agg(field, ',' ORDER BY field) FILTER (WHERE change = 'ALTERED'), '') AS altered,
    COALESCE(string_agg(field, ',' ORDER BY field) FILTER (WHERE change = 'DROPPED'), '') AS dropped
  FROM judged GROUP BY subject, version)
"""


@query("schema_diff", REGISTRY + "SELECT subject, version, field, old_type, new_type, has_default, change, widening FROM judged", shared=False)
def schema_diff(spark, sf):
    return schema_gov.schema_diff(registry(spark, sf))


@query("schema_compat", REGISTRY + """
SELECT subject, version, compatible, added, altered, dropped,
       CASE WHEN compatible THEN 'AUTO_REGISTER' ELSE 'QUARANTINE_DLQ' END AS policy_action FROM verdicts""", shared=False)
def schema_compat(spark, sf):
    verdicts = schema_gov.schema_compat(schema_gov.schema_diff(registry(spark, sf)))
    return verdicts.select("subject", "version", "compatible", *[
        F.array_join(f"{c}_fields", ",").alias(c) for c in ("added", "altered", "dropped")], "policy_action")


@query("schema_compat_policies", REGISTRY + """
SELECT subject, version, parity_compatible, avro_compatible FROM verdicts""", shared=False)
def schema_compat_policies(spark, sf):
    """The lenient reference check looks at dropped fields only; the other policy ignores drops."""
    return schema_gov.schema_diff(registry(spark, sf)).groupBy("subject", "version").agg(
        schema_gov.compatible(check_added_defaults=False, check_types=False).alias("parity_compatible"),
        schema_gov.compatible(schema_gov.AVRO_BACKWARD).alias("avro_compatible"))


@query("added_default_check", REGISTRY + "SELECT subject, version, field FROM judged WHERE change = 'ADDED' AND NOT has_default", shared=False)
def added_default_check(spark, sf):
    diff = schema_gov.schema_diff(registry(spark, sf))
    return diff.filter((F.col("change") == schema_gov.ADDED) & ~F.col("has_default")).select("subject", "version", "field")


@query("type_widening", REGISTRY + "SELECT subject, version, field, old_type, new_type, widening FROM judged WHERE change = 'ALTERED'", shared=False)
def type_widening(spark, sf):
    diff = schema_gov.schema_diff(registry(spark, sf))
    return diff.filter(F.col("change") == schema_gov.ALTERED).select("subject", "version", "field", "old_type", "new_type", "widening")


@query("schema_quarantine", REGISTRY + """
SELECT l_orderkey, l_linenumber, v.subject, CASE WHEN v.compatible THEN 'main' ELSE 'dlq' END AS route
FROM lineitem JOIN verdicts v ON v.subject = 'part_' || l_partkey || '-value'""", shared=False)
def schema_quarantine(spark, sf):
    events = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("part_"), "l_partkey", F.lit("-value")).alias("subject"), F.lit(2).alias("version"))
    verdicts = schema_gov.schema_compat(schema_gov.schema_diff(registry(spark, sf)))
    return schema_gov.quarantine_split(events, verdicts).drop("version")


@query("schema_quarantine_gaps", """
WITH fields AS (
  SELECT 'part_' || p_partkey || '-value' AS subject, p_partkey, v.version, v.field, CASE WHEN v.field = 'tier' THEN NULL ELSE FALSE END AS has_default
  FROM part, (VALUES (1, 'id'), (1, 'notes'), (3, 'id'), (3, 'notes'), (3, 'tier'), (7, 'id'), (7, 'notes'), (7, 'tier')) v(version, field)
  WHERE NOT (v.field = 'tier' AND p_partkey % 3 <> 0) AND NOT (v.version = 7 AND v.field = 'notes' AND p_partkey % 4 = 0)),
judged AS (
  SELECT p_partkey, 'part_' || p_partkey || '-value' AS subject, v.version,
         CASE v.version WHEN 1 THEN TRUE WHEN 3 THEN p_partkey % 3 <> 0 WHEN 7 THEN p_partkey % 4 <> 0 ELSE FALSE END AS good
  FROM part, (VALUES (1), (2), (3), (7)) v(version))
SELECT l_orderkey, l_linenumber, j.subject, j.version, CASE WHEN j.good THEN 'main' ELSE 'dlq' END AS route
FROM lineitem JOIN judged j ON j.p_partkey = l_partkey AND j.version = [1, 2, 3, 7][CAST(l_linenumber % 4 AS INTEGER) + 1]""", shared=False)
def schema_quarantine_gaps(spark, sf):
    """Versions 1, 3 and 7; an added field whose default is unknown, a dropped one, and an unknown version 2."""
    k, f = F.col("p_partkey"), lambda v, n, kind, d=False: F.struct(
        F.lit(v).alias("version"), F.lit(n).alias("field"), F.lit(kind).alias("type"), F.lit(d).cast("boolean").alias("has_default"))
    fields = F.array_compact(F.array(
        f(1, "id", "int"), f(1, "notes", "string"), f(3, "id", "int"), f(3, "notes", "string"), F.when(k % 3 == 0, f(3, "tier", "string", None)),
        f(7, "id", "int"), F.when(k % 4 != 0, f(7, "notes", "string")), F.when(k % 3 == 0, f(7, "tier", "string", None))))
    held = table(spark, sf, "part").select(F.concat(F.lit("part_"), k, F.lit("-value")).alias("subject"), F.explode(fields).alias("f"))
    version = F.element_at(F.array(*[F.lit(v) for v in (1, 2, 3, 7)]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    events = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("part_"), "l_partkey", F.lit("-value")).alias("subject"), version.alias("version"))
    return schema_gov.quarantine_split(events, schema_gov.schema_verdicts(held.select("subject", "f.*")))


@query("schema_versions", """
, o AS (SELECT segment, array_to_string(list_sort(json_keys(after_json)), ',') AS fingerprint, MIN(key_id) AS first_pos FROM customer_images GROUP BY 1, 2)
SELECT segment, fingerprint, first_pos, CAST(DENSE_RANK() OVER (PARTITION BY segment ORDER BY first_pos) AS INTEGER) AS version,
       42 + ROW_NUMBER() OVER (ORDER BY first_pos, segment, fingerprint) AS schema_id FROM o""")
def schema_versions(spark, sf):
    observed = customer_images(spark, sf).select(
        "segment", "key_id", F.array_join(F.array_sort(F.json_object_keys("after_json")), ",").alias("fingerprint"))
    return schema_gov.schema_versions(observed, "segment", "fingerprint", "key_id")


@query("schema_drift", """
, k AS (SELECT segment, key_id // 100 AS batch, UNNEST(json_keys(after_json)) AS field FROM customer_images)
SELECT segment, batch, field, COUNT(*) AS rows FROM k WHERE field NOT IN ('id', 'email', 'credit_card', 'tax_id', 'segment') GROUP BY ALL""")
def schema_drift(spark, sf):
    rows = customer_images(spark, sf).select("segment", F.floor(F.col("key_id") / 100).alias("batch"), "after_json")
    return schema_gov.schema_drift(rows, "after_json", ["segment", "batch"], ["id", "email", "credit_card", "tax_id", "segment"])


@query("schema_drift_windows", """
, r AS (SELECT segment, field FROM (SELECT DISTINCT segment FROM customer_images WHERE segment <> 'MACHINERY') s,
        (VALUES ('id'), ('email'), ('credit_card'), ('tax_id'), ('segment'), ('note')) v(field) WHERE NOT (segment = 'BUILDING' AND field = 'note')),
k AS (SELECT segment, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(key_id // 50 AS INTEGER) AS window_start, UNNEST(json_keys(after_json)) AS field
      FROM customer_images)
SELECT k.segment AS subject, CAST(window_start AS VARCHAR) AS window_start, k.field, COUNT(*) AS rows
FROM k LEFT JOIN r ON k.segment = r.segment AND k.field = r.field WHERE r.field IS NULL GROUP BY ALL""")
def schema_drift_windows(spark, sf):
    """Against a registry table of two versions; one segment was never registered."""
    images = customer_images(spark, sf)
    names = images.filter("segment <> 'MACHINERY'").select(F.col("segment").alias("subject")).distinct()
    fields = F.when(F.col("version") == 1, F.array(F.lit("id"), F.lit("loyalty_tier"))).otherwise(
        F.array(*[F.lit(f) for f in ("id", "email", "credit_card", "tax_id", "segment", "note")]))
    held = names.select("subject", F.explode(F.array(F.lit(1), F.lit(2))).alias("version")).select(
        "subject", "version", F.explode(fields).alias("field")).filter("NOT (subject = 'BUILDING' AND field = 'note')")
    day = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=F.floor(F.col("key_id") / 50).cast("int"), hours=(F.col("key_id") % 24).cast("int"))
    rows = images.select(F.col("segment").alias("subject"), day.alias("ts"), "after_json")
    found = schema_gov.schema_drift_windows(rows, "after_json", "ts", held)
    return found.withColumn("window_start", F.col("window_start").cast("string"))


@query("transform_chain", """
SELECT tbl, op, key_id, pos, CASE WHEN NOT (tombstone) THEN a_status END AS status FROM messages WHERE NOT tombstone AND op <> 't' AND tbl = 'orders'""")
def transform_chain(spark, sf):
    """Steps put together with ``chain``: key split, tombstones, their removal, a table filter."""
    from ..operators import expand
    from ..operators.transforms import chain
    from .registry import committed_log
    rows = chain(
        committed_log(spark, sf), expand.split_pk_update, expand.delete_tombstones, expand.drop_tombstones,
        lambda df: df.filter("tbl = 'orders' AND op <> 't'"))
    return rows.select("tbl", "op", "key_id", "pos", F.col("after.status").alias("status"))


@query("read_with_defaults", """
SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'GOLD' END ELSE 'BRONZE' END AS loyalty_tier
FROM customer""", shared=False)
def read_with_defaults(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    old, new = rows.filter("id % 7 <> 0"), rows.filter("id % 7 = 0")
    newer = new.withColumn("loyalty_tier", F.when(F.col("id") % 2 == 0, "GOLD"))
    return schema_gov.read_with_defaults([old, newer], {"loyalty_tier": "BRONZE"})


@query("rename_columns", "SELECT o_orderkey AS id, o_custkey AS buyer_id, o_orderstatus AS state FROM orders", shared=False)
def rename_columns(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    history = {"o_orderkey": "id", "o_custkey": "customer_id", "customer_id": "buyer_id", "o_orderstatus": "state"}
    return schema_gov.rename_columns(rows, history)


@query("ddl_events", """
, e AS (SELECT tbl, op, pos FROM ddl_log UNION ALL SELECT tbl, op, pos FROM change_log)
SELECT tbl || '-value' AS subject, op, pos, CASE WHEN op = 'DDL_DROP_COL' THEN 'DLQ_QUARANTINE' ELSE 'SCHEMA_EVOLVED' END AS status
FROM e WHERE op LIKE 'DDL%'""")
def ddl_events(spark, sf):
    cols = ("tbl", "op", "pos")
    return schema_gov.ddl_events(change_log(spark, sf).select(*cols).unionByName(ddl_log(spark, sf).select(*cols)))


@query("schema_lookup", """
SELECT key_id, schema_id, CASE schema_id WHEN 42 THEN 'orders-value' WHEN 43 THEN 'orders-value' END AS subject,
       CASE schema_id WHEN 42 THEN 1 WHEN 43 THEN 2 END AS version, COALESCE(schema_id IN (42, 43), FALSE) AS known FROM decoded""")
def schema_lookup(spark, sf):
    parsed = parse_messages(raw_messages(spark, sf).drop("schema_id").withColumn("value", F.unhex("value_hex")), "id bigint")
    known = spark.createDataFrame([(42, "orders-value", 1), (43, "orders-value", 2)], "schema_id bigint, subject string, version int")
    return schema_gov.schema_lookup(parsed.select("key_id", "schema_id"), known).select("key_id", "schema_id", "subject", "version", "known")
