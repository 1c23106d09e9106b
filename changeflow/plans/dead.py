"""Queries over dead-letter routing and retries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import deadletter
from ..sources.fixtures import raw_messages
from .registry import query

PAYLOAD = "id bigint, status string"


def parsed(spark, sf, known_ids=None) -> DataFrame:
    raw = raw_messages(spark, sf).select("key_id", F.unhex("value_hex").alias("value"))
    return deadletter.parse_messages(raw, PAYLOAD, known_ids=known_ids)


REASON = """CASE WHEN NOT valid THEN 'BAD_HEADER' WHEN body LIKE '{bad%' THEN 'BAD_JSON' WHEN schema_id = 44 THEN 'UNKNOWN_SCHEMA' END"""


@query("dlq_split", f"""
, r AS (SELECT *, {REASON} AS reason FROM decoded)
SELECT key_id, schema_id, reason, CASE WHEN reason IS NULL THEN 'main' ELSE 'dlq' END AS route,
       CASE WHEN reason IS NULL THEN CAST(json_extract_string(body, 'id') AS BIGINT) END AS id,
       CASE WHEN reason IS NULL THEN json_extract_string(body, 'status') END AS status FROM r""")
def dlq_split(spark, sf):
    rows = deadletter.with_route(parsed(spark, sf, [42, 43]))
    return rows.select("key_id", "schema_id", "reason", "route", "doc.id", "doc.status")


@query("dlq_envelope", f"""
, r AS (SELECT *, {REASON} AS reason FROM decoded)
SELECT key_id, 'cdc.local.ecommerce.orders_db.public.orders' AS original_topic, 'cdc.dlq.ecommerce.orders' AS dlq_topic,
       'org.apache.kafka.connect.errors.DataException' AS error_class, reason AS error_reason, value_hex AS payload_hex,
       'POISON_PILL' AS error_type, '0' AS retry_count FROM r WHERE reason IS NOT NULL""")
def dlq_envelope(spark, sf):
    letters = deadletter.dlq_envelope(
        deadletter.dead(parsed(spark, sf, [42, 43])), F.lit("cdc.local.ecommerce.orders_db.public.orders"), F.lit("ecommerce"), F.lit("orders"))
    return letters.select(
        "key_id", "original_topic", "dlq_topic", "error_class", "error_reason", F.hex("payload").alias("payload_hex"),
        F.col("headers")["error_type"].alias("error_type"), F.col("headers")["retry_count"].alias("retry_count"))


@query("dlq_route", f"""
, r AS (SELECT *, {REASON} AS reason FROM decoded)
SELECT CASE WHEN reason IS NULL THEN 'cdc.local.ecommerce.orders_db.public.orders' ELSE 'cdc.dlq.orders.unparseable' END AS topic,
       reason, COUNT(*) AS messages, CAST(SUM(length(value_hex) / 2) AS BIGINT) AS bytes FROM r GROUP BY ALL""")
def dlq_route(spark, sf):
    main, dlq = F.lit("cdc.local.ecommerce.orders_db.public.orders"), F.lit("cdc.dlq.orders.unparseable")
    return deadletter.with_topic(parsed(spark, sf, [42, 43]), main, dlq).groupBy("topic", "reason").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(F.octet_length("value")).alias("bytes"))


@query("dlq_retry", f"""
, r AS (SELECT *, {REASON} AS reason, CAST(key_id % 4 AS INTEGER) AS n FROM decoded),
o AS (SELECT key_id, n, CASE WHEN n >= 3 THEN 'PARKED' WHEN reason = 'UNKNOWN_SCHEMA' THEN 'REPLAYED' WHEN n + 1 >= 3 THEN 'PARKED' ELSE 'RETRY' END AS outcome
      FROM r WHERE reason IS NOT NULL)
SELECT key_id, outcome, CAST(CASE WHEN n >= 3 OR outcome = 'REPLAYED' THEN n ELSE n + 1 END AS INTEGER) AS retry_count,
       CASE WHEN outcome = 'RETRY' THEN CAST(1000 * power(2, n) AS BIGINT) END AS next_wait_ms FROM o""")
def dlq_retry(spark, sf):
    """Schema 44 was unknown when the letters were written and is registered by now."""
    letters = deadletter.dead(parsed(spark, sf, [42, 43])).select(
        "key_id", F.col("value").alias("payload"), (F.col("key_id") % 4).cast("int").alias("retry_count"))
    return deadletter.dlq_retry(letters, PAYLOAD, [42, 43, 44]).select("key_id", "outcome", "retry_count", "next_wait_ms")


NOW = "2024-01-01 00:10:00"


def timed_letters(spark, sf):
    """Letters that failed up to ten minutes ago, up to three times."""
    return deadletter.dead(parsed(spark, sf, [42, 43])).select(
        "key_id", F.col("value").alias("payload"), (F.col("key_id") % 4).cast("int").alias("retry_count"),
        (F.lit(NOW).cast("timestamp") - F.make_dt_interval(secs=F.col("key_id") % 7)).alias("failed_at"))


_ROUND = f"""
, r AS (SELECT *, {REASON} AS reason, CAST(key_id % 4 AS INTEGER) AS n, TIMESTAMP '{NOW}' - INTERVAL 1 SECOND * (key_id % 7) AS failed FROM decoded),
a AS (SELECT *, failed + INTERVAL 1 SECOND * CAST(CASE n WHEN 0 THEN 0 ELSE power(2, n - 1) END AS INTEGER) AS due_at FROM r WHERE reason IS NOT NULL),
o AS (SELECT *, CASE WHEN due_at > TIMESTAMP '{NOW}' THEN 'WAITING' WHEN n >= 3 THEN 'PARKED' WHEN reason = 'UNKNOWN_SCHEMA' THEN 'REPLAYED'
                     WHEN n + 1 >= 3 THEN 'PARKED' ELSE 'RETRY' END AS outcome FROM a)
"""


@query("dlq_retry_round", _ROUND + f"""
SELECT key_id, outcome, CAST(CASE WHEN outcome IN ('WAITING', 'REPLAYED') OR n >= 3 THEN n ELSE n + 1 END AS INTEGER) AS retry_count,
       CASE outcome WHEN 'WAITING' THEN due_at WHEN 'RETRY' THEN TIMESTAMP '{NOW}' + INTERVAL 1 SECOND * CAST(power(2, n) AS INTEGER) END AS attempt_at FROM o""")
def dlq_retry_round(spark, sf):
    """Only letters whose time has come are tried; every failure sets the time of the next attempt."""
    tried = deadletter.retry_round(timed_letters(spark, sf), PAYLOAD, F.lit(NOW).cast("timestamp"), [42, 43, 44])
    return tried.select("key_id", "outcome", "retry_count", F.col("attempt_at").cast("timestamp_ntz").alias("attempt_at"))


@query("dlq_replay", _ROUND + """
SELECT 'orders' AS topic, key_id AS key, value_hex, CAST(n AS VARCHAR) AS retry_count FROM o WHERE outcome = 'REPLAYED'""")
def dlq_replay(spark, sf):
    """Records that go back to the main topic, with their original bytes."""
    tried = deadletter.retry_round(timed_letters(spark, sf), PAYLOAD, F.lit(NOW).cast("timestamp"), [42, 43, 44])
    sent = deadletter.replay_messages(tried, F.col("key_id"), F.lit("orders"))
    return sent.select("topic", "key", F.hex("value").alias("value_hex"), F.col("headers")["retry_count"].alias("retry_count"))
