"""The query table, the SQL shared by the equivalents, and helpers for the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.commit import committed_only
from ..operators.expand import split_pk_update
from ..sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, shared: bool = True) -> Callable[[Query], Query]:
    """Registers a query and its SQL; ``shared`` puts the common sub-queries in front."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = (f"WITH {SHARED}\n{sql}" if shared else sql).strip()
        return fn
    return add


def committed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixtures.change_log(spark, sf_dir)
    return committed_only(log, fixtures.transactions(log))


def split_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_pk_update(committed_log(spark, sf_dir))


def flat(prefix: str, image: str) -> list[Column]:
    """The fields of a row image as top-level columns."""
    return [F.col(f"{image}.{f}").alias(f"{prefix}{f}") for f in ("customer_id", "status", "amount_cents")]


SHARED = """
base AS (
  SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderstatus AS status,
         CAST(ROUND(o_totalprice * 100) AS BIGINT) AS amount_cents, o_orderdate AS ts0 FROM orders),
steps AS (
  SELECT 1 AS step, 'orders' AS tbl, 'c' AS op, id AS key_id, CAST(NULL AS BIGINT) AS old_key_id,
         CAST(NULL AS BIGINT) AS b_customer_id, CAST(NULL AS VARCHAR) AS b_status, CAST(NULL AS BIGINT) AS b_amount_cents,
         customer_id AS a_customer_id, status AS a_status, amount_cents AS a_amount_cents, ts0 FROM base
  UNION ALL
  SELECT 2, 'orders', 'u', id, NULL, customer_id, status, amount_cents, customer_id, 'SHIPPED', amount_cents + 500, ts0
    FROM base WHERE id % 2 = 0
  UNION ALL
  SELECT 3, 'orders', 'pk', id + 100000000, id, customer_id, CASE WHEN id % 2 = 0 THEN 'SHIPPED' ELSE status END,
         CASE WHEN id % 2 = 0 THEN amount_cents + 500 ELSE amount_cents END, customer_id,
         CASE WHEN id % 2 = 0 THEN 'SHIPPED' ELSE status END,
         CASE WHEN id % 2 = 0 THEN amount_cents + 500 ELSE amount_cents END, ts0
    FROM base WHERE id % 29 = 0
  UNION ALL
  SELECT 4, 'orders', 'd', id, NULL, customer_id, CASE WHEN id % 2 = 0 THEN 'SHIPPED' ELSE status END,
         CASE WHEN id % 2 = 0 THEN amount_cents + 500 ELSE amount_cents END, NULL, NULL, NULL, ts0
    FROM base WHERE id % 17 = 0 AND id % 29 <> 0
  UNION ALL
  SELECT 5, 'orders', 'c', id + 200000000, NULL, NULL, NULL, NULL, customer_id, 'ABORTED', 9999, ts0 FROM base WHERE id % 13 = 0
  UNION ALL
  SELECT 1, 'staging_orders', 'c', id, NULL, NULL, NULL, NULL, customer_id, 'temp', amount_cents, ts0 FROM base WHERE id % 19 = 0
  UNION ALL
  SELECT 6, 'staging_orders', 't', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, MAX(ts0) FROM base
  UNION ALL
  SELECT 7, 'staging_orders', 'c', id, NULL, NULL, NULL, NULL, customer_id, 'reload', amount_cents, ts0 FROM base WHERE id % 190 = 0),
change_log AS (
  SELECT step, tbl, op, key_id, old_key_id, b_customer_id, b_status, b_amount_cents, a_customer_id, a_status, a_amount_cents,
         CAST(step AS BIGINT) * 1000000000 + COALESCE(key_id % 100000000, 0) AS pos,
         CAST(step AS BIGINT) * 1000000 + CAST(FLOOR(COALESCE(key_id % 100000000, 0) / 10) AS BIGINT) AS tx_id,
         ts0 + INTERVAL '1' DAY * (step - 1) AS source_ts,
         ts0 + INTERVAL '1' DAY * (step - 1) + INTERVAL '1' MILLISECOND * (COALESCE(key_id, 0) * 37 % 5000) AS capture_ts
  FROM steps),
tx AS (SELECT DISTINCT tx_id, CASE WHEN step = 5 THEN 'ABORTED' ELSE 'COMMITTED' END AS status FROM change_log),
committed AS (SELECT * FROM change_log WHERE tx_id IN (SELECT tx_id FROM tx WHERE status = 'COMMITTED')),
truncs AS (SELECT tbl, pos, source_ts FROM committed WHERE op = 't'),
split AS (
  SELECT tbl, op, key_id, b_customer_id, b_status, b_amount_cents, a_customer_id, a_status, a_amount_cents,
         pos, 0 AS sub_order, tx_id, source_ts, capture_ts FROM committed WHERE op <> 'pk'
  UNION ALL
  SELECT tbl, 'd', old_key_id, b_customer_id, b_status, b_amount_cents, NULL, NULL, NULL, pos, 0, tx_id, source_ts, capture_ts
    FROM committed WHERE op = 'pk'
  UNION ALL
  SELECT tbl, 'c', key_id, NULL, NULL, NULL, a_customer_id, a_status, a_amount_cents, pos, 1, tx_id, source_ts, capture_ts
    FROM committed WHERE op = 'pk'),
last_trunc AS (SELECT tbl, MAX(pos) AS tpos FROM truncs GROUP BY tbl),
after_barrier AS (
  SELECT s.* FROM split s LEFT JOIN last_trunc t ON s.tbl = t.tbl
  WHERE s.key_id IS NOT NULL AND (t.tpos IS NULL OR s.pos > t.tpos)),
last_event AS (
  SELECT * FROM after_barrier QUALIFY ROW_NUMBER() OVER (PARTITION BY tbl, key_id ORDER BY pos DESC, sub_order DESC) = 1),
state AS (SELECT * FROM last_event WHERE op <> 'd'),
messages AS (
  SELECT tbl, op, key_id, pos, sub_order * 2 AS sub_order, FALSE AS tombstone, a_status, source_ts FROM split
  UNION ALL
  SELECT tbl, op, key_id, pos, sub_order * 2 + 1, TRUE, NULL, source_ts FROM split WHERE op = 'd'),
topics AS (
  SELECT *, 'cdc.local.ecommerce.orders_db.public.' || tbl AS topic,
         CAST(COALESCE(key_id, 0) % 3 AS INTEGER) AS partition FROM messages),
offsets AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY topic, partition ORDER BY pos, sub_order) - 1 AS "offset" FROM topics),
customer_images AS (
  SELECT key_id, email, credit_card, tax_id, segment,
    concat('{"id":', CAST(key_id AS VARCHAR), ',"email":"', email, '","credit_card":"', credit_card, '","tax_id":"', tax_id,
           '","segment":"', segment, '","note":null}') AS before_json,
    concat('{"id":', CAST(key_id AS VARCHAR), ',"email":"', CASE WHEN key_id % 5 = 0 THEN concat('new.', email) ELSE email END,
           '","credit_card":"', credit_card, '","tax_id":"', tax_id, '","segment":"',
           CASE WHEN key_id % 3 = 0 THEN 'VIP' ELSE segment END, '"',
           CASE WHEN key_id % 7 = 0 THEN ',"loyalty_tier":"BRONZE"' ELSE '' END, '}') AS after_json
  FROM (SELECT c_custkey AS key_id, c_mktsegment AS segment,
          CASE WHEN c_custkey % 23 = 0 THEN '' ELSE concat('user', CAST(c_custkey AS VARCHAR), '@mail.example.com') END AS email,
          CASE WHEN c_custkey % 2 = 0 THEN CAST(4111222200000000 + c_custkey * 7919 AS VARCHAR)
               ELSE concat('4111-2222-3333-', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')) END AS credit_card,
          CASE WHEN c_custkey % 11 = 0 THEN '12' ELSE concat('900-55-', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')) END AS tax_id
        FROM customer) x),
raw_messages AS (
  SELECT key_id, schema_id,
    CASE WHEN key_id % 97 = 0 THEN concat('FF', lpad(hex(schema_id), 8, '0'), hex(payload))
         WHEN key_id % 89 = 0 THEN '0000'
         WHEN key_id % 83 = 0 THEN concat('00', lpad(hex(schema_id), 8, '0'), hex('{bad'))
         ELSE concat('00', lpad(hex(schema_id), 8, '0'), hex(payload)) END AS value_hex
  FROM (SELECT o_orderkey AS key_id, CAST(42 + o_orderkey % 3 AS BIGINT) AS schema_id,
          concat('{"id":', CAST(o_orderkey AS VARCHAR), ',"status":"', o_orderstatus, '"}') AS payload FROM orders) x),
decoded AS (
  SELECT key_id, value_hex, length(value_hex) >= 10 AND value_hex LIKE '00%' AS valid,
         CASE WHEN length(value_hex) >= 10 AND value_hex LIKE '00%' THEN CAST('0x' || substr(value_hex, 3, 8) AS BIGINT) END AS schema_id,
         CASE WHEN length(value_hex) >= 10 AND value_hex LIKE '00%' THEN decode(unhex(substr(value_hex, 11))) END AS body
  FROM raw_messages),
positions AS (
  SELECT event_id, user_id, event_id * 1000003 AS lsn_ord,
    concat(hex(CAST(FLOOR(event_id * 1000003 / 4294967296) AS BIGINT)), '/', hex((event_id * 1000003) % 4294967296)) AS lsn,
    concat('24da01e2-b892-11e7-8b0f-0242ac110002:', CAST(event_id AS VARCHAR)) AS gtid,
    concat(CAST(user_id % 3 AS VARCHAR), '-184055-', CAST(event_id AS VARCHAR)) AS mariadb_gtid,
    concat(lpad(hex(event_id), 8, '0'), ':', lpad(hex(user_id), 8, '0'), ':', lpad(hex(event_id % 16), 4, '0')) AS mssql_lsn
  FROM events),
ddl_log AS (
  SELECT 'part_' || p_partkey AS tbl,
         CASE p_partkey % 3 WHEN 0 THEN 'DDL_ADD_COL' WHEN 1 THEN 'DDL_ALTER_TYPE' ELSE 'DDL_DROP_COL' END AS op,
         p_partkey AS key_id, 8000000000 + p_partkey AS pos,
         8000000 + CAST(FLOOR(p_partkey / 10) AS BIGINT) AS tx_id FROM part)
"""
