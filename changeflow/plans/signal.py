"""Queries over counters, throughput, latency, lag and service levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import commit, quantiles, signals
from ..operators.deadletter import dead, parse_messages
from ..operators.expand import assign_offsets
from ..operators.skew import join_small
from ..sources.fixtures import change_log, ddl_log, positions, raw_messages, table
from .registry import committed_log, query
from .state import messages



def latency():
    return signals.latency_ms("source_ts", "capture_ts")


@query("op_counters", """
, e AS (SELECT op FROM committed UNION ALL SELECT op FROM ddl_log)
SELECT CAST(SUM(CASE WHEN op = 'pk' THEN 2 ELSE 1 END) AS BIGINT) AS total_events, COUNT(*) FILTER (WHERE op = 'c') AS inserts,
       COUNT(*) FILTER (WHERE op = 'u') AS updates, COUNT(*) FILTER (WHERE op = 'd') AS deletes,
       COUNT(*) FILTER (WHERE op = 't') AS truncates, COUNT(*) FILTER (WHERE op = 'pk') AS pk_updates,
       COUNT(*) FILTER (WHERE op LIKE 'DDL%') AS schema_evolutions FROM e""")
def op_counters(spark, sf):
    return signals.op_counters(committed_log(spark, sf).select("op").unionByName(ddl_log(spark, sf).select("op")))


@query("throughput_eps", """
SELECT CAST(date_trunc('minute', capture_ts) AS VARCHAR) AS window_start, COUNT(*) AS events, COUNT(*) / 60.0::DOUBLE AS eps
FROM committed GROUP BY 1""")
def throughput_eps(spark, sf):
    rows = signals.throughput(committed_log(spark, sf), "capture_ts")
    return rows.withColumn("window_start", F.col("window_start").cast("string"))


MS = "CAST(epoch_ms(capture_ts) - epoch_ms(source_ts) AS DOUBLE)"


@query("latency_percentiles", f"""
SELECT tbl, quantile_cont({MS}, 0.95) AS p95_latency_ms, quantile_cont({MS}, 0.99) AS p99_latency_ms FROM committed GROUP BY tbl""")
def latency_percentiles(spark, sf):
    return signals.latency_percentiles(committed_log(spark, sf), latency(), ["tbl"])


def distinct_latencies(spark, sf) -> DataFrame:
    """Events with a latency in microseconds that no other event has, long tails among them."""
    e = F.col("event_id")
    micros = e * 7 + e % 1000 * 1_000_003 + F.when(e % 211 == 0, e * 1_000_000_007).otherwise(0)
    return table(spark, sf, "events").select("event_type", (micros / 1000).alias("ms"))


_DISTINCT = "(SELECT event_type, (event_id * 7 + event_id % 1000 * 1000003 + CASE WHEN event_id % 211 = 0 THEN event_id * 1000000007 ELSE 0 END) / 1000.0::DOUBLE AS ms FROM events)"


@query("latency_percentiles_distinct", f"""
SELECT event_type, quantile_cont(ms, 0.5) AS p50_latency_ms, quantile_cont(ms, 0.95) AS p95_latency_ms, quantile_cont(ms, 0.99) AS p99_latency_ms
FROM {_DISTINCT} GROUP BY event_type""", shared=False)
def latency_percentiles_distinct(spark, sf):
    """Exact percentiles where all latencies differ; narrowed in several passes even at this size."""
    names = [f"p{q}_latency_ms" for q in (50, 95, 99)]
    return quantiles.exact_percentiles(distinct_latencies(spark, sf), F.col("ms"), ["event_type"], (0.5, 0.95, 0.99), names, buckets=64, sorted_rows=50)


@query("latency_sketch", f"""
SELECT event_type, COUNT(*) AS n, TRUE AS within FROM {_DISTINCT} GROUP BY event_type""", shared=False)
def latency_sketch(spark, sf):
    """Sketches of parts of the events, merged; the rank of each percentile is off by a hundredth at most."""
    rows = distinct_latencies(spark, sf)
    parts = rows.groupBy("event_type", F.spark_partition_id().alias("part")).agg(quantiles.sketch(F.col("ms")).alias("sketch"))
    found = quantiles.sketch_percentiles(parts.groupBy("event_type").agg(quantiles.merged(F.col("sketch")).alias("sketch")), "sketch", (0.5, 0.95, 0.99))
    ranks = join_small(rows, found, ["event_type"]).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), *[(F.abs(F.avg((F.col("ms") <= F.col(f"p{q}")).cast("int")) - q / 100) <= 0.01).alias(f"w{q}") for q in (50, 95, 99)])
    return ranks.select("event_type", "n", (F.col("w50") & F.col("w95") & F.col("w99")).alias("within"))


@query("e2e_latency", """
, s AS (SELECT tbl, pos, 9 + COALESCE(key_id, 0) % 6 AS f, 34 + COALESCE(key_id, 0) % 17 AS d, 12 + COALESCE(key_id, 0) % 7 AS m,
               16 + COALESCE(key_id, 0) % 10 AS x FROM committed)
SELECT tbl, pos, f + d + m + x AS total_ms, f + greatest(d, m, x) AS parallel_ms FROM s""")
def e2e_latency(spark, sf):
    key = F.coalesce("key_id", F.lit(0).cast("long"))
    rows = committed_log(spark, sf).select(
        "tbl", "pos", (9 + key % 6).alias("f"), (34 + key % 17).alias("d"), (12 + key % 7).alias("m"), (16 + key % 10).alias("x"))
    out = signals.e2e_latency(F.col("f"), [F.col("d"), F.col("m"), F.col("x")])
    return rows.select("tbl", "pos", *[c.alias(n) for n, c in out.items()])


def slots(spark, sf) -> DataFrame:
    """One replication slot per user, confirmed up to a third of the events."""
    return positions(spark, sf).filter("event_id % 3 = 0").groupBy(F.concat(F.lit("slot_"), F.col("user_id")).alias("slot_name")).agg(
        F.max_by("lsn", "lsn_ord").alias("confirmed_lsn"))


@query("slot_lag", """
, s AS (SELECT 'slot_' || user_id AS slot_name, arg_max(lsn, lsn_ord) AS confirmed_lsn, MAX(lsn_ord) AS c FROM positions
        WHERE event_id % 3 = 0 GROUP BY user_id),
l AS (SELECT slot_name, confirmed_lsn, (SELECT MAX(lsn_ord) FROM positions) - c AS lag_bytes FROM s)
SELECT slot_name, confirmed_lsn, lag_bytes, CASE WHEN lag_bytes < 1024 THEN lag_bytes || ' B'
  WHEN lag_bytes < 1048576 THEN CAST(FLOOR(lag_bytes / 1024) AS BIGINT) || ' KB'
  WHEN lag_bytes < 1073741824 THEN CAST(FLOOR(lag_bytes / 1048576) AS BIGINT) || ' MB'
  ELSE CAST(FLOOR(lag_bytes / 1073741824) AS BIGINT) || ' GB' END AS lag_label FROM l""")
def slot_lag(spark, sf):
    return signals.slot_lag(slots(spark, sf), positions(spark, sf)).withColumn("lag_bytes", F.col("lag_bytes").cast("long"))


# The three consumer groups, numbered in this order.
GROUPS = ("snowflake-cdc-ingest", "order-fulfillment-service", "elasticsearch-sync")


@query("consumer_lag", """
, ends AS (SELECT topic, partition, MAX("offset") AS end_offset FROM offsets GROUP BY topic, partition),
g AS (SELECT * FROM (VALUES ('snowflake-cdc-ingest', 1), ('order-fulfillment-service', 2), ('elasticsearch-sync', 3)) v(consumer_group, n))
SELECT consumer_group, topic, partition, end_offset - (partition + 1) * n AS committed, end_offset,
       end_offset - (end_offset - (partition + 1) * n) AS lag FROM ends, g""")
def consumer_lag(spark, sf):
    produced = assign_offsets(messages(spark, sf)).select("topic", "partition", "offset")
    groups = F.explode(F.array(*[F.struct(F.lit(g).alias("consumer_group"), F.lit(i + 1).alias("n")) for i, g in enumerate(GROUPS)]))
    progress = produced.groupBy("topic", "partition").agg(F.max("offset").alias("top")).withColumn("g", groups).select(
        "g.consumer_group", "topic", "partition", (F.col("top") - (F.col("partition") + 1) * F.col("g.n")).alias("committed"))
    return signals.consumer_lag(produced, progress)


@query("topic_inventory", """
SELECT topic, partition, COUNT(*) AS messages, MIN("offset") AS min_offset, MAX("offset") AS max_offset FROM offsets GROUP BY topic, partition""")
def topic_inventory(spark, sf):
    return signals.topic_inventory(assign_offsets(messages(spark, sf)).select("topic", "partition", "offset"))


def dead_letters(spark, sf) -> DataFrame:
    parsed = parse_messages(raw_messages(spark, sf).withColumn("value", F.unhex("value_hex")), "id bigint, status string")
    return dead(parsed)


DEAD_SQL = "(NOT valid OR body LIKE '{bad%')"


@query("health_counts", f"""
SELECT (SELECT COUNT(*) FROM decoded WHERE {DEAD_SQL}) AS dlq_poison_count,
       (SELECT COUNT(DISTINCT 'debezium-' || tbl) FROM committed) AS active_connectors_count""")
def health_counts(spark, sf):
    letters = dead_letters(spark, sf).agg(F.count(F.lit(1)).alias("dlq_poison_count"))
    active = committed_log(spark, sf).agg(F.count_distinct(F.concat(F.lit("debezium-"), "tbl")).alias("active_connectors_count"))
    both = letters.unionByName(active, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def golden(spark, sf) -> DataFrame:
    return signals.golden_signals(
        committed_log(spark, sf), "capture_ts", latency(), signals.slot_lag(slots(spark, sf), positions(spark, sf)),
        dead_letters(spark, sf), F.concat(F.lit("debezium-"), "tbl"))


GOLDEN_SQL = f"""
, eps AS (SELECT COUNT(*) * 1e6 / (epoch_us(MAX(capture_ts)) - epoch_us(MIN(capture_ts))) AS throughput_eps,
                 CAST(COUNT(DISTINCT tbl) AS DOUBLE) AS active_connectors_count,
                 quantile_cont({MS}, 0.95) AS p95_latency_ms, quantile_cont({MS}, 0.99) AS p99_latency_ms FROM committed),
lag AS (SELECT CAST((SELECT MAX(lsn_ord) FROM positions) - MIN(c) AS DOUBLE) AS wal_slot_lag_bytes
        FROM (SELECT MAX(lsn_ord) AS c FROM positions WHERE event_id % 3 = 0 GROUP BY user_id)),
letters AS (SELECT CAST(COUNT(*) AS DOUBLE) AS dlq_poison_count FROM decoded WHERE {DEAD_SQL}),
golden AS (SELECT round(throughput_eps, 9) AS throughput_eps, active_connectors_count, p95_latency_ms, p99_latency_ms, wal_slot_lag_bytes, dlq_poison_count
           FROM eps, lag, letters)"""


@query("golden_signals", GOLDEN_SQL + "SELECT * FROM golden")
def golden_signals(spark, sf):
    return golden(spark, sf).withColumn("throughput_eps", F.round("throughput_eps", 9))


@query("slo_check", GOLDEN_SQL + """
SELECT 'throughput_eps' AS metric, throughput_eps AS value, 1842.0::DOUBLE AS target, throughput_eps >= 1842 AS met FROM golden
UNION ALL SELECT 'p95_latency_ms', p95_latency_ms, 142.0, p95_latency_ms <= 142 FROM golden
UNION ALL SELECT 'p99_latency_ms', p99_latency_ms, 380.0, p99_latency_ms <= 380 FROM golden
UNION ALL SELECT 'wal_slot_lag_bytes', wal_slot_lag_bytes, 0.0, wal_slot_lag_bytes <= 0 FROM golden""")
def slo_check(spark, sf):
    return signals.slo_check(golden(spark, sf)).withColumn("value", F.round("value", 9))


@query("tx_summary", """
SELECT tx_id, COUNT(*) AS events, COUNT(DISTINCT tbl) AS tables, MIN(pos) AS first_pos, MAX(pos) AS last_pos,
       CAST(MIN(source_ts) AS VARCHAR) AS begin_ts, CAST(MAX(source_ts) AS VARCHAR) AS end_ts, COUNT(*) >= 11 AS is_large
FROM committed GROUP BY tx_id""")
def tx_summary(spark, sf):
    rows = commit.tx_summary(committed_log(spark, sf), large=11)
    return rows.withColumns({c: F.col(c).cast("string") for c in ("begin_ts", "end_ts")})


@query("before_image_audit", """
, a AS (SELECT tbl, COUNT(*) AS events, COUNT(*) FILTER (WHERE b_customer_id IS NOT NULL AND b_status IS NOT NULL AND b_amount_cents IS NOT NULL) AS complete
        FROM committed WHERE op IN ('u', 'd', 'pk') GROUP BY tbl)
SELECT tbl, events, complete, round(complete / events, 6) AS share FROM a""")
def before_image_audit(spark, sf):
    full = F.col("before.customer_id").isNotNull() & F.col("before.status").isNotNull() & F.col("before.amount_cents").isNotNull()
    return signals.before_image_audit(committed_log(spark, sf), full)


@query("raw_log_bytes", """
SELECT schema_id, CAST(SUM(length(value_hex) / 2) AS BIGINT) AS raw_bytes, COUNT(*) AS messages FROM raw_messages GROUP BY schema_id""")
def raw_log_bytes(spark, sf):
    return signals.raw_log_bytes(raw_messages(spark, sf), "schema_id", F.unhex("value_hex"))


@query("status_breakdown", """
, e AS (
  SELECT tbl, CASE WHEN step = 5 THEN 'ROLLED_BACK_ZERO_EMISSION' ELSE 'EMITTED_TO_KAFKA' END AS status FROM change_log
  UNION ALL SELECT 'parts', CASE WHEN op = 'DDL_DROP_COL' THEN 'DLQ_QUARANTINE' ELSE 'SCHEMA_EVOLVED' END FROM ddl_log)
SELECT status, tbl, COUNT(*) AS events FROM e GROUP BY status, tbl""")
def status_breakdown(spark, sf):
    rows = change_log(spark, sf).select(
        "tbl", F.when(F.col("step") == 5, "ROLLED_BACK_ZERO_EMISSION").otherwise("EMITTED_TO_KAFKA").alias("status"))
    ddl = ddl_log(spark, sf).select(
        F.lit("parts").alias("tbl"), F.when(F.col("op") == "DDL_DROP_COL", "DLQ_QUARANTINE").otherwise("SCHEMA_EVOLVED").alias("status"))
    return signals.status_breakdown(rows.unionByName(ddl), ["status", "tbl"])


