"""Counters, throughput, latency, lag and service-level signals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.positions import parse_lsn
from .quantiles import exact_percentiles

# Service-level targets and the direction in which each one is met.
SLO_TARGETS = {
    "throughput_eps": 1842.0,
    "p95_latency_ms": 142.0,
    "p99_latency_ms": 380.0,
    "wal_slot_lag_bytes": 0.0,
}
AT_LEAST = ("throughput_eps",)
ONE_BUFFER = 5_000_000  # events whose different latencies go into one buffer


def op_counters(events: DataFrame, op: str = "op") -> DataFrame:
    """Counts by operation; a key update counts twice in the total."""
    is_ = lambda *codes: F.count_if(F.col(op).isin(*codes))
    return events.agg(
        F.sum(F.when(F.col(op) == "pk", 2).otherwise(1)).alias("total_events"),
        is_("c").alias("inserts"), is_("u").alias("updates"), is_("d").alias("deletes"),
        is_("t").alias("truncates"), is_("pk").alias("pk_updates"),
        F.count_if(F.col(op).startswith("DDL")).alias("schema_evolutions"))


def throughput(events: DataFrame, ts: str, window: str = "1 minute", seconds: int = 60) -> DataFrame:
    """Events and events per second by tumbling window."""
    return events.groupBy(F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("window_start"), "events", (F.col("events") / seconds).alias("eps"))


def latency_ms(start: str, end: str) -> Column:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return (micros(end) - micros(start)) / 1000


def latency_percentiles(events: DataFrame, latency: Column, by: Sequence[str] = (), shares: Sequence[float] = (0.95, 0.99)) -> DataFrame:
    """Exact interpolated percentiles, whatever the number of different latencies; see ``exact_percentiles``."""
    return exact_percentiles(events, latency, by, shares, [f"p{round(q * 100)}_latency_ms" for q in shares])


def e2e_latency(flush: Column, consumers: Sequence[Column]) -> dict[str, Column]:
    """Total over all stages, and the time when consumers run in parallel."""
    total = flush
    for c in consumers:
        total = total + c
    return {"total_ms": total, "parallel_ms": flush + F.greatest(*consumers)}


def size_label(size: Column) -> Column:
    """Bytes as text in the largest unit that leaves at least one."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        scaled = F.floor(size / 1024**power).cast("string")
        label = F.concat(scaled, F.lit(f" {unit}"))
        out = out.otherwise(label) if unit == "GB" else out.when(size < 1024 ** (power + 1), label)
    return out


def slot_lag(slots: DataFrame, log: DataFrame, lsn: str = "lsn", confirmed: str = "confirmed_lsn") -> DataFrame:
    """Bytes between the newest log position and the confirmed position of each slot."""
    newest = log.agg(F.max(parse_lsn(F.col(lsn)))).first()[0]
    lag = (F.lit(newest).cast("decimal(20,0)") - parse_lsn(F.col(confirmed))).cast("decimal(20,0)")
    return slots.withColumn("lag_bytes", lag).withColumn("lag_label", size_label(F.col("lag_bytes")))


def consumer_lag(produced: DataFrame, progress: DataFrame) -> DataFrame:
    """Messages not yet committed per consumer group and partition."""
    ends = produced.groupBy("topic", "partition").agg(F.max("offset").alias("end_offset"))
    return progress.join(ends, ["topic", "partition"], "left").withColumn(
        "lag", F.coalesce("end_offset", "committed") - F.col("committed"))


def topic_inventory(messages: DataFrame) -> DataFrame:
    return messages.groupBy("topic", "partition").agg(
        F.count(F.lit(1)).alias("messages"), F.min("offset").alias("min_offset"), F.max("offset").alias("max_offset"))


def golden_signals(
    events: DataFrame, ts: str, latency: Column, slot_lags: DataFrame, dead_letters: DataFrame, connector: Column,
    one_buffer: int = ONE_BUFFER,
) -> DataFrame:
    """One row with throughput, latency, lag, dead letters and active connectors.

    The events are counted per latency and connector, then folded. The other parts are one aggregation each; the rows
    are stacked and folded, never cross-joined. Percentiles come from one buffer while there are so few events that it
    is small, and otherwise by narrowing ranges.
    """
    small = events.count() <= one_buffer
    stamp = F.unix_micros(F.col(ts).cast("timestamp"))
    counted = events.select(latency.alias("v"), connector.alias("c"), stamp.alias("t")).groupBy("v", "c").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
    seconds = F.greatest(F.max("last") - F.min("first"), F.lit(1))
    buffered = [F.percentile("v", F.lit(q), F.col("n")).alias(f"p{round(q * 100)}_latency_ms") for q in (0.95, 0.99)]
    parts = [
        counted.agg(
            (F.sum("n") * 1e6 / seconds).alias("throughput_eps"), *(buffered if small else []),
            F.count_distinct("c").cast("double").alias("active_connectors_count")),
        slot_lags.agg(F.max("lag_bytes").cast("double").alias("wal_slot_lag_bytes")),
        dead_letters.agg(F.count(F.lit(1)).cast("double").alias("dlq_poison_count")),
    ]
    if not small:
        parts.append(latency_percentiles(events, latency))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    order = ["throughput_eps", "p95_latency_ms", "p99_latency_ms"]
    return stacked.agg(*[F.max(c).alias(c) for c in [*order, *[c for c in stacked.columns if c not in order]]])


def slo_check(signals: DataFrame, targets: Mapping[str, float] = SLO_TARGETS, at_least: Sequence[str] = AT_LEAST) -> DataFrame:
    """One row per target: value, target and whether it is met."""
    rows = F.array(*[
        F.struct(
            F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("target"),
            (F.col(m) >= t if m in at_least else F.col(m) <= t).alias("met"))
        for m, t in targets.items()])
    return signals.select(F.explode(rows).alias("r")).select("r.*")


def before_image_audit(events: DataFrame, complete: Column, table: str = "tbl", op: str = "op") -> DataFrame:
    """Updates and deletes per table, and how many carry a complete before image."""
    return events.filter(F.col(op).isin("u", "d", "pk")).groupBy(table).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(complete).alias("complete"),
    ).withColumn("share", F.round(F.col("complete") / F.col("events"), 6))


def raw_log_bytes(messages: DataFrame, source: str, value: Column) -> DataFrame:
    return messages.groupBy(source).agg(F.sum(F.octet_length(value)).alias("raw_bytes"), F.count(F.lit(1)).alias("messages"))


def status_breakdown(events: DataFrame, by: Sequence[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("events"))
