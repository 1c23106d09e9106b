"""Streaming queries. Each stages its input as files, runs over what is available, ends, and returns
the table it wrote, so that it can be compared with the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import materialize
from ..operators.commit import COMMITTED
from ..operators.deadletter import parse_messages
from ..operators.expand import split_pk_update
from ..operators.skew import join_small
from ..operators.snapshot import OPEN, chunk_number
from ..session import work_path
from ..sources import readers, sinks
from ..sources.fixtures import change_log, raw_messages, table, transactions
from ..sources.state_table import StateTable
from ..streaming import intake, jobs, processors
from .dead import PAYLOAD, REASON
from .registry import committed_log, flat, query, split_log
from .snapshots import CHUNK, WINDOWS, order_rows, window_signals
from .state import FIELDS


BATCH_BYTES = 2**30


def staged(df: DataFrame, name: str, max_bytes: int = BATCH_BYTES) -> DataFrame:
    """Writes ``df`` as files, as it is partitioned, and returns a stream over them in batches of bounded size."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return readers.stream_changes(df.sparkSession, path, df.schema, max_bytes=max_bytes)


@query("stream_change_log", "SELECT tbl, op, key_id, pos, tx_id, a_status AS status FROM change_log")
def stream_change_log(spark, sf):
    out = work_path(spark, "stream_out")
    stream = staged(change_log(spark, sf), "change_topic").select(
        "tbl", "op", "key_id", "pos", "tx_id", F.col("after.status").alias("status"))
    jobs.finish(jobs.append_files(stream, out, work_path(spark, "ck"), ("tbl",)))
    return spark.read.parquet(out).select("tbl", "op", "key_id", "pos", "tx_id", "status")


@query("apply_changes", "SELECT tbl, key_id, a_customer_id AS customer_id, a_status AS status, a_amount_cents AS amount_cents, pos FROM state")
def apply_changes(spark, sf):
    path = work_path(spark, "warehouse")
    jobs.finish(jobs.materialize_stream(staged(committed_log(spark, sf), "committed"), path, work_path(spark, "ck")))
    return sinks.read_applied(spark, path).select("tbl", "key_id", *flat("", "after"), "pos")


@query("stream_state_table", "SELECT tbl, key_id, a_customer_id AS customer_id, a_status AS status, a_amount_cents AS amount_cents, pos FROM state")
def stream_state_table(spark, sf):
    """The steps of the log arrive one after the other; levelled runs, read bucket by bucket."""
    log, topic = committed_log(spark, sf), work_path(spark, "steps")
    table_ = StateTable(spark, work_path(spark, "state_table"), buckets=8, fan_in=3)
    ck = work_path(spark, "ck")
    for steps in ((1, 2), (3,), (4, 5), (6, 7)):
        log.filter(F.col("step").isin(*steps)).write.mode("append").parquet(topic)
        jobs.finish(jobs.state_table_stream(readers.stream_changes(spark, topic, log.schema, max_bytes=BATCH_BYTES), table_, ck))
    return table_.read().select("tbl", "key_id", *flat("", "after"), "pos")


@query("stream_atomic_sinks", """
SELECT 'state' AS sink, tbl, COUNT(*) AS rows FROM state GROUP BY tbl
UNION ALL SELECT 'transitions', tbl, COUNT(*) FROM committed WHERE op = 'u' AND b_status IS DISTINCT FROM a_status GROUP BY tbl""")
def stream_atomic_sinks(spark, sf):
    """State and status changes of a batch become visible together, by one manifest."""
    table_ = StateTable(spark, work_path(spark, "atomic"), buckets=8)
    moved = lambda batch: {"transitions": materialize.transitions(batch.filter("op = 'u'"), "status", FIELDS)}
    jobs.finish(jobs.state_table_stream(staged(committed_log(spark, sf), "atomic_topic"), table_, work_path(spark, "ck"), moved))
    parts = [(name, rows.groupBy("tbl").agg(F.count(F.lit(1)).alias("rows"))) for name, rows in (
        ("state", table_.read()), ("transitions", table_.read_sink("transitions")))]
    return parts[0][1].withColumn("sink", F.lit("state")).unionByName(parts[1][1].withColumn("sink", F.lit("transitions")))


@query("stream_resume", "SELECT tbl, key_id, a_status AS status, pos FROM state")
def stream_resume(spark, sf):
    """Stopped after the first files, resumed from its checkpoint when more have arrived."""
    log = committed_log(spark, sf)
    topic, path, ck = work_path(spark, "topic"), work_path(spark, "resumed"), work_path(spark, "ck")
    for first_half in (True, False):
        log.filter((F.col("pos") % 2 == 0) == first_half).write.mode("append").parquet(topic)
        stream = readers.stream_changes(spark, topic, log.schema, max_bytes=BATCH_BYTES)
        jobs.finish(jobs.materialize_stream(stream, path, ck))
    return sinks.read_applied(spark, path).select("tbl", "key_id", F.col("after.status").alias("status"), "pos")


@query("stream_latest", """
SELECT tbl, key_id, op, a_status AS status, pos FROM split WHERE key_id IS NOT NULL
QUALIFY ROW_NUMBER() OVER (PARTITION BY tbl, key_id ORDER BY pos DESC, sub_order DESC) = 1""")
def stream_latest(spark, sf):
    path = work_path(spark, "latest")
    stream = staged(split_log(spark, sf).filter("key_id IS NOT NULL"), "split")
    jobs.run_stateful(spark, lambda: jobs.latest_stream(stream, path, work_path(spark, "ck")))
    last = materialize.latest_per_key(spark.read.parquet(path).drop("batch_id"))
    return last.select("tbl", "key_id", "op", F.col("after.status").alias("status"), "pos")


@query("stream_tx_buffer", "SELECT tbl, op, key_id, pos, tx_id FROM committed")
def stream_tx_buffer(spark, sf):
    log = change_log(spark, sf)
    ended = log.groupBy("tx_id").agg(F.max("source_ts").alias("ended"))
    events = staged(log, "log").withColumn("source_ts", F.col("source_ts").cast("timestamp"))
    outcomes = staged(transactions(log).join(ended, "tx_id"), "outcomes").withColumn("ended", F.col("ended").cast("timestamp"))
    out = work_path(spark, "flushed")
    # Order dates spread over years inside one transaction, hence the wide bounds.
    flushed = processors.buffered_stream(events, outcomes, "source_ts", "ended", "3650 days", "3650 days")
    rows = flushed.select("tbl", "op", "key_id", "pos", "tx_id", "settled")
    jobs.run_stateful(spark, lambda: jobs.settled_files(rows, out, work_path(spark, "ck")))
    return jobs.settled_rows(spark, out, rows.schema, COMMITTED, jobs.PASSED).drop("settled")


@query("stream_tx_expired", """
WITH e AS (SELECT event_id, ts, CAST(FLOOR(event_id / 10) AS BIGINT) AS tx_id FROM events),
o AS (SELECT tx_id, CASE WHEN tx_id % 5 = 0 THEN 'ABORTED' ELSE 'COMMITTED' END AS status, MAX(ts) AS ended FROM e WHERE tx_id % 7 <> 3 GROUP BY tx_id),
mark AS (SELECT LEAST((SELECT MAX(ts) FROM e), (SELECT MAX(ended) FROM o)) - INTERVAL 10 MINUTE AS w)
SELECT e.event_id, e.tx_id, COALESCE(o.status, 'EXPIRED') AS settled FROM e LEFT JOIN o ON e.tx_id = o.tx_id
WHERE o.status IS NOT NULL OR e.ts + INTERVAL 2 DAY < (SELECT w FROM mark)""", shared=False)
def stream_tx_expired(spark, sf):
    """Every seventh transaction never ends: its events come out as expired once the watermark has passed them."""
    events = table(spark, sf, "events").select("event_id", "ts", F.floor(F.col("event_id") / 10).alias("tx_id"))
    ended = events.filter("tx_id % 7 <> 3").groupBy("tx_id").agg(F.max("ts").alias("ended")).withColumn(
        "status", F.when(F.col("tx_id") % 5 == 0, "ABORTED").otherwise("COMMITTED"))
    left = event_stream(spark, sf).select(
        "event_id", "ts", F.floor(F.col("event_id") / 10).alias("tx_id"), F.col("event_id").alias("pos"), F.lit("events").alias("tbl"))
    right = staged(ended, "endings").withColumn("ended", F.col("ended").cast("timestamp"))
    out = work_path(spark, "settled")
    rows = jobs.settled_stream(left, right, "ts", "ended", "10 minutes", "2 days").select("event_id", "tx_id", "settled")
    jobs.run_stateful(spark, lambda: jobs.append_files(rows, out, work_path(spark, "ck")))
    return spark.read.parquet(out)


@query("stream_truncate_ddl", """
SELECT tbl, key_id, a_customer_id AS customer_id, a_status AS status, a_amount_cents AS amount_cents, pos FROM state""")
def stream_truncate_ddl(spark, sf):
    """Rows, truncates and later schema changes of one table in one micro-batch."""
    log = committed_log(spark, sf)
    ddl = log.groupBy("tbl").agg((F.max("pos") + 1).alias("pos"), F.max("tx_id").alias("tx_id"), F.max("source_ts").alias("source_ts")).select(
        "tbl", F.lit("DDL_ADD_COL").alias("op"), "pos", "tx_id", "source_ts")
    path = work_path(spark, "with_ddl")
    stream = staged(log.unionByName(ddl, allowMissingColumns=True), "with_ddl_topic")
    jobs.finish(jobs.materialize_stream(stream, path, work_path(spark, "ck"), fold_every=2))
    return sinks.read_applied(spark, path).select("tbl", "key_id", *flat("", "after"), "pos")


def event_stream(spark, sf) -> DataFrame:
    """The events file itself as a stream."""
    schema = table(spark, sf, "events").schema
    return readers.stream_changes(spark, sf, schema, glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_golden_signals", """
SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts) AS VARCHAR) AS window_start, COUNT(*) AS events, MAX(value) AS top_value,
       COUNT(*) FILTER (WHERE event_type = 'error') AS errors
FROM events GROUP BY time_bucket(INTERVAL 6 HOUR, ts)
HAVING time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE""", shared=False)
def stream_golden_signals(spark, sf):
    """Closed windows only: an open one is held until the watermark passes its end."""
    out = work_path(spark, "signals")
    measures = {"top_value": F.max("value"), "errors": F.count_if(F.col("event_type") == "error")}
    rows = jobs.windowed_signals(event_stream(spark, sf), "ts", "10 minutes", "6 hours", measures)
    jobs.run_stateful(spark, lambda: jobs.append_files(rows, out, work_path(spark, "ck")))
    return spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("string"))


@query("stream_latency_sketch", """
SELECT event_type, COUNT(*) AS n, TRUE AS within FROM events
WHERE time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY event_type""", shared=False)
def stream_latency_sketch(spark, sf):
    """A sketch per closed window, merged over all of them; ranks are off by a hundredth at most."""
    out = work_path(spark, "sketches")
    rows = jobs.windowed_sketches(event_stream(spark, sf), "ts", "10 minutes", "6 hours", F.col("value"), ["event_type"])
    jobs.run_stateful(spark, lambda: jobs.append_files(rows, out, work_path(spark, "ck")))
    windows = spark.read.schema(rows.schema).parquet(out)
    found = jobs.merge_sketches(windows, ["event_type"], (0.5, 0.9)).withColumnRenamed("n", "held")
    last = windows.agg(F.max("window_start") + F.expr("INTERVAL 6 HOURS")).first()[0]
    closed = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).filter(F.col("ts") < F.lit(last))
    below = lambda q: F.avg((F.col("value") < F.col(f"p{q}")).cast("int"))
    upto = lambda q: F.avg((F.col("value") <= F.col(f"p{q}")).cast("int"))
    near = lambda q: (below(q) <= q / 100 + 0.01) & (upto(q) >= q / 100 - 0.01)
    return join_small(closed, found, ["event_type"]).groupBy("event_type", "held").agg((near(50) & near(90)).alias("within")).select(
        "event_type", F.col("held").alias("n"), "within")


FILE_ROWS, BATCH_ROWS = 400, 1000


@query("stream_bounded", f"""
SELECT COUNT(*) AS rows, TRUE AS within, TRUE AS several FROM (
  SELECT id FROM base UNION ALL SELECT id FROM base WHERE id % 2 = 0)""")
def stream_bounded(spark, sf):
    """Files cut by rows, so that the bound bites: several micro-batches, none above it, and no row is lost."""
    log = change_log(spark, sf).filter("step <= 2 AND tbl = 'orders'").select("tbl", "op", "key_id", "pos", "tx_id")
    path, out = intake.cut_files(log, "bounded_topic", FILE_ROWS), work_path(spark, "intake")
    jobs.finish(intake.measured(intake.bounded_stream(spark, path, log.schema, FILE_ROWS, BATCH_ROWS), out, work_path(spark, "ck")))
    taken = spark.read.parquet(out)
    return taken.agg(F.sum("rows").alias("rows"), (F.max("rows") <= BATCH_ROWS).alias("within"), (F.count(F.lit(1)) > 1).alias("several"))


@query("stream_late_rows", """
WITH first AS (SELECT MAX(ts) - INTERVAL 10 MINUTE AS mark FROM events WHERE event_id % 10 <> 0)
SELECT event_id, event_id % 10 = 0 AND ts < (SELECT mark FROM first) AS late FROM events""", shared=False)
def stream_late_rows(spark, sf):
    """A tenth of the events arrives in a second delivery; those behind the watermark are kept apart as rows."""
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    topic, path, ck = work_path(spark, "deliveries"), work_path(spark, "by_lateness"), work_path(spark, "ck")
    for second in (False, True):
        events.filter((F.col("event_id") % 10 == 0) == second).write.mode("append").parquet(topic)
        stream = readers.stream_changes(spark, topic, events.schema)
        jobs.finish(jobs.lateness_stream(stream, "ts", 600, path, ck))
    return jobs.by_lateness(spark, path).select("event_id", "late")


@query("stream_dedupe", "SELECT event_id, user_id, event_type FROM events", shared=False)
def stream_dedupe(spark, sf):
    out = work_path(spark, "unique")
    copies = F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    delivered = event_stream(spark, sf).withColumn("copy", copies)
    rows = jobs.dedupe_stream(delivered, "ts", "10 minutes").select("event_id", "user_id", "event_type")
    jobs.run_stateful(spark, lambda: jobs.append_files(rows, out, work_path(spark, "ck")))
    return spark.read.parquet(out)


@query("stream_dlq", f"""
, r AS (SELECT *, {REASON} AS reason FROM decoded)
SELECT key_id, reason, CASE WHEN reason IS NULL THEN 'main' ELSE 'dlq' END AS route FROM r""")
def stream_dlq(spark, sf):
    raw = raw_messages(spark, sf).select("key_id", F.unhex("value_hex").alias("value"))
    parsed = parse_messages(staged(raw, "raw"), PAYLOAD, known_ids=[42, 43])
    path = work_path(spark, "routed")
    jobs.finish(jobs.route_stream(parsed, path, work_path(spark, "ck")))
    return spark.read.parquet(path).select("key_id", "reason", "route")


@query("stream_snapshot_window", WINDOWS + """
SELECT chunk_id, key_id, status, 'r' AS op, 'READ' AS event_type FROM reads
WHERE chunk_id IN (SELECT chunk_id FROM windows WHERE high <= (SELECT MAX(pos) FROM committed WHERE tbl = 'orders'))""")
def stream_snapshot_window(spark, sf):
    """Windows are opened and closed by signals in the stream; what the log changes inside them does not come out."""
    log = staged(committed_log(spark, sf).filter("tbl = 'orders'").select("key_id", "pos"), "orders_log")
    signals = window_signals(spark, sf)
    opened = signals.filter(F.col("type") == OPEN).select("chunk_id", F.col("pos").alias("low"))
    reads = order_rows(spark, sf).join(opened, "chunk_id").withColumn("pos", F.col("low") + 1)
    path = work_path(spark, "windows")
    rows = processors.snapshot_stream(
        log, staged(signals, "signals"), staged(reads, "chunk_reads"), chunk_number("key_id", CHUNK), ["status"], delay=1000)
    jobs.run_stateful(spark, lambda: jobs.append_files(rows, path, work_path(spark, "ck")))
    return processors.window_reads(spark.read.schema(rows.schema).parquet(path)).select("chunk_id", "key_id", "status", "op", "event_type")


@query("stream_fan_out", """
SELECT 'warehouse' AS consumer, tbl, key_id, pos, a_status AS detail FROM state
UNION ALL SELECT 'microservice', tbl, key_id, pos, a_status FROM committed WHERE op = 'u' AND b_status IS DISTINCT FROM a_status
UNION ALL SELECT 'search', tbl, key_id, pos, CASE WHEN op = 'd' THEN 'REMOVE' ELSE 'UPSERT' END FROM last_event""")
def stream_fan_out(spark, sf):
    """Three consumers of one topic, each with its own checkpoint."""
    log = committed_log(spark, sf)
    paths = {c: work_path(spark, c) for c in ("warehouse", "microservice", "search")}

    def microservice(batch: DataFrame, batch_id: int) -> None:
        moved = materialize.transitions(batch.filter("op = 'u'"), "status", FIELDS)
        moved.write.mode("overwrite").parquet(sinks.batch_folder(paths["microservice"], batch_id))

    def search(batch: DataFrame, batch_id: int) -> None:
        rows = split_pk_update(batch).select("tbl", "key_id", "op", "pos", "sub_order", "after")
        materialize.latest_per_key(rows).write.mode("overwrite").parquet(sinks.batch_folder(paths["search"], batch_id))

    consumers = {
        "warehouse": lambda df, i: sinks.apply_batch(df, i, paths["warehouse"]), "microservice": microservice, "search": search}
    for running in jobs.fan_out(staged(log, "fan_topic"), work_path(spark, "ck"), consumers).values():
        jobs.finish(running)
    state = sinks.read_applied(spark, paths["warehouse"]).select("tbl", "key_id", "pos", F.col("after.status").alias("detail"))
    moved = spark.read.parquet(paths["microservice"]).select("tbl", "key_id", "pos", F.col("new_value").alias("detail"))
    feed = spark.read.parquet(paths["search"]).drop("batch_id")
    docs = materialize.search_feed(feed, materialize.truncates(feed.withColumn("source_ts", F.lit(None).cast("timestamp")))).filter("action <> 'CLEAR'").select("tbl", "key_id", "pos", F.col("action").alias("detail"))
    out = None
    for name, rows in (("warehouse", state), ("microservice", moved), ("search", docs)):
        one = rows.withColumn("consumer", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("consumer", "tbl", "key_id", "pos", "detail")
