"""Streaming forms of the operators. State is kept by Spark's own joins and aggregations, in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..envelope import LAYOUT, Layout
from ..operators.commit import COMMITTED
from ..operators.quantiles import SKETCH_SIZE, merged, sketch, sketch_percentiles
from ..operators.snapshot import superseded_keys
from ..session import keep_state_on_disk
from ..sources.sinks import apply_batch, batch_folder, fold_batches, route_batch, start_batches
from ..sources.state_table import StateTable

STATE_SALTS = 16


def finish(query: StreamingQuery) -> StreamingQuery:
    """Waits for a query over available data; raises what it raised."""
    query.awaitTermination()
    return query


def run_stateful(spark: SparkSession, start: Callable[[], StreamingQuery], partitions: int | None = None) -> StreamingQuery:
    """Starts a query with state and waits for it. The number of state partitions is fixed for the
    life of a checkpoint; by default it is the number of cores of the cluster."""
    keep_state_on_disk(spark)
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(partitions or max(8, spark.sparkContext.defaultParallelism)))
    try:
        running = start()
    finally:
        spark.conf.set(setting, before)
    return finish(running)


def append_files(stream: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ()) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).start(path)


FOLD_EVERY = 16


def materialize_stream(
    stream: DataFrame, path: str, checkpoint: str, layout: Layout = LAYOUT, fold_every: int = FOLD_EVERY,
) -> StreamingQuery:
    """Applies committed changes batch by batch and folds every ``fold_every`` of them into a base;
    read the table with ``read_applied``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, batch_id, path, layout)
        if (batch_id + 1) % fold_every == 0:
            fold_batches(batch.sparkSession, path, batch_id, layout)

    return start_batches(stream, checkpoint, handle)


def state_table_stream(
    stream: DataFrame, table: StateTable, checkpoint: str, sinks: Callable[[DataFrame], Mapping[str, DataFrame]] | None = None,
) -> StreamingQuery:
    """Applies committed changes to a ``StateTable``. ``sinks`` derives other outputs of a batch, which become visible with it."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            table.apply(batch, batch_id, sinks(batch) if sinks else None)
        finally:
            batch.unpersist()

    return start_batches(stream, checkpoint, handle)


def latest_stream(stream: DataFrame, path: str, checkpoint: str, layout: Layout = LAYOUT) -> StreamingQuery:
    """Running last event per key, kept in the state store; each batch writes the keys it changed.

    Rows are reduced per key before the shuffle of every micro-batch.
    """
    keep = F.struct(layout.op, layout.after, layout.pos, layout.sub)
    state = stream.groupBy(*layout.row_key).agg(F.max_by(keep, F.struct(layout.pos, layout.sub)).alias("last"))
    changed = state.select(*layout.row_key, "last.*")
    return (changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(batch_folder(path, i)))
            .trigger(availableNow=True).start())


EXPIRED, PASSED = "EXPIRED", "PASSED"


def settled_stream(
    events: DataFrame, outcomes: DataFrame, event_ts: str, outcome_ts: str, delay: str, max_open: str,
    layout: Layout = LAYOUT, salts: int = STATE_SALTS,
) -> DataFrame:
    """Events with ``settled``: the outcome of their transaction, as soon as it arrives.

    A stream-stream join with its state in the state store. The salt spreads one huge transaction
    over many tasks; only the few outcome rows are repeated. Events whose outcome does not come
    within ``max_open`` leave as EXPIRED when the watermark passes them, so none is lost. Events that
    belong to no transaction (snapshot reads, for example) leave at once as PASSED. They do not go through
    the watermark: where there are none, a watermark of their own would hold back that of the join.
    """
    inside, outside = events.filter(F.col(layout.tx).isNotNull()), events.filter(F.col(layout.tx).isNull())
    left = inside.withWatermark(event_ts, delay).withColumn(
        "__salt", F.pmod(F.xxhash64(layout.table, layout.pos), F.lit(salts)).cast("int"))
    right = outcomes.withWatermark(outcome_ts, delay).select(
        F.col(layout.tx).alias("__tx"), F.col(outcome_ts).alias("__done"), F.col("status").alias("__status")).withColumn(
        "__rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    span = F.expr(f"INTERVAL {max_open}")
    same = (F.col(layout.tx) == F.col("__tx")) & (F.col("__salt") == F.col("__rsalt"))
    in_time = (F.col("__done") >= F.col(event_ts) - span) & (F.col("__done") <= F.col(event_ts) + span)
    joined = left.join(right, same & in_time, "left_outer")
    settled = joined.withColumn("settled", F.coalesce("__status", F.lit(EXPIRED))).drop("__tx", "__done", "__status", "__salt", "__rsalt")
    return settled.unionByName(outside.withColumn("settled", F.lit(PASSED)))


def committed_stream(
    events: DataFrame, outcomes: DataFrame, event_ts: str, outcome_ts: str, delay: str, max_open: str,
    layout: Layout = LAYOUT, salts: int = STATE_SALTS,
) -> DataFrame:
    """Holds events until their transaction commits; rolled-back and expired ones never leave, those of no
    transaction leave at once. See ``settled_stream``; ``settled_files`` keeps the expired ones too."""
    settled = settled_stream(events, outcomes, event_ts, outcome_ts, delay, max_open, layout, salts)
    return settled.filter(F.col("settled").isin(COMMITTED, PASSED)).drop("settled")


def settled_files(settled: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the rows of ``settled_stream``, each outcome to a folder of its own; expired ones can be looked into or sent again."""
    return append_files(settled, path, checkpoint, ("settled",))


def settled_rows(spark: SparkSession, path: str, schema: StructType, *outcomes: str) -> DataFrame:
    """Rows written by ``settled_files`` with one of the outcomes; ``schema`` is that of the stream."""
    return spark.read.schema(schema).parquet(path).filter(F.col("settled").isin(*outcomes)).select(*schema.names)


def windowed_signals(stream: DataFrame, ts: str, delay: str, window: str, measures: Mapping[str, Column]) -> DataFrame:
    """Tumbling-window signals; late rows beyond ``delay`` are dropped and counted by Spark."""
    return (
        stream.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"), *[m.alias(n) for n, m in measures.items()])
        .select(F.col("w.start").alias("window_start"), "events", *measures))


def windowed_sketches(stream: DataFrame, ts: str, delay: str, window: str, value: Column, by: Sequence[str] = (), size: int = SKETCH_SIZE) -> DataFrame:
    """A quantile sketch per tumbling window (and ``by``). Its state is one bounded sketch, whatever the window holds, and
    sketches of several windows merge to that of all their values (``merge_sketches``)."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), *by).agg(sketch(value, size).alias("sketch")).select(
        F.col("w.start").alias("window_start"), *by, "sketch")


def merge_sketches(rows: DataFrame, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Number of values and percentiles over the windows of each ``by``."""
    return sketch_percentiles(rows.groupBy(*by).agg(merged(F.col("sketch")).alias("sketch")), "sketch", shares)


def dedupe_stream(stream: DataFrame, ts: str, delay: str, event_id: str = "event_id") -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([event_id])


def lateness_stream(stream: DataFrame, ts: str, delay_seconds: int, path: str, checkpoint: str) -> StreamingQuery:
    """Writes all rows of a stream, late ones apart: those more than the delay behind the newest row of
    earlier batches, which a watermark of that delay would drop. Each batch also stores its newest time."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = None
        if batch_id:
            marks = spark.read.schema("newest timestamp, batch_id long").parquet(f"{path}/marks")
            newest = marks.filter(F.col("batch_id") < batch_id).agg(F.max("newest").cast("string")).first()[0]
        bound = F.lit(newest).cast("timestamp") - F.make_dt_interval(secs=F.lit(delay_seconds))
        late = F.coalesce(F.col(ts) < bound, F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(batch_folder(f"{path}/rows", batch_id))
        batch.agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(batch_folder(f"{path}/marks", batch_id))

    return start_batches(stream, checkpoint, handle)


def by_lateness(spark: SparkSession, path: str) -> DataFrame:
    """Rows written by ``lateness_stream`` with ``batch_id`` and ``late``."""
    return spark.read.parquet(f"{path}/rows").withColumn("late", F.col("late").cast("boolean"))


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped as late over the progress reports a query still holds (a hundred by default);
    ``lateness_stream`` keeps the rows themselves."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def route_stream(parsed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return start_batches(parsed, checkpoint, lambda df, i: route_batch(df, i, path))


def superseded_stream(
    log: DataFrame, chunk_rows: DataFrame, windows: DataFrame, path: str, checkpoint: str, chunk_of: Column | None = None,
) -> StreamingQuery:
    """Stores the chunk keys that each micro-batch of the log changed inside their windows."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        superseded_keys(chunk_rows, batch, windows, chunk_of=chunk_of).write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return start_batches(log, checkpoint, handle)


def closed_chunks(
    spark: SparkSession, chunk_rows: DataFrame, windows: DataFrame, path: str, log_position: int,
    key: str = "key_id", chunk: str = "chunk_id",
) -> DataFrame:
    """READ events of the chunks whose closing watermark the log has passed."""
    closed = windows.filter(F.col("high") <= log_position).select(chunk)
    changed = spark.read.parquet(path).select(chunk, key).distinct()
    rows = chunk_rows.join(closed, chunk, "left_semi")
    return rows.join(changed, [chunk, key], "left_anti").withColumns({"op": F.lit("r"), "event_type": F.lit("READ")})


def fan_out(
    stream: DataFrame, checkpoint: str, consumers: Mapping[str, Callable[[DataFrame, int], None]],
) -> dict[str, StreamingQuery]:
    """One query per consumer, each with a checkpoint and a pace of its own."""
    return {name: start_batches(stream, f"{checkpoint}/{name}", handle) for name, handle in consumers.items()}
