"""Topic, table and dead-letter sinks. Every write of a micro-batch replaces its own folder, so a
repeated batch leaves one copy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..envelope import LAYOUT, Layout
from ..functions.wire import wire_encode
from ..operators.deadletter import with_route
from ..operators.expand import split_pk_update
from ..operators.materialize import latest_per_key, truncate_barrier


def keyed_messages(events: DataFrame, layout: Layout = LAYOUT, schema_id: Column | None = None) -> DataFrame:
    """Topic records ``topic, partition, key, value, headers`` in JSON; a tombstone has a NULL value.

    With a ``schema_id`` the value starts with the wire header, as the parser expects it. Events
    without a key go under the name of their table. The headers tell the table and the commit order.
    """
    value = F.to_json(F.struct(layout.op, layout.before, layout.after), {"ignoreNullFields": "false"})
    if schema_id is not None:
        value = wire_encode(schema_id, value)
    dead_row = F.col("tombstone") if "tombstone" in events.columns else F.lit(False)
    key = F.to_json(F.when(F.col(layout.key).isNotNull(), F.struct(F.col(layout.key).alias("id"))))
    order = [F.lit("pos"), F.col(layout.pos).cast("string"), F.lit("sub"), F.col(layout.sub).cast("string")]
    return events.withColumns({
        "key": F.coalesce(key, F.col(layout.table)), "value": F.when(~dead_row, value),
        "headers": F.create_map(F.lit("table"), F.col(layout.table), *order)})


def write_topic(messages: DataFrame, path: str) -> None:
    """Batch topic write: files by topic, each partition ordered by offset."""
    (messages.repartition("topic", "partition", F.floor(F.col("offset") / 1_000_000))
     .sortWithinPartitions("topic", "partition", "offset").write.partitionBy("topic").parquet(path))


def write_kafka(messages: DataFrame, servers: str, **options: str) -> None:
    """Batch write of ``topic, key, value, partition``. Needs the Kafka connector of Spark."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).options(
        **{"kafka.acks": "all", "kafka.enable.idempotence": "true", **options}).save()


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def _kept(layout: Layout) -> list[str]:
    return [layout.op, layout.after, layout.pos, layout.sub]


def apply_batch(batch: DataFrame, batch_id: int, path: str, layout: Layout = LAYOUT) -> None:
    """Stores the last event per key of a micro-batch in one pass, and the last truncate of each table
    as a row without a key. Other events without a key, such as schema changes, hold no state."""
    rows = split_pk_update(batch, layout).filter(F.col(layout.key).isNotNull() | (F.col(layout.op) == "t"))
    latest_per_key(rows, layout, _kept(layout)).write.mode("overwrite").parquet(batch_folder(f"{path}/changes", batch_id))


def _newest_base(spark: SparkSession, path: str) -> int | None:
    """The newest base that was written to its end, from the names of its folder alone."""
    jvm = spark.sparkContext._jvm
    marks = jvm.org.apache.hadoop.fs.Path(f"{path}/base/upto=*/_SUCCESS")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks) or []
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=None)


def _stored(spark: SparkSession, path: str, base: int | None, upto: int | None = None) -> DataFrame:
    """Rows of a base and of the batches after it, up to ``upto``."""
    changes = spark.read.parquet(f"{path}/changes")
    if base is not None:
        changes = changes.filter(F.col("batch_id") > base)
    if upto is not None:
        changes = changes.filter(F.col("batch_id") <= upto)
    changes = changes.drop("batch_id")
    return changes if base is None else changes.unionByName(spark.read.parquet(f"{path}/base/upto={base}"))


def _merged(stored: DataFrame, layout: Layout) -> DataFrame:
    truncated = stored.filter(F.col(layout.op) == "t").select(layout.table, layout.pos, layout.sub)
    return latest_per_key(truncate_barrier(stored, truncated, layout), layout, _kept(layout))


def read_applied(spark: SparkSession, path: str, layout: Layout = LAYOUT) -> DataFrame:
    """Current rows of a table written by ``apply_batch``: merged by position when read."""
    last = _merged(_stored(spark, path, _newest_base(spark, path)), layout)
    return last.filter(F.col(layout.op) != "d").select(*layout.row_key, layout.after, layout.pos)


def fold_batches(spark: SparkSession, path: str, upto: int, layout: Layout = LAYOUT) -> None:
    """Folds the batches up to ``upto`` into a new base, so that reads stay short.

    Deletes and truncates are kept: an older event that arrives late must not bring a row back.
    """
    base = _newest_base(spark, path)
    if base is not None and base >= upto:
        return
    stored = _stored(spark, path, base, upto)
    cleared = latest_per_key(stored.filter(F.col(layout.op) == "t"), layout, _kept(layout))
    _merged(stored, layout).unionByName(cleared).write.mode("overwrite").parquet(f"{path}/base/upto={upto}")


def start_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """A query that takes what is available now and then ends; call again to resume."""
    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def route_batch(parsed: DataFrame, batch_id: int, path: str) -> None:
    """Writes good and dead rows of a parsed micro-batch in one pass, as partitions ``route=main``
    and ``route=dlq``."""
    with_route(parsed).write.mode("overwrite").partitionBy("route").parquet(batch_folder(path, batch_id))
