"""Scans of change events, topics and source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..envelope import ENVELOPE


def scan_changes(spark: SparkSession, path: str, schema: StructType = ENVELOPE, fmt: str = "parquet") -> DataFrame:
    """Batch scan with a declared schema, so nothing is inferred and columns are pruned."""
    return spark.read.schema(schema).format(fmt).load(path)


def stream_changes(
    spark: SparkSession, path: str, schema: StructType = ENVELOPE, fmt: str = "parquet",
    max_files: int | None = None, glob: str | None = None, max_bytes: int | None = None,
) -> DataFrame:
    """Streaming scan of a folder of files; ``max_bytes`` or ``max_files`` bounds what one micro-batch takes in."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def kafka_topic(
    spark: SparkSession, servers: str, topics: str, streaming: bool = True,
    max_offsets: int | None = None, **options: str,
) -> DataFrame:
    """Topic records as ``key, value, headers, topic, partition, offset, timestamp``.

    Needs the Kafka connector of Spark on the class path.
    """
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    reader = reader.option("kafka.bootstrap.servers", servers).option("subscribePattern", topics)
    reader = reader.option("includeHeaders", "true").option("startingOffsets", "earliest")
    if streaming and max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.options(**options).load()


def jdbc_table(
    spark: SparkSession, url: str, tbl: str, key: str, lower: int, upper: int, partitions: int, **options: str,
) -> DataFrame:
    """Parallel snapshot read by ranges of a numeric key. Needs the driver of the database."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=tbl, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=partitions, **options
    ).load()


def to_envelope(log: DataFrame, engine: str = "postgres", database: str = "orders_db", schema: str = "public") -> DataFrame:
    """A typed change log in envelope form."""
    from ..envelope import category, event_type
    from ..functions.routing import event_id
    from .engines import image

    text = lambda c: F.lit(c).cast("string")
    none = lambda t: F.lit(None).cast(t)
    return log.select(
        event_id(F.lit(engine), F.col("tbl"), F.col("pos"), F.lit(0)).alias("event_id"),
        event_type(F.col("op")).alias("event_type"), "op", category(F.col("op")).alias("category"),
        F.struct(text(engine).alias("type"), none("string").alias("cluster"), text(database).alias("database"),
                 text(schema).alias("schema"), F.col("tbl").alias("table")).alias("source"),
        F.struct(F.col("tx_id").cast("string").alias("id"), none("timestamp").alias("ts"), none("int").alias("ord")).alias("tx"),
        F.struct(F.lit("LSN").alias("type"), F.col("pos").cast("string").alias("value")).alias("position"),
        F.col("pos").cast("decimal(38,0)").alias("pos_ord"),
        F.when(F.col("key_id").isNotNull(), F.create_map(F.lit("id"), F.col("key_id").cast("string"))).alias("key"),
        image(log, "before").alias("before"), image(log, "after").alias("after"),
        F.lit(False).alias("snapshot"),
        F.col("source_ts").cast("timestamp").alias("source_ts"), F.col("capture_ts").cast("timestamp").alias("capture_ts"),
        F.lit("EMITTED_TO_KAFKA").alias("status"))
