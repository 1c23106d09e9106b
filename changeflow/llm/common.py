"""Helpers of the operators: tables in the shared folder, ids, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path

LAST_ID = 2**63 - 1
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Lets Spark remove the shuffle files of each job that ends inside, as nothing reads them again.

    An operator of many small steps otherwise keeps those of all steps until the driver collects garbage.
    """
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here and a lost executor loses nothing."""
    path = work_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def known_id(column: str = "doc_id") -> Column:
    """The id, with null as the largest one."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash128(value: Column) -> list[Column]:
    """Two 64-bit hashes of different seeds; together they take the place of the value."""
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2")]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id): the smallest id reachable over ``edges``, for every id on an edge.

    Alternates large-star and small-star steps, so the number of rounds grows with the logarithm
    of the longest chain. Each round is written to the shared folder; only two numbers come back.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    pairs = written(pairs.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "links")
    state = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        pairs = written(small.filter("u <> v").distinct(), "stars")
        row = pairs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == tuple(row):
            break
        state = tuple(row)
    roots = pairs.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)
