"""Percentiles of any number of values: exact ones by narrowing ranges, and sketches that merge.

``exact_percentiles`` counts values by ranges of equal width, keeps the range that holds the wanted rank, and goes on within it, until so
few rows are left that they can be sorted. Each pass is one aggregation with partial results, so neither a task nor the driver ever
holds the values of a group. Ranges are bounded by values that occur, so rounding can't lose one.

``sketch`` gives KLL sketches: bounded in size, merged over tasks, windows and time, with a stated error of the rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_path
from .skew import join_small

BUCKETS = 4096
SORTED_ROWS = 100_000
SKETCH_SIZE = 4096  # k of the sketch


def _narrowed(values: DataFrame, ranges: DataFrame, group: list[str], buckets: int) -> DataFrame:
    """For every range the one of its parts that holds the wanted rank."""
    met = join_small(values, ranges, group).filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    # Halves, as the width itself may be beyond a double; where a half has no width, the lowest value is set apart.
    width = F.col("hi") / 2 - F.col("lo") / 2
    bucket = F.when(width > 0, F.floor((F.col("v") / 2 - F.col("lo") / 2) / F.nullif(width, F.lit(0.0)) * buckets)).otherwise(
        (F.col("v") > F.col("lo")).cast("long")).alias("bucket")
    parts = met.select(*group, "target", "rank", "below", bucket, "v").groupBy(*group, "target", "rank", "below", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # At most buckets + 1 rows in each window.
    along = Window.partitionBy(*group, "target").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(along), F.lit(0)))
    return summed.filter((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n"))).select(
        *group, "target", "rank", "below", "n", "lo", "hi")


def exact_percentiles(
    df: DataFrame, value: Column, by: Sequence[str] = (), shares: Sequence[float] = (0.95, 0.99), names: Sequence[str] | None = None,
    buckets: int = BUCKETS, sorted_rows: int = SORTED_ROWS,
) -> DataFrame:
    """One row per group with the interpolated percentiles, as ``percentile`` gives them. NULL and NaN values don't count."""
    names = list(names) if names else [f"p{round(q * 100)}" for q in shares]
    spark, group = df.sparkSession, ["__group"]
    whole = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    # A group is named by the text of its columns, so that NULL is a group too.
    values = df.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("__group"), *by, value.cast("double").alias("v")).filter(
        F.col("v").isNotNull() & ~F.isnan("v"))
    totals = values.groupBy("__group", *by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    path = work_path(spark, "percentiles")
    totals.write.parquet(f"{path}/totals")
    totals = spark.read.schema(totals.schema).parquet(f"{path}/totals")
    place = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    targets = F.explode(F.array(*[
        F.struct(F.lit(2 * i + j).alias("target"), f(place(q)).cast("long").alias("rank"))
        for i, q in enumerate(shares) for j, f in enumerate((F.floor, F.ceil))]))
    ranges = totals.select("__group", targets.alias("t"), "n", "lo", "hi").select(
        "__group", "t.target", "t.rank", F.lit(0).cast("long").alias("below"), "n", "lo", "hi")
    slim, step = values.select("__group", "v"), 0
    while ranges.filter((F.col("n") > sorted_rows) & (F.col("lo") < F.col("hi"))).limit(1).count():
        ranges = _narrowed(slim, ranges, group, buckets)
        ranges.write.parquet(f"{path}/ranges-{step}")
        ranges = spark.read.schema(ranges.schema).parquet(f"{path}/ranges-{step}")
        step += 1
    # What is left of a range is few rows, or many of one value; equal values are counted before they meet.
    left = join_small(slim, ranges, group).filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).groupBy(
        "__group", "target", "rank", "below", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("__group", "target").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = left.withColumn("upto", F.col("below") + F.sum("n").over(upto)).filter(F.col("upto") > F.col("rank")).groupBy(
        "__group", "target").agg(F.min("v").alias("v"))
    per_group = found.groupBy("__group").agg(*[F.max(F.when(F.col("target") == t, F.col("v"))).alias(f"__v{t}") for t in range(2 * len(shares))])
    between = [
        (F.col(f"__v{2 * i}") + (place(q) - F.floor(place(q))) * (F.col(f"__v{2 * i + 1}") - F.col(f"__v{2 * i}"))).alias(name)
        for i, (q, name) in enumerate(zip(shares, names, strict=True))]
    return totals.join(per_group, "__group").select(*by, *between)


def sketch(value: Column, size: int = SKETCH_SIZE) -> Column:
    """Aggregate: the sketch of a column of doubles, NULL left out."""
    return F.kll_sketch_agg_double(value.cast("double"), size)


def merged(sketches: Column) -> Column:
    """Aggregate: one sketch for all values of the given ones."""
    return F.kll_merge_agg_double(sketches)


def sketch_percentiles(sketches: DataFrame, column: str, shares: Sequence[float], names: Sequence[str] | None = None) -> DataFrame:
    """Replaces a sketch by the number of its values and its percentiles."""
    names = list(names) if names else [f"p{round(q * 100)}" for q in shares]
    return sketches.withColumns({
        "n": F.kll_sketch_get_n_double(column),
        **{n: F.kll_sketch_get_quantile_double(F.col(column), F.lit(float(q))) for n, q in zip(names, shares, strict=True)}}).drop(column)
