"""Hot keys: the balanced forms give the rows of the plain forms, and really split the work."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from changeflow.operators import skew
from changeflow.operators.materialize import change_history, truncate_counts
from changeflow.operators.snapshot import chunk_plan_exact


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def hot_frame(spark):
    """Key 1 holds two thirds of 6000 rows; order values are clumped and tied to nothing."""
    n = F.col("id")
    key = F.when(n % 3 != 0, 1).otherwise(n % 50).cast("long")
    return spark.range(6000).select(key.alias("k"), ((n * 7919) % 6000 * (n % 6000 + 1)).alias("x"), n.alias("o"))


def test_sketch_finds_hot_keys_only(spark, hot_frame):
    assert len(skew.hot_hashes(hot_frame, ["k"], 1000)) == 1
    assert skew.hot_hashes(hot_frame, ["k"], 100_000) == []
    assert skew.hot_hashes(hot_frame.limit(0), ["k"], 1) == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("key", [0, 1])
def test_skew_join_equals_join(spark, hot_frame, how, key):
    right = spark.range(0, 30, 2).select((F.col("id") + key).alias("k"), F.col("id").alias("v"))
    if how in ("left_semi", "left_anti"):
        right = right.select("k")
    want = hot_frame.join(right, "k", how)
    got = skew.skew_join(hot_frame, right, ["k"], how, hot_rows=500, salts=8)
    assert rows_of(got) == rows_of(want)


def test_skew_join_spreads_the_hot_key(spark, hot_frame):
    right = spark.range(50).select(F.col("id").alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = skew.skew_join(hot_frame, right, ["k"], "inner", hot_rows=500, salts=32).filter("k = 1")
        tasks = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and max(t["count"] for t in tasks) < 4000


def test_join_small_on_both_sides_of_the_limit(spark, hot_frame):
    right = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = rows_of(hot_frame.join(right, "k", "left"))
    assert rows_of(skew.join_small(hot_frame, right, ["k"], "left")) == want
    assert rows_of(skew.join_small(hot_frame, right, ["k"], "left", limit=5, hot_rows=500)) == want


def test_bounded_checks_rows_and_bytes(spark):
    df = spark.range(100)
    assert skew.bounded(df, 99) is None and skew.bounded(df, 100).count() == 100
    assert skew.bounded(df, 1000, size=10) is None
    assert skew.bounded(df.limit(0)).count() == 0


@pytest.mark.parametrize("group", [["k"], []])
def test_row_numbers(spark, hot_frame, group):
    want = hot_frame.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy("o")).cast("long"))
    for segment_rows in (70, 900, 10_000):
        got = skew.row_numbers(hot_frame, group, ["o"], "rn", hot_rows=100, segment_rows=segment_rows)
        assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("following", [False, True])
def test_neighbours(spark, hot_frame, following):
    shift = F.lead if following else F.lag
    want = hot_frame.withColumn("n", shift(F.struct("o", "x")).over(Window.partitionBy("k").orderBy("o")))
    got = skew.neighbours(hot_frame, ["k"], ["o"], ["o", "x"], "n", following=following, hot_rows=100, segment_rows=90)
    assert rows_of(got) == rows_of(want)


def test_segments_split_the_hot_group(spark, hot_frame):
    marked, split = skew._segmented(hot_frame, ["k"], ["o"], 500, 200)
    sizes = [r["count"] for r in marked.filter("k = 1").groupBy(skew._SEG).count().collect()]
    assert split and len(sizes) >= 15 and max(sizes) <= 500 and sum(sizes) == hot_frame.filter("k = 1").count()


def test_segments_with_few_distinct_order_values(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") % 3).alias("o"), F.col("id").alias("t"))
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o", "t")).cast("long"))
    got = skew.row_numbers(df, ["k"], ["o", "t"], "rn", hot_rows=10, segment_rows=10)
    assert rows_of(got) == rows_of(want)


def test_history_of_a_hot_key(spark):
    n = F.col("id")
    log = spark.range(2000).select(
        F.lit("t").alias("tbl"), F.when(n % 500 == 499, "d").otherwise("u").alias("op"), F.when(n % 4 == 0, n).otherwise(1).alias("key_id"),
        n.alias("pos"), F.lit(0).alias("sub_order"), F.timestamp_seconds(n).alias("source_ts"))
    cuts = log.filter("pos IN (700, 1400)").select("tbl", F.col("pos"), "source_ts")
    plain = change_history(log, cuts)
    split = change_history(log, cuts, hot_rows=50, segment_rows=60)
    merged = change_history(log, cuts, few_truncates=1)
    merged_split = change_history(log, cuts, few_truncates=1, hot_rows=50, segment_rows=60)
    assert plain.count() > 1000
    assert rows_of(split) == rows_of(merged) == rows_of(merged_split) == rows_of(plain)


@pytest.mark.parametrize("split", [{}, {"hot_rows": 10, "segment_rows": 7}])
def test_many_truncates(spark, split):
    """A table that is truncated after every third event."""
    n = F.col("id")
    log = spark.range(300).select(
        F.lit("t").alias("tbl"), F.when(n % 3 == 2, "t").otherwise("c").alias("op"), F.when(n % 3 != 2, n % 2).alias("key_id"),
        n.alias("pos"), F.lit(0).alias("sub_order"), F.timestamp_seconds(n).alias("source_ts"))
    cuts = log.filter("op = 't'").select("tbl", "pos", "source_ts")
    counts = truncate_counts(log, cuts, few_truncates=5, **split)
    assert rows_of(counts) == rows_of(truncate_counts(log, cuts)) and counts.count() == 100
    assert counts.agg(F.sum("purged")).first()[0] == 200
    history = change_history(log, cuts, few_truncates=5, **split)
    assert rows_of(history) == rows_of(change_history(log, cuts)) and history.filter("valid_to IS NULL").count() == 0


@pytest.mark.parametrize("segment_rows", [3, 40, 5000])
def test_next_value(spark, hot_frame, segment_rows):
    df = hot_frame.withColumn("v", F.when(F.col("o") % 97 == 0, F.col("x")))
    window = Window.partitionBy("k").orderBy(F.col("o").desc()).rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("n", F.last("v", ignorenulls=True).over(window))
    got = skew.next_value(df, ["k"], ["o"], "v", "n", hot_rows=50, segment_rows=segment_rows)
    assert rows_of(got) == rows_of(want)


def test_exact_chunks_over_segments(spark):
    keys = spark.range(5000).select((F.col("id") * F.col("id")).alias("key"))
    rows = chunk_plan_exact(keys, "key", 100, hot_rows=10, segment_rows=333).orderBy("chunk_id").collect()
    assert [r["rows"] for r in rows] == [100] * 50
    assert all(r["first_key"] == (i * 100) ** 2 and r["last_key"] == (i * 100 + 99) ** 2 for i, r in enumerate(rows))


def test_many_borders_are_searched_in_parts(spark, monkeypatch):
    """Segments of a few rows: a list of all their borders with every row grows with the square of the rows."""
    n = F.col("id")
    frame = spark.range(3000).select(
        F.when(n % 5 != 0, n % 2).alias("k"), ((n * 7919) % 500).cast("string").alias("x"), n.alias("o"))
    lists = []
    made = type(spark).createDataFrame
    def seen(self, data, *args, **kwargs):
        if hasattr(data, "column") and "__cuts" in data.column_names:
            lists.extend(len(x) for x in data.column("__cuts"))
        return made(self, data, *args, **kwargs)
    monkeypatch.setattr(type(spark), "createDataFrame", seen)
    monkeypatch.setattr(skew, "_SAMPLES", 1)
    monkeypatch.setattr(skew, "_FEW_CUTS", 16, raising=False)
    got = skew.row_numbers(frame, ["k"], ["x", "o"], "n", hot_rows=100, segment_rows=5)
    w = Window.partitionBy("k").orderBy("x", "o")
    assert rows_of(got) == rows_of(frame.withColumn("n", F.row_number().over(w).cast("long")))
    assert 5 < max(lists) < 60 and sum(lists) > 600
