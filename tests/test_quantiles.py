"""Exact percentiles by narrowing ranges against one buffer, and the rank error of sketches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from changeflow.operators import quantiles, signals

SHARES = (0.0, 0.1, 0.5, 0.95, 0.99, 1.0)


def values_of(kind, n=1500):
    rng = random.Random(n)
    draw = {
        "distinct": lambda i: i * 1.000001, "tied": lambda i: float(i % 7), "one": lambda i: 4.25, "long tail": lambda i: math.exp(i / 20),
        "negative": lambda i: rng.gauss(0, 1), "tiny": lambda i: 1e-300 * i, "odd": lambda i: rng.choice([None, float("nan"), -0.0, 0.0, 5e-324, 1e308, -1e308]),
    }[kind]
    return [(rng.choice(["a", "a", "a", "b", None]), draw(i)) for i in range(n)] + [("c", 3.0), ("d", None)]


@pytest.mark.parametrize("kind", ["distinct", "tied", "one", "long tail", "negative", "tiny"])
def test_exact_percentiles(spark, kind):
    df = spark.createDataFrame(values_of(kind), "g string, v double")
    got = quantiles.exact_percentiles(df, F.col("v"), ["g"], SHARES, [f"q{i}" for i in range(len(SHARES))], buckets=8, sorted_rows=20)
    want = df.filter("v IS NOT NULL").groupBy("g").agg(F.percentile("v", F.array(*[F.lit(q) for q in SHARES])).alias("q"))
    want = {r["g"]: r["q"] for r in want.collect()}
    rows = {r["g"]: list(r)[1:] for r in got.collect()}
    assert rows.keys() == want.keys()
    for g in rows:
        assert rows[g] == pytest.approx(want[g], rel=1e-12, abs=1e-300)


def test_percentiles_of_all_rows_and_of_none(spark):
    df = spark.createDataFrame(values_of("distinct"), "g string, v double")
    want = df.agg(F.percentile("v", F.lit(0.95)), F.percentile("v", F.lit(0.99))).first()
    assert tuple(quantiles.exact_percentiles(df, F.col("v"), buckets=16, sorted_rows=10).first()) == pytest.approx(tuple(want))
    assert quantiles.exact_percentiles(df.limit(0), F.col("v"), ["g"]).collect() == []
    odd = spark.createDataFrame([("x", v) for v in (float("nan"), None, 1.0, 3.0)], "g string, v double")
    assert tuple(quantiles.exact_percentiles(odd, F.col("v"), ["g"], (0.5,)).first()) == ("x", 2.0)


def test_extreme_values(spark):
    """The width of the whole range is beyond a double; the rows come out all the same."""
    df = spark.createDataFrame([(float(v),) for v in (-1e308, -1.0, 0.0, 1.0, 2.0, 1e308)] * 30, "v double")
    got = quantiles.exact_percentiles(df, F.col("v"), (), (0.5, 0.6), buckets=8, sorted_rows=5).first()
    assert tuple(got) == pytest.approx(tuple(df.agg(F.percentile("v", F.lit(0.5)), F.percentile("v", F.lit(0.6))).first()))


def test_each_pass_leaves_a_part_of_the_rows(spark):
    """Work per pass is a count by range: what is left after two passes is a small share."""
    values = spark.range(100_000).select(F.lit("{}").alias("__group"), F.col("id").cast("double").alias("v"))
    ranges = spark.createDataFrame([("{}", 0, 95_000, 0, 100_000, 0.0, 99_999.0)], "__group string, target int, rank long, below long, n long, lo double, hi double")
    for _ in range(2):
        ranges = quantiles._narrowed(values, ranges, ["__group"], 64)
    row = ranges.first()
    assert row["n"] < 50 and row["below"] <= 95_000 < row["below"] + row["n"] and row["lo"] <= 95_000 <= row["hi"]


def test_golden_signals_either_way(spark):
    events = spark.range(3000).select(F.timestamp_seconds("id").alias("ts"), (F.col("id") * 1.37).alias("ms"), (F.col("id") % 3).alias("c"))
    lags, dead = spark.createDataFrame([(5,)], "lag_bytes long"), spark.range(4)
    one, many = (signals.golden_signals(events, "ts", F.col("ms"), lags, dead, F.col("c"), one_buffer=n) for n in (10**6, 0))
    assert one.columns == many.columns and tuple(many.first()) == pytest.approx(tuple(one.first()))


def test_rank_error_of_merged_sketches(spark):
    df = spark.range(60_000).select((F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1000).alias("v"), (F.col("id") % 50).alias("w"))
    parts = df.groupBy("w").agg(quantiles.sketch(F.col("v")).alias("s"))
    assert parts.agg(F.max(F.length("s"))).first()[0] < 200_000
    found = quantiles.sketch_percentiles(parts.agg(quantiles.merged(F.col("s")).alias("s")), "s", (0.5, 0.95, 0.99)).first()
    assert found["n"] == 60_000
    for q in (50, 95, 99):
        assert abs(df.filter(F.col("v") <= found[f"p{q}"]).count() / 60_000 - q / 100) < 0.002
