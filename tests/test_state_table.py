"""Levelled state files: merges by bucket without a shuffle, untouched files, and batches that become visible as a whole."""

import random

import pytest
from pyspark.sql import functions as F

from changeflow.operators import commit, materialize
from changeflow.session import work_path
from changeflow.sources.state_table import StateTable

LOG = "tbl string, op string, key_id long, old_key_id long, before struct<v:string>, after struct<v:string>, pos long, sub_order int, source_ts timestamp"


def events(rng, batch, n=60):
    """Changes of a few keys of two tables; some of an older position than what came before, some truncates."""
    out = []
    for i in range(n):
        op = rng.choice("cuuudt" if i % 20 == 7 else "cuuudp")
        pos, key = batch * 100 + i - (150 if rng.random() < 0.1 else 0), rng.randrange(40)
        image = None if op in "dt" else {"v": f"{batch}-{i}"}
        out.append((rng.choice("ab"), {"p": "pk"}.get(op, op), None if op == "t" else key, rng.randrange(40) if op == "p" else None,
                    {"v": "seen"} if op in "udp" else None, image, pos, i, None))
    return out


def state(df):
    return sorted((r["tbl"], r["key_id"], r["after"]["v"], r["pos"]) for r in df.collect()) if df is not None else None


@pytest.mark.parametrize("seed,fan_in", [(1, 2), (2, 3), (3, 10)])
def test_state_after_every_batch(spark, seed, fan_in):
    rng = random.Random(seed)
    table, seen = StateTable(spark, work_path(spark, "st"), buckets=4, fan_in=fan_in), []
    assert table.read() is None
    for batch in range(5):
        new = events(rng, batch) if batch != 2 else []
        seen += new
        table.apply(spark.createDataFrame(new, LOG), batch)
        if batch in (1, 4):
            assert state(table.read()) == state(materialize.materialize(spark.createDataFrame(seen, LOG)))
    levels = [r.level for r in table.manifest().runs]
    assert all(levels.count(level) < fan_in for level in levels)


def test_reads_have_no_shuffle_and_merges_leave_other_files(spark):
    rng = random.Random(5)
    table = StateTable(spark, work_path(spark, "st"), buckets=8, fan_in=3)
    table.apply(spark.createDataFrame(events(rng, 0), LOG), 0)
    table.apply(spark.createDataFrame(events(rng, 1), LOG), 1)
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "Bucketed: true" in plan
    one = spark.createDataFrame([("a", "u", 5, None, None, {"v": "x"}, 900, 0, None)], LOG)
    first = table.manifest().runs
    table.apply(one, 2)
    big = [r for r in table.manifest().runs if r.level == 1]
    assert len(big) == 1 and not [r for r in table.manifest().runs if r.level == 0]
    for batch in (3, 4):
        table.apply(one.withColumn("pos", F.lit(1000 + batch)), batch)
    runs = table.manifest().runs
    assert runs[0] == big[0] and [r.buckets for r in runs[1:]] == [1, 1] and len(first) == 2


def test_a_batch_that_stops_half_way_is_not_seen(spark):
    """The second of two sinks fails: state and both sinks stay as they were, and the repeated batch counts once."""
    rng = random.Random(7)
    table = StateTable(spark, work_path(spark, "st"), buckets=4)
    batches = [spark.createDataFrame(events(rng, i), LOG) for i in range(2)]
    feed = lambda df: {"feed": df.select("tbl", "pos"), "audit": df.groupBy("tbl").agg(F.count(F.lit(1)).alias("n"))}
    table.apply(batches[0], 0, feed(batches[0]))
    before = state(table.read()), table.read_sink("feed").count(), table.read_sink("audit").count()
    broken = {**feed(batches[1]), "audit": batches[1].select(F.raise_error(F.lit("stopped")).cast("int").alias("n"))}
    with pytest.raises(Exception, match="stopped"):
        table.apply(batches[1], 1, broken)
    assert (state(table.read()), table.read_sink("feed").count(), table.read_sink("audit").count()) == before
    for _ in range(2):
        table.apply(batches[1], 1, feed(batches[1]))
        assert table.read_sink("feed").count() == 120
        assert state(table.read()) == state(materialize.materialize(batches[0].unionByName(batches[1])))
    assert table.read_sink("nothing") is None and not [t for t in spark.catalog.listTables() if t.name.startswith("state_run")]


def test_many_transactions_do_not_shuffle_the_log(spark, tmp_path):
    """More transactions than are broadcast: those that did not commit are looked for by id, and the log is read once."""
    path = str(tmp_path / "log")
    spark.range(3000).select((F.col("id") % 1500).alias("tx_id"), F.lit("t").alias("tbl"), F.col("id").alias("pos")).unionByName(
        spark.range(5).select(F.lit(None).cast("long").alias("tx_id"), F.lit("t").alias("tbl"), (F.col("id") + 9000).alias("pos"))).write.parquet(path)
    log = spark.read.parquet(path)
    tx = spark.range(1400).select(F.col("id").alias("tx_id"), F.when(F.col("id") % 10 == 0, "ABORTED").otherwise("COMMITTED").alias("status"))
    got = commit.committed_only(log, tx, limit=100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "hashpartitioning" not in plan
    want = {r["pos"] for r in log.collect() if r["tx_id"] is None or (r["tx_id"] < 1400 and r["tx_id"] % 10)}
    for kept in (got, commit.committed_only(log, tx), commit.committed_only(log, tx, limit=100, unfinished=5)):
        assert {r["pos"] for r in kept.collect()} == want
