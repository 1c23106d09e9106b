"""Several servers: sets of positions, the order of a cluster, and raw changes that lack a place."""

import random

import pytest
from pyspark.sql import functions as F

from changeflow.functions.positions import parse_seqval
from changeflow.operators import failover, materialize, position_sets, skew
from changeflow.sources import engines
from changeflow.sources.engines import Source

SPLITS = [{}, {"hot_rows": 5, "segment_rows": 4}]


def members(df):
    out = set()
    for r in df.collect():
        new = {(r["server"], i) for i in range(r["low"], r["high"] + 1)}
        assert new and not new & out
        out |= new
    return out


@pytest.mark.parametrize("split", SPLITS)
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_set_arithmetic(spark, seed, split):
    """Overlapping, touching, nested, equal and empty intervals of several servers against plain sets."""
    rng = random.Random(seed)
    some = lambda: [(rng.choice("ab"), low := rng.randrange(120), low + rng.choice((-1, 0, 0, 1, 5, 30))) for _ in range(25)] + [(None, 1, 2), ("c", None, 5)]
    left, right = some(), some()
    plain = [{(s, i) for s, low, high in rows if s and low is not None for i in range(low, high + 1)} for rows in (left, right)]
    a, b = (spark.createDataFrame(rows, "server string, low long, high long") for rows in (left, right))
    assert members(position_sets.normalized(a, **split)) == plain[0]
    assert members(position_sets.union(a, b, **split)) == plain[0] | plain[1]
    assert members(position_sets.difference(a, b, **split)) == plain[0] - plain[1]
    assert members(position_sets.intersection(a, b, **split)) == plain[0] & plain[1]
    found = position_sets.missing_from(a, b).first()
    assert (found["positions"], found["missing"], found["contained"]) == (len(plain[0]), len(plain[0] - plain[1]), not plain[0] - plain[1])
    single = spark.createDataFrame(sorted(plain[0]) * 2, "server string, seq long")
    assert members(position_sets.positions_to_set(single, **split)) == plain[0]
    lows = sorted(position_sets.positions_to_set(single).collect())
    assert lows == sorted(position_sets.normalized(a).collect())


@pytest.mark.parametrize("limit", [1000, 0])
def test_not_executed(spark, limit):
    held = spark.createDataFrame([("a", 1, 5), ("a", 6, 9), ("a", 20, 20), ("b", 3, 4)], "server string, low long, high long")
    events = spark.createDataFrame([(s, i) for s in ("a", "b", "c", None) for i in (*range(1, 23), None)], "server string, seq long")
    got = {tuple(r) for r in position_sets.not_executed(events, held, limit=limit).collect()}
    executed = {("a", i) for i in (*range(1, 10), 20)} | {("b", 3), ("b", 4)}
    assert got == {tuple(r) for r in events.collect()} - executed


def test_sets_as_text(spark):
    texts = [("B:1-3:5, a:7:8-9",), ("",), ("x",), ("a:3-1:z",), (None,)]
    rows = spark.createDataFrame(texts, "t string").select("t", position_sets.parse_position_set(F.col("t")).alias("s")).collect()
    assert [[tuple(i) for i in r["s"]] if r["s"] is not None else None for r in rows] == [
        [("b", 1, 3), ("b", 5, 5), ("a", 7, 7), ("a", 8, 9)], [], [], [], None]
    back = spark.createDataFrame([tuple(i) for i in rows[0]["s"]], "server string, low long, high long")
    assert position_sets.set_text(position_sets.normalized(back)).first()["positions"] == "a:7-9,b:1-3:5"
    domains = spark.range(1).select(position_sets.parse_domain_positions(F.lit("0-1-100, 2-7-3,bad")).alias("s")).first()["s"]
    assert [tuple(i) for i in domains] == [("0", 1, 100), ("2", 1, 3)]


@pytest.mark.parametrize("split", SPLITS)
@pytest.mark.parametrize("limit", [1000, 0])
def test_epochs(spark, limit, split):
    """A, B, A again; a late row of A joins the part it belongs to, a repeated one stays where it was."""
    rows = [("A", 900, 1), ("A", 901, 2), ("B", 5, 3), ("A", 900, 4), ("B", 6, 5), ("A", 899, 6), ("A", 950, 7), ("B", 6, 8), ("A", 951, 9), ("C", 1, 10)]
    log = spark.createDataFrame([("x", *r) for r in rows], "source string, server string, seq long, arrival long")
    starts = failover.epochs(log, ["source"], **split)
    assert sorted((r["epoch"], r["server"], r["from_seq"]) for r in starts.collect()) == [(1, "A", 900), (2, "B", 5), (3, "A", 950), (4, "C", 1)]
    got = {(r["server"], r["seq"]): r["epoch"] for r in failover.with_epoch(log, starts, ["source"], limit=limit, **split).collect()}
    assert got == {("A", 900): 1, ("A", 901): 1, ("A", 899): 1, ("B", 5): 2, ("B", 6): 2, ("A", 950): 3, ("A", 951): 3, ("C", 1): 4}


def raw_log(spark, rows):
    """Rows (op, gtid, id, value, arrival)."""
    return spark.createDataFrame([("t", op, g, {"id": i, "v": v}, a) for op, g, i, v, a in rows],
                                 "table string, op string, gtid string, after map<string,string>, offset long")


@pytest.mark.parametrize("engine,gtids", [("mysql", ("A:900", "B:5", "A:901")), ("mariadb", ("0-1-900", "1-2-5", "0-1-901"))])
def test_state_after_a_failover(spark, engine, gtids):
    raw = raw_log(spark, [("INSERT", gtids[0], "1", "old", 1), ("UPDATE", gtids[1], "1", "new", 2), ("INSERT", gtids[0], "1", "old", 3)])
    state = materialize.materialize(engines.from_envelope(engines.normalize(engine, raw, Source("db", ["id"]))))
    assert [r["after"]["v"] for r in state.collect()] == ["new"]
    back = raw.unionByName(raw_log(spark, [("UPDATE", gtids[2], "1", "newest", 9)]))
    state = materialize.materialize(engines.from_envelope(engines.normalize(engine, back, Source("db", ["id"]))))
    assert [r["after"]["v"] for r in state.collect()] == ["newest"]


def test_one_domain_orders_by_number_over_its_servers(spark):
    raw = raw_log(spark, [("INSERT", "0-1-7", "1", "a", 2), ("UPDATE", "0-2-8", "1", "b", 1)])
    state = materialize.materialize(engines.from_envelope(engines.normalize("mariadb", raw, Source("db", ["id"]))))
    assert [r["after"]["v"] for r in state.collect()] == ["b"]


def test_later_batches_join_up(spark):
    """Epochs are kept: the positions of a first batch, from one server alone, compare with those of the second."""
    rows = [("INSERT", "A:900", "1", "old", 1), ("UPDATE", "B:5", "1", "new", 2)]
    envelope = lambda r: engines.normalize("mysql", raw_log(spark, r), Source("db", ["id"]))
    first = engines.from_envelope(envelope(rows[:1]))
    second = engines.from_envelope(envelope(rows[1:]), starts=engines.position_epochs(envelope(rows)))
    assert [r["after"]["v"] for r in materialize.materialize(first.unionByName(second)).collect()] == ["new"]


def test_unknown_order_is_refused(spark):
    raw = raw_log(spark, [("INSERT", "A:900", "1", "old", None), ("UPDATE", "B:5", "1", "new", None)])
    with pytest.raises(ValueError, match="order is unknown"):
        engines.from_envelope(engines.normalize("mysql", raw, Source("db", ["id"])))
    log = spark.createDataFrame([("x", "A", 1, None), ("x", "B", 1, 4)], "source string, server string, seq long, arrival long")
    with pytest.raises(ValueError, match="order is unknown"):
        failover.failover_order(log, ["source"])


def test_two_updates_of_a_key_under_one_gtid(spark):
    """Without a place in the transaction: both stay, the topic offset orders them, copies still count once."""
    raw = raw_log(spark, [("UPDATE", "a:7", "1", "x", 5), ("UPDATE", "a:7", "1", "y", 6)])
    envelope = engines.normalize("mysql", raw, Source("db", ["id"]))
    assert materialize.dedupe_events(envelope.unionByName(envelope)).count() == 2
    assert materialize.idempotent_apply(envelope, envelope.limit(0)).count() == 2
    for log in (envelope, envelope.orderBy(F.col("offset").desc())):
        assert [r["after"]["v"] for r in materialize.materialize(engines.from_envelope(log), strict=True).collect()] == ["y"]


def test_tied_changes_are_refused_on_request(spark):
    raw = raw_log(spark, [("UPDATE", "a:7", "1", "x", None), ("UPDATE", "a:7", "1", "y", None), ("UPDATE", "a:7", "2", "z", None)])
    log = engines.from_envelope(engines.normalize("mysql", raw, Source("db", ["id"])))
    assert materialize.materialize(log).count() == 2
    with pytest.raises(Exception, match="several last changes"):
        materialize.materialize(log, strict=True).collect()
    apart = log.filter("after['v'] <> 'y'")
    assert materialize.materialize(apart.unionByName(apart), strict=True).count() == 2


def test_sql_server_sequences_of_ten_bytes(spark):
    values = ["0000002800000198000A", "80000000", "0x01", "1F", "", "xyz", "0" * 21]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "s string").select(parse_seqval(F.col("s"))).collect()]
    assert [None if v is None else int(v) for v in got] == [int("0000002800000198000A", 16), 0x80000000, 1, 0x1F, None, None, None]


@pytest.mark.parametrize("images", ["struct<id:int,v:string>", "map<string,string>"])
def test_sql_server_images(spark, images):
    image = lambda i, v: {"id": str(i), "v": v} if images.startswith("map") else (i, v)
    seq = "0000002800000198000{}"
    rows = [(2, "00000028:00000198:0001", seq.format("A"), "t", image(1, "a")), (3, "00000028:00000198:0001", seq.format("B"), "t", image(1, "a")),
            (4, "00000028:00000198:0001", seq.format("B"), "t", image(1, "b")), (1, "00000028:00000198:0001", seq.format("C"), "t", image(2, "c"))]
    raw = spark.createDataFrame(rows, f"operation int, start_lsn string, seqval string, table string, columns {images}")
    envelope = engines.normalize("sqlserver", raw, Source("db", ["id"]))
    assert sorted(r["op"] for r in envelope.collect()) == ["c", "d", "u"]
    assert materialize.dedupe_events(envelope.unionByName(envelope)).count() == 3
    assert [r["after"]["v"] for r in materialize.materialize(engines.from_envelope(envelope)).collect()] == ["b"]


@pytest.mark.parametrize("before", [True, False])
def test_running_values_over_segments(spark, before):
    n = F.col("id")
    df = spark.range(900).select((n % 2).alias("g"), (n % 5).alias("o"), n.alias("id"), F.when(n % 3 == 0, n).alias("v"))
    rows = [sorted(map(str, skew.running(df, ["g"], ["o", "id"], {"s": (F.sum, "v"), "m": (F.max, "v"), "l": (F.min, "v")}, before=before, **s).collect()))
            for s in ({}, {"hot_rows": 20, "segment_rows": 30})]
    assert rows[0] == rows[1] and len(rows[0]) == 900


def test_a_part_is_split_once_and_not_for_each_interval(spark):
    """The work on a text of many intervals grows with its length, not with the square of it."""
    import re
    text = "A:" + ":".join(f"{i}-{i + 1}" for i in range(0, 60_000, 4)) + ", b:7:x:9-3:5-5"
    rows = spark.createDataFrame([(text,)], "text string").select(F.explode(position_sets.parse_position_set(F.col("text"))).alias("i")).select("i.*")
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"split\(trim\(", plan)) == 1
    got = [tuple(r) for r in rows.collect()]
    assert got == [("a", i, i + 1) for i in range(0, 60_000, 4)] + [("b", 7, 7), ("b", 5, 5)]
