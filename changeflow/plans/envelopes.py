"""From raw changes of six engines over full envelopes to table state, and the whole way over a topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import expand, materialize
from ..operators.deadletter import good, parse_messages
from ..session import work_path
from ..sources import engines, sinks
from ..sources.engines import Source
from ..sources.fixtures import PK_SHIFT, change_log, table, transactions
from .registry import flat, query
from .state import messages

# The engine of an order is its key modulo seven, the last two are of the first engine.
ENGINE_OF = ("postgres", "mysql", "mariadb", "oracle", "sqlserver", "mongodb", "postgres")


def commits(spark, sf) -> DataFrame:
    """Two changes per order, ten orders to a transaction, all of it at one position: a create, and by the
    key modulo four an update, a delete, a key update or nothing."""
    k = F.col("o_orderkey")
    image = lambda key, status: F.struct(key.cast("string").alias("id"), F.col("o_custkey").cast("string").alias("customer_id"), status.alias("status"))
    new = image(k, F.lit("NEW"))
    none = F.lit(None).cast("struct<id:string,customer_id:string,status:string>")
    change = lambda place, op, before, after: F.struct(
        (k % 10 * 4 + place).cast("int").alias("row_ord"), F.lit(op).alias("op"), before.alias("before"), after.alias("after"))
    moved = image(k + PK_SHIFT, F.lit("MOVED"))
    second = F.when(k % 4 == 0, F.array(change(1, "u", new, image(k, F.col("o_orderstatus"))))).when(
        k % 4 == 1, F.array(change(1, "d", new, none)))
    # SQL Server writes a key update as a delete and a create; a document keeps its key.
    engine = F.element_at(F.array(*[F.lit(e) for e in ENGINE_OF]), (k % 7 + 1).cast("int"))
    second = second.when((k % 4 == 2) & (engine == "sqlserver"), F.array(change(1, "d", new, none), change(2, "c", none, moved)))
    second = second.when((k % 4 == 2) & (engine == "mongodb"), F.array(change(1, "u", new, image(k, F.lit("MOVED")))))
    second = second.when(k % 4 == 2, F.array(change(1, "u", new, moved))).otherwise(F.array().cast(
        "array<struct<row_ord:int,op:string,before:struct<id:string,customer_id:string,status:string>,after:struct<id:string,customer_id:string,status:string>>>"))
    return table(spark, sf, "orders").select(
        engine.alias("engine"), F.floor(k / 10).alias("t"), F.col("o_orderdate").cast("timestamp").alias("source_ts"),
        F.explode(F.concat(F.array(change(0, "c", none, new)), second)).alias("c")).select("engine", "t", "source_ts", "c.*")


def raw_commits(spark, sf) -> dict[str, tuple[DataFrame, Source]]:
    """``commits`` as each engine delivers them; only PostgreSQL tells the transaction."""
    rows = commits(spark, sf)
    of = lambda engine: rows.filter(F.col("engine") == engine)
    t, name = F.col("t"), F.lit("orders").alias("table")
    rest = ["row_ord", "source_ts"]
    ordinal = t * 1_000_003
    word = F.when(F.col("op") == "c", "INSERT").when(F.col("op") == "u", "UPDATE").otherwise("DELETE")
    code = lambda c, side: F.struct(F.lit(c).alias("operation"), F.col(side).alias("columns"))
    codes = F.when(F.col("op") == "c", F.array(code(2, "after"))).when(F.col("op") == "d", F.array(code(1, "before"))).otherwise(
        F.array(code(3, "before"), code(4, "after")))
    return {
        "postgres": (of("postgres").select(
            name, F.col("before").alias("old_tuple"), F.col("after").alias("new_tuple"),
            F.concat(F.hex(F.floor(ordinal / 2**32)), F.lit("/"), F.hex(ordinal % 2**32)).alias("lsn"), t.alias("tx_id"), *rest),
            Source("shop", ["id"], "public")),
        "mysql": (of("mysql").select(
            name, word.alias("op"), F.concat(F.lit("3e11fa47-71ca-11e1-9e33-c80aa9429562:"), t).alias("gtid"), "before", "after", *rest),
            Source("shop", ["id"])),
        "mariadb": (of("mariadb").select(
            name, "op", F.concat(F.lit("0-184055-"), t).alias("gtid"), F.to_json("before").alias("before"), F.to_json("after").alias("after"), *rest),
            Source("shop", ["id"])),
        "oracle": (of("oracle").select(
            F.lit("SALES").alias("owner"), name, word.alias("operation"), (t + 18934812).cast("string").alias("scn"), "before", "after", *rest),
            Source("ORCLPDB", ["id"], "SALES")),
        "sqlserver": (of("sqlserver").select(
            name, F.concat_ws(":", F.lpad(F.hex(t), 8, "0"), F.lit("00000198"), F.lit("0001")).alias("start_lsn"),
            F.hex("row_ord").alias("seqval"), *rest, F.explode(codes).alias("c")).select("table", "start_lsn", "seqval", *rest, "c.*"),
            Source("shop", ["id"], "dbo")),
        "mongodb": (of("mongodb").select(
            F.lit("orders").alias("collection"), F.lower(F.regexp_replace(word, "UPDATE", "REPLACE")).alias("operation_type"),
            F.concat(F.lit("8263A29B"), F.lpad(F.hex(t), 8, "0"), F.lpad(F.hex("row_ord"), 4, "0"), F.lit("0229296E04")).alias("token"),
            F.struct(F.coalesce("after.id", "before.id").alias("id")).alias("document_key"), F.col("after").alias("full_document"), *rest),
            Source("shop", ["id"])),
    }


COMMITS = """
WITH e AS (
  SELECT o_orderkey AS k, o_orderstatus, ['postgres', 'mysql', 'mariadb', 'oracle', 'sqlserver', 'mongodb', 'postgres'][o_orderkey % 7 + 1] AS engine
  FROM orders)
"""


@query("envelope_state", COMMITS + """
SELECT engine, '{"id":"' || CASE WHEN k % 4 = 2 AND engine <> 'mongodb' THEN k + 100000000 ELSE k END || '"}' AS key,
       CASE k % 4 WHEN 0 THEN o_orderstatus WHEN 2 THEN 'MOVED' ELSE 'NEW' END AS status
FROM e WHERE k % 4 <> 1""", shared=False)
def envelope_state(spark, sf):
    """Raw changes of six engines, many rows at each position, to current rows."""
    log = engines.from_envelope(engines.normalize_all(raw_commits(spark, sf)))
    state = materialize.materialize(log)
    return state.select(F.split("tbl", "[.]")[0].alias("engine"), F.col("key_id").alias("key"), F.col("after")["status"].alias("status"))


@query("envelope_dedupe", COMMITS + """
SELECT engine, CAST(SUM(CASE WHEN k % 4 = 3 THEN 1 WHEN k % 4 = 2 AND engine = 'sqlserver' THEN 3 ELSE 2 END) AS BIGINT) AS events
FROM e GROUP BY engine""", shared=False)
def envelope_dedupe(spark, sf):
    """Every event delivered twice counts once, and no two rows of a transaction count as one."""
    raws = {e: (raw.unionByName(raw), source) for e, (raw, source) in raw_commits(spark, sf).items()}
    once = materialize.dedupe_events(engines.normalize_all(raws))
    return once.groupBy(F.col("source.type").alias("engine")).agg(F.count(F.lit(1)).alias("events"))


@query("composite_key_state", """
SELECT '{"l_linenumber":"' || l_linenumber || '","l_orderkey":"' || l_orderkey || '"}' AS key,
       CASE WHEN l_linenumber % 2 = 0 THEN 'SHIPPED' ELSE l_linestatus END AS status
FROM (SELECT l_orderkey, l_linenumber, MIN(l_linestatus) AS l_linestatus FROM lineitem GROUP BY l_orderkey, l_linenumber)
WHERE l_linenumber % 5 <> 0""", shared=False)
def composite_key_state(spark, sf):
    """A key of two columns: created, every second line updated, every fifth deleted, all at one position an order."""
    n = F.col("l_linenumber")
    image = lambda status: F.struct("l_orderkey", "l_linenumber", status.alias("status"))
    made = image(F.col("l_linestatus"))
    none = F.when(F.lit(False), made)
    change = lambda place, op, before, after: F.struct(
        (n * 2 + place).cast("int").alias("row_ord"), F.lit(op).alias("op"), before.alias("before"), after.alias("after"))
    second = F.when(n % 5 == 0, change(1, "d", made, none)).when(n % 2 == 0, change(1, "u", made, image(F.lit("SHIPPED"))))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_linestatus").alias("l_linestatus"))
    raw = lines.select(
        F.lit("lines").alias("table"), F.concat(F.lit("24da01e2-b892-11e7-8b0f-0242ac110002:"), "l_orderkey").alias("gtid"),
        F.explode(F.array_compact(F.array(change(0, "c", none, made), second))).alias("c")).select("table", "gtid", "c.*")
    log = engines.from_envelope(engines.normalize("mysql", raw, Source("shop", ["l_orderkey", "l_linenumber"])))
    return materialize.materialize(log).select(F.col("key_id").alias("key"), F.col("after")["status"].alias("status"))


@query("pipeline_state", """
SELECT tbl, key_id, a_customer_id AS customer_id, a_status AS status, a_amount_cents AS amount_cents, pos FROM state""")
def pipeline_state(spark, sf):
    """Commit filter, key split, tombstones, offsets, wire format, topic, parser and quarantine, then state."""
    path = work_path(spark, "wire_topics")
    sent = sinks.keyed_messages(expand.assign_offsets(messages(spark, sf)), schema_id=F.lit(42))
    sinks.write_topic(sent.select("topic", "partition", "offset", "key", "value", "headers"), path)
    image = "struct<customer_id:bigint,status:string,amount_cents:bigint>"
    parsed = good(parse_messages(spark.read.parquet(path), f"op string, before {image}, after {image}", known_ids=[42]))
    rows = parsed.select(
        F.col("headers")["table"].alias("tbl"), F.get_json_object("key", "$.id").cast("long").alias("key_id"),
        F.coalesce("doc.op", F.lit("d")).alias("op"), F.col("doc.after").alias("after"),
        F.col("headers")["pos"].cast("long").alias("pos"), F.col("headers")["sub"].cast("int").alias("sub_order"),
        F.lit(None).cast("timestamp").alias("source_ts"))
    cleared = materialize.truncates(rows)
    last = materialize.latest_per_key(materialize.truncate_barrier(rows, cleared), keep=["op", "after", "pos", "sub_order"])
    return last.filter("op <> 'd'").select("tbl", "key_id", *flat("", "after"), "pos")


@query("assign_offsets_split", """
, routed AS (SELECT *, CASE WHEN key_id IS NULL OR key_id % 3 = 0 THEN NULL ELSE partition END AS part FROM topics)
SELECT topic, part AS partition, ROW_NUMBER() OVER (PARTITION BY topic, part ORDER BY pos, sub_order) - 1 AS "offset", pos, sub_order FROM routed""")
def assign_offsets_split(spark, sf):
    """Partitions large enough to be cut into segments, one of them NULL."""
    rows = messages(spark, sf).withColumn("partition", F.when(F.col("key_id") % 3 != 0, F.col("partition")))
    return expand.assign_offsets(rows, hot_rows=100, segment_rows=50).select("topic", "partition", "offset", "pos", "sub_order")


@query("committed_reads", """
SELECT tbl, op, key_id, pos FROM committed UNION ALL SELECT 'orders', 'r', o_orderkey, 0 FROM orders""")
def committed_reads(spark, sf):
    """Reads of a snapshot belong to no transaction and pass the commit filter."""
    from ..operators.commit import committed_only
    log = change_log(spark, sf)
    outcomes = transactions(log)
    reads = table(spark, sf, "orders").select(
        F.lit("orders").alias("tbl"), F.lit("r").alias("op"), F.col("o_orderkey").alias("key_id"), F.lit(0).cast("long").alias("pos"),
        F.lit(None).cast("long").alias("tx_id"))
    events = log.select("tbl", "op", "key_id", "pos", "tx_id").unionByName(reads)
    return committed_only(events, outcomes).drop("tx_id")
