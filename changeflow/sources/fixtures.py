"""Change data derived from the given tables with one scan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PK_SHIFT = 100_000_000
ABORT_SHIFT = 200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The steps that apply to an orders row. Kinds 1-5 are the steps of `orders`; 6 and 7 are steps 1
# and 7 of `staging_orders`.
_KINDS = """explode(array(1, IF(id % 2 = 0, 2, NULL), IF(id % 29 = 0, 3, NULL), IF(id % 17 = 0 AND id % 29 <> 0, 4, NULL),
    IF(id % 13 = 0, 5, NULL), IF(id % 19 = 0, 6, NULL), IF(id % 190 = 0, 7, NULL))) AS kind"""
_FIRST = "named_struct('customer_id', customer_id, 'status', status, 'amount_cents', amount_cents)"
_LATEST = """named_struct('customer_id', customer_id, 'status', IF(id % 2 = 0, 'SHIPPED', status),
    'amount_cents', IF(id % 2 = 0, amount_cents + 500, amount_cents))"""
_SPECIAL = "named_struct('customer_id', customer_id, 'status', {0}, 'amount_cents', {1})"


def _stamp(events: DataFrame) -> DataFrame:
    """Position, transaction and times of an event from its step and key."""
    return events.selectExpr(
        "step", "tbl", "op", "key_id", "old_key_id", "before", "after",
        f"CAST(step AS BIGINT) * 1000000000 + COALESCE(key_id % {PK_SHIFT}, 0) AS pos",
        f"CAST(step AS BIGINT) * 1000000 + FLOOR(COALESCE(key_id % {PK_SHIFT}, 0) / 10) AS tx_id",
        "ts0 + INTERVAL '1' DAY * (step - 1) AS source_ts",
        "ts0 + INTERVAL '1' DAY * (step - 1) + INTERVAL '0.001' SECOND * (COALESCE(key_id, 0) * 37 % 5000) AS capture_ts")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts, updates, key updates, deletes, rolled-back inserts, a truncate and a reload.

    Each ``orders`` row yields up to seven events in one pass over the file: the steps that apply
    to it are exploded as small numbers, and the event is built from the row and the step.
    """
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS customer_id", "o_orderstatus AS status",
        "CAST(ROUND(o_totalprice * 100) AS BIGINT) AS amount_cents", "o_orderdate AS ts0")
    events = orders.selectExpr("*", _KINDS).filter("kind IS NOT NULL").selectExpr(
        "IF(kind = 6, 1, kind) AS step",
        "IF(kind <= 5, 'orders', 'staging_orders') AS tbl",
        "CASE kind WHEN 2 THEN 'u' WHEN 3 THEN 'pk' WHEN 4 THEN 'd' ELSE 'c' END AS op",
        f"CASE kind WHEN 3 THEN id + {PK_SHIFT} WHEN 5 THEN id + {ABORT_SHIFT} ELSE id END AS key_id",
        "IF(kind = 3, id, NULL) AS old_key_id",
        f"CASE WHEN kind = 2 THEN {_FIRST} WHEN kind IN (3, 4) THEN {_LATEST} END AS before",
        f"CASE WHEN kind = 1 THEN {_FIRST} WHEN kind IN (2, 3) THEN {_LATEST} "
        f"WHEN kind = 5 THEN {_SPECIAL.format(repr('ABORTED'), '9999L')} "
        f"WHEN kind = 6 THEN {_SPECIAL.format(repr('temp'), 'amount_cents')} "
        f"WHEN kind = 7 THEN {_SPECIAL.format(repr('reload'), 'amount_cents')} END AS after",
        "ts0")
    image = events.schema["after"].dataType.simpleString()
    truncate = orders.selectExpr("MAX(ts0) AS ts0", "MAX(6) AS step").selectExpr(
        "step", "'staging_orders' AS tbl", "'t' AS op", "CAST(NULL AS BIGINT) AS key_id", "CAST(NULL AS BIGINT) AS old_key_id",
        f"CAST(NULL AS {image}) AS before", f"CAST(NULL AS {image}) AS after", "ts0")
    return _stamp(events.unionByName(truncate))


def transactions(log: DataFrame) -> DataFrame:
    """Outcome of every transaction: ``tx_id``, ``status``."""
    return log.select(
        "tx_id", F.when(F.col("step") == 5, "ABORTED").otherwise("COMMITTED").alias("status")).distinct()


def ddl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One DDL event per part, on a table of its own; the kind rotates with the part key."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    kind = F.col("k") % 3
    return part.select(
        F.concat(F.lit("part_"), F.col("k")).alias("tbl"),
        F.when(kind == 0, "DDL_ADD_COL").when(kind == 1, "DDL_ALTER_TYPE").otherwise("DDL_DROP_COL").alias("op"),
        F.col("k").alias("key_id"),
        (F.lit(8_000_000_000) + F.col("k")).alias("pos"),
        (F.lit(8_000_000) + F.floor(F.col("k") / 10)).alias("tx_id"),
    )


def customer_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data with JSON before and after images."""
    k = F.col("c_custkey")
    four = F.lpad((k % 10000).cast("string"), 4, "0")
    base = table(spark, sf_dir, "customer").select(
        k.alias("key_id"), F.col("c_mktsegment").alias("segment"),
        F.when(k % 23 == 0, "").otherwise(F.concat(F.lit("user"), k, F.lit("@mail.example.com"))).alias("email"),
        F.when(k % 2 == 0, (F.lit(4111222200000000) + k * 7919).cast("string"))
        .otherwise(F.concat(F.lit("4111-2222-3333-"), four)).alias("credit_card"),
        F.when(k % 11 == 0, "12").otherwise(F.concat(F.lit("900-55-"), four)).alias("tax_id"))
    key, email, card, tax, seg = (F.col(c) for c in ("key_id", "email", "credit_card", "tax_id", "segment"))

    def head(mail: Column, segment: Column) -> list[Column]:
        return [F.lit('{"id":'), key, F.lit(',"email":"'), mail, F.lit('","credit_card":"'), card,
                F.lit('","tax_id":"'), tax, F.lit('","segment":"'), segment, F.lit('"')]

    new_mail = F.when(key % 5 == 0, F.concat(F.lit("new."), email)).otherwise(email)
    new_segment = F.when(key % 3 == 0, "VIP").otherwise(seg)
    tier = F.when(key % 7 == 0, ',"loyalty_tier":"BRONZE"').otherwise("")
    return base.select(
        "key_id", "email", "credit_card", "tax_id", "segment",
        F.concat(*head(email, seg), F.lit(',"note":null}')).alias("before_json"),
        F.concat(*head(new_mail, new_segment), tier, F.lit("}")).alias("after_json"))


def image_maps(images: DataFrame) -> DataFrame:
    """``customer_images`` in bus form: map columns ``before`` and ``after``."""
    return images.select(
        "key_id", *[F.from_json(f"{c}_json", "map<string,string>").alias(c) for c in ("before", "after")])


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header-prefixed messages, some with a bad header, too short, or with broken JSON."""
    k = F.col("o_orderkey")
    schema_id = (F.lit(42) + k % 3).cast("long")
    payload = F.concat(F.lit('{"id":'), k, F.lit(',"status":"'), F.col("o_orderstatus"), F.lit('"}'))
    head = F.lpad(F.hex(schema_id), 8, "0")
    return table(spark, sf_dir, "orders").select(
        k.alias("key_id"), schema_id.alias("schema_id"),
        F.when(k % 97 == 0, F.concat(F.lit("FF"), head, F.hex(payload)))
        .when(k % 89 == 0, "0000")
        .when(k % 83 == 0, F.concat(F.lit("00"), head, F.hex(F.lit("{bad"))))
        .otherwise(F.concat(F.lit("00"), head, F.hex(payload))).alias("value_hex"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log positions of several engines, one per event."""
    ev, user = F.col("event_id"), F.col("user_id")
    ordinal = ev * 1_000_003
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", ordinal.alias("lsn_ord"),
        F.concat(F.hex(F.floor(ordinal / 2**32)), F.lit("/"), F.hex(ordinal % 2**32)).alias("lsn"),
        F.concat(F.lit("24da01e2-b892-11e7-8b0f-0242ac110002:"), ev).alias("gtid"),
        F.concat((user % 3).cast("string"), F.lit("-184055-"), ev).alias("mariadb_gtid"),
        F.concat_ws(":", F.lpad(F.hex(ev), 8, "0"), F.lpad(F.hex(user), 8, "0"), F.lpad(F.hex(ev % 16), 4, "0")).alias("mssql_lsn"))
