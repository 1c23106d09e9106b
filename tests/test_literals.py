"""Literal cases: one record in, the pinned result out."""

import hashlib

import pytest
from pyspark.sql import functions as F

from changeflow.envelope import EVENT_TYPES, MSSQL_OPS, canonical_mssql_op, canonical_op, category
from changeflow.functions import masking, positions, routing, wire
from changeflow.functions.diffing import diff_fields, diff_struct
from changeflow.operators import deadletter, expand, schema_gov, snapshot, transforms
from changeflow.operators.commit import committed_only
from changeflow.sources import engines
from changeflow.sources.engines import Source


def one(spark, **cols):
    row = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    return row if len(cols) > 1 else row[0]


def lit_map(d):
    pairs = [F.lit(x) for kv in d.items() for x in kv]
    return F.create_map(*pairs).cast("map<string,string>") if d else F.from_json(F.lit("{}"), "map<string,string>")


ORDER = {"id": "1001", "customer_id": "88", "amount_cents": "15000", "status": "PENDING"}


def test_diff_of_one_field(spark):
    assert one(spark, d=diff_fields(lit_map(ORDER), lit_map({**ORDER, "status": "CONFIRMED"}))) == ["status"]


@pytest.mark.parametrize("before,after,want", [
    ({"a": "1"}, {"a": "1", "b": "2"}, ["b"]),
    ({"z": "1", "a": "1"}, {"z": "2", "a": "3"}, ["a", "z"]),
    ({"a": "1", "gone": "x"}, {"a": "1"}, ["gone"]),
    ({}, {"a": "1"}, []),
    ({"a": "1"}, {}, []),
])
def test_diff_over_union_of_keys(spark, before, after, want):
    assert one(spark, d=diff_fields(lit_map(before), lit_map(after))) == want


def test_diff_missing_equals_null(spark):
    with_null = F.from_json(F.lit('{"a":"1","n":null}'), "map<string,string>")
    assert one(spark, d=diff_fields(with_null, lit_map({"a": "1"}))) == []
    assert one(spark, d=diff_fields(F.lit(None).cast("map<string,string>"), lit_map({"a": "1"}))) == []


def test_typed_diff_compares_numbers(spark):
    b = F.struct(F.lit(1.0).alias("n"), F.lit("x").alias("s"))
    a = F.struct(F.lit(1).alias("n"), F.lit("y").alias("s"))
    assert one(spark, d=diff_struct(b, a, ["n", "s"])) == ["s"]


def test_transform_record(spark):
    record = spark.range(1).select(
        lit_map({"id": "100", "status": "PENDING", "amount": "500"}).alias("before"),
        lit_map({"id": "100", "status": "COMPLETED", "amount": "750", "customer_email": "alice@corp.internal",
                 "credit_card": "4111999988881234"}).alias("after"))
    for kwargs in ({}, {"images": ("after",), "diff_raw": False}):
        row = transforms.smt_transform(record, **kwargs).first()
        want = hashlib.sha256(f"alice@corp.internal:{masking.SALT}".encode()).hexdigest()[:16]
        assert row["after"]["customer_email"] == want
        assert row["after"]["credit_card"] == "XXXX-XXXX-XXXX-1234"
        assert row["diff_fields"] == ["amount", "credit_card", "customer_email", "status"]
        assert row["masked_fields"] == ["credit_card", "customer_email"]


def test_transform_without_before_has_no_diff(spark):
    record = spark.range(1).select(F.lit(None).cast("map<string,string>").alias("before"), lit_map({"id": "1"}).alias("after"))
    assert transforms.smt_transform(record).first()["diff_fields"] is None


def test_before_image_is_masked_by_default_only(spark):
    image = {"email": "a@b.c"}
    df = spark.range(1).select(lit_map(image).alias("before"), lit_map(image).alias("after"))
    row = transforms.smt_transform(df).first()
    assert row["before"] == row["after"] != image and row["diff_fields"] == []
    row = transforms.smt_transform(df, images=("after",), diff_raw=False).first()
    assert row["before"] == image and row["diff_fields"] == ["email"]


@pytest.mark.parametrize("card,want", [
    ("4111-2222-3333-4444", "XXXX-XXXX-XXXX-4444"), ("12", "XXXX-XXXX-XXXX-XXXX"),
    ("", "XXXX-XXXX-XXXX-XXXX"), ("no digits", "XXXX-XXXX-XXXX-XXXX"), ("a1b2c3d4", "XXXX-XXXX-XXXX-1234"),
])
def test_card(spark, card, want):
    assert one(spark, c=masking.redact_card(F.lit(card))) == want


def test_email_masks(spark):
    mail = "jane.doe@enterprise.com"
    row = one(spark, p=masking.email_pseudonym(F.lit(mail)), s=masking.email_hash(F.lit(mail), "x"))
    assert row["p"] == hashlib.sha256(mail.encode()).hexdigest()[:16] + "@masked.com"
    assert row["s"] == hashlib.sha256(f"{mail}:x".encode()).hexdigest()[:16]


def test_falsy_values_stay(spark):
    img = lit_map({"email": "", "customer_email": "0", "credit_card": "false", "name": "n"})
    assert one(spark, m=masking.mask_image(img)) == {"email": "", "customer_email": "0", "credit_card": "false", "name": "n"}


def test_masking_leaves_other_fields_alone(spark):
    img = lit_map({"id": "1", "name": "Jane", "country": "US"})
    twice = masking.mask_image(masking.mask_image(img))
    assert one(spark, m=twice) == {"id": "1", "name": "Jane", "country": "US"}


def test_wire_round_trip(spark):
    row = one(spark, h=wire.wire_header(F.lit(42)), d=wire.wire_decode(wire.wire_encode(F.lit(42), F.lit("body"))))
    assert bytes(row["h"]) == b"\x00\x00\x00\x00\x2a"
    assert (row["d"]["valid"], row["d"]["schema_id"], bytes(row["d"]["payload"])) == (True, 42, b"body")


@pytest.mark.parametrize("raw", ["FF0000002A00", "0000", ""])
def test_wire_rejects(spark, raw):
    row = one(spark, d=wire.wire_decode(F.unhex(F.lit(raw))))
    assert row["valid"] is False and row["schema_id"] is None


def test_wire_null(spark):
    assert one(spark, d=wire.wire_decode(F.lit(None).cast("binary")))["valid"] is False


def test_positions(spark):
    row = one(
        spark, pg=positions.parse_lsn(F.lit("0/16B2D88")), hi=positions.parse_lsn(F.lit("1/0")), bad=positions.parse_lsn(F.lit("0/16B/1")),
        my=positions.parse_gtid(F.lit("24da01e2-b892-11e7-8b0f-0242ac110002:102")), ma=positions.parse_mariadb_gtid(F.lit("0-184055-9842")),
        ma2=positions.parse_mariadb_gtid(F.lit("0-184055")), scn=positions.parse_scn(F.lit("18934812")),
        ms=positions.parse_mssql_lsn(F.lit("00000028:00000198:0001")))
    assert int(row["pg"]) == 0x16B2D88 and int(row["hi"]) == 2**32 and row["bad"] is None
    assert row["my"]["seq"] == 102 and tuple(row["ma"]) == (0, 184055, 9842) and row["ma2"] is None
    assert int(row["scn"]) == 18934812 and int(row["ms"]) == (0x28 << 48) + (0x198 << 16) + 1


def test_largest_positions_do_not_overflow(spark):
    row = one(spark, pg=positions.parse_lsn(F.lit("FFFFFFFF/FFFFFFFF")), ms=positions.parse_mssql_lsn(F.lit("FFFFFFFF:FFFFFFFF:FFFF")))
    assert int(row["pg"]) == 2**64 - 1 and int(row["ms"]) == 2**80 - 1


def test_topics(spark):
    topic = lambda db, schema, table: one(spark, t=routing.topic_name(
        F.lit("local"), F.lit("ecommerce"), F.lit(db), F.lit(schema).cast("string"), F.lit(table)))
    assert topic("orders_db", "public", "orders") == "cdc.local.ecommerce.orders_db.public.orders"
    assert topic("inventory", "inventory", "products") == "cdc.local.ecommerce.inventory.products"
    assert topic("store", None, "items") == "cdc.local.ecommerce.store.items"


def test_partitions_and_shards(spark):
    row = one(spark, a=routing.partition_of(F.lit(1001)), b=routing.partition_of(F.lit(9999)),
              t=routing.logical_table(F.lit("orders_shard_07")), s=routing.shard_id(F.lit("orders_shard_07")), n=routing.shard_id(F.lit("orders")))
    assert tuple(row) == (2, 0, "orders", 7, None)


def test_operation_names(spark):
    for name, want in {"INSERT": "c", "CREATE": "c", "LARGE_TX": "c", "UPDATE": "u", "c": "c", "t": "t", "PK_UPDATE": "pk", "what": None}.items():
        assert one(spark, o=canonical_op(F.lit(name))) == want
    for code, want in MSSQL_OPS.items():
        assert one(spark, o=canonical_mssql_op(F.lit(code))) == want
    assert one(spark, o=canonical_mssql_op(F.lit(9))) is None
    assert one(spark, c=category(F.lit("DDL_ADD_COL"))) == "DDL" and EVENT_TYPES["r"] == "READ"


def log_of(spark, rows):
    schema = ("tbl string, op string, key_id bigint, old_key_id bigint, before struct<s:string>, after struct<s:string>, "
              "pos bigint, tx_id bigint, source_ts timestamp")
    return spark.createDataFrame([r + (None,) for r in rows], schema)


def test_key_update_becomes_two_events(spark):
    log = log_of(spark, [("orders", "u", 9999, 1001, ("CONFIRMED",), ("CONFIRMED",), 7, 1)])
    rows = [tuple(r) for r in expand.delete_tombstones(expand.split_pk_update(log))
            .select("op", "key_id", "before.s", "after.s", "sub_order", "tombstone").orderBy("sub_order").collect()]
    assert rows == [("d", 1001, "CONFIRMED", None, 0, False), ("d", 1001, None, None, 1, True), ("c", 9999, None, "CONFIRMED", 2, False)]


def test_rolled_back_transaction_is_not_emitted(spark):
    log = log_of(spark, [("orders", "c", k, None, None, ("x",), k, t) for k, t in enumerate([701, 702, 703, 704])])
    tx = spark.createDataFrame([(701, "COMMITTED"), (702, "COMMITTED"), (703, "ABORTED")], "tx_id bigint, status string")
    for limit in (100, 0):  # broadcast of the failed ids, and the shuffle beyond the limit
        assert sorted(r["tx_id"] for r in committed_only(log, tx, limit=limit).collect()) == [701, 702]


def test_snapshot_row_loses_to_log(spark):
    rows = spark.createDataFrame([(0, 500, "PENDING"), (0, 501, "PENDING")], "chunk_id bigint, key_id bigint, status string")
    log = spark.createDataFrame([(500, 15), (501, 25)], "key_id bigint, pos bigint")
    windows = spark.createDataFrame([(0, 10, 20)], "chunk_id bigint, low bigint, high bigint")
    for chunk_of in (None, F.floor(F.col("key_id") / 1024)):
        assert [r["key_id"] for r in snapshot.dblog_reconcile(rows, log, windows, chunk_of=chunk_of).collect()] == [501]
    open_window = windows.withColumn("high", F.lit(None).cast("bigint"))
    assert snapshot.dblog_reconcile(rows, log, open_window).count() == 0
    assert snapshot.dblog_reconcile(rows, log, windows.limit(0)).count() == 0  # no window yet: pending


def test_snapshot_signal(spark):
    signal = snapshot.snapshot_signal(F.array(F.lit("public.orders")), F.lit("amount_cents > 1000"), F.lit("sig_1"))
    row = snapshot.parse_signals(spark.range(1).select(signal.alias("s")).select("s.*")).first()
    assert tuple(row) == ("sig_1", "execute-snapshot", "incremental", "public.orders", "amount_cents > 1000")


def test_poison_record(spark):
    raw = spark.createDataFrame([(1, bytearray(b"\xff\xde\xad\xbe\xef"))], "id int, value binary")
    letters = deadletter.dlq_envelope(
        deadletter.dead(deadletter.parse_messages(raw, "id int")), F.lit("t"), F.lit("ecommerce"), F.lit("orders"))
    row = letters.first()
    assert row["dlq_topic"] == "cdc.dlq.ecommerce.orders" and bytes(row["payload"]) == b"\xff\xde\xad\xbe\xef"
    assert row["headers"] == {"error_type": "POISON_PILL", "retry_count": "0"}
    fixed = deadletter.dlq_envelope(
        deadletter.dead(deadletter.parse_messages(raw, "id int")), F.lit("t"), F.lit("e"), F.lit("o"), override="cdc.dlq.orders.unparseable")
    assert fixed.first()["dlq_topic"] == "cdc.dlq.orders.unparseable"


def test_payload_must_fit_the_fields(spark):
    bodies = ['{"id":1}', '{"id":"x"}', "[1]", "null", "", '{"other":1}']
    raw = spark.createDataFrame([(b,) for b in bodies], "b string").withColumn("value", wire.wire_encode(F.lit(7), F.col("b")))
    got = {r["b"]: r["reason"] for r in deadletter.parse_messages(raw, "id int").collect()}
    assert [got[b] for b in bodies] == [None, "BAD_JSON", "BAD_JSON", "BAD_JSON", "BAD_JSON", None]


def test_retries_end_parked(spark):
    letters = spark.createDataFrame([(n, bytearray(b"\xff"), n) for n in range(4)], "n int, payload binary, retry_count int")
    rows = deadletter.dlq_retry(letters, "id int").select("n", "outcome", "retry_count", "next_wait_ms").orderBy("n").collect()
    assert [tuple(r) for r in rows] == [(0, "RETRY", 1, 1000), (1, "RETRY", 2, 2000), (2, "PARKED", 3, None), (3, "PARKED", 3, None)]


def verdict(spark, v1, v2, **kwargs):
    rows = [("s", 1, *f) for f in v1] + [("s", 2, *f) for f in v2]
    reg = spark.createDataFrame(rows, "subject string, version int, field string, type string, has_default boolean")
    return schema_gov.schema_compat(schema_gov.schema_diff(reg), **kwargs).first()


BASE = [("id", "int", False), ("amount_cents", "int", False)]


@pytest.mark.parametrize("v2,action", [
    (BASE + [("loyalty_score", "int", True)], "AUTO_REGISTER"),
    (BASE + [("loyalty_score", "int", False)], "QUARANTINE_DLQ"),
    (BASE[:1], "QUARANTINE_DLQ"),
    ([BASE[0], ("amount_cents", "long", False)], "AUTO_REGISTER"),
    ([BASE[0], ("amount_cents", "string", False)], "QUARANTINE_DLQ"),
    (BASE, "AUTO_REGISTER"),
])
def test_schema_verdicts(spark, v2, action):
    assert verdict(spark, BASE, v2)["policy_action"] == action


def test_schema_policies(spark):
    assert verdict(spark, BASE, BASE[:1], policy="avro_backward")["compatible"]
    assert verdict(spark, BASE, BASE + [("x", "int", False)], check_added_defaults=False)["compatible"]
    assert verdict(spark, BASE, BASE[:1])["dropped_fields"] == ["amount_cents"]
    with pytest.raises(ValueError):
        schema_gov.incompatible("other")


def test_engine_literals(spark):
    pg = spark.sql("""SELECT 'orders' AS table, '0/16B2D88' AS lsn, 948102 AS tx_id,
        named_struct('id', 101, 'customer_id', 42, 'status', 'PENDING', 'amount_cents', 2500) AS old_tuple,
        named_struct('id', 101, 'customer_id', 42, 'status', 'CONFIRMED', 'amount_cents', 2500) AS new_tuple""")
    row = engines.normalize("postgres", pg, Source("orders_db", ["id"], "public")).first()
    assert (row["event_type"], row["key"], row["before"]["status"], row["after"]["status"]) == ("UPDATE", {"id": "101"}, "PENDING", "CONFIRMED")
    assert row["position"]["value"] == "0/16B2D88" and int(row["pos_ord"]) == 0x16B2D88 and row["tx"]["id"] == "948102"

    maria = spark.sql("""SELECT 'products' AS table, '0-184055-9843' AS gtid, 'c' AS op,
        '{"sku":"MARIA-SKU-99","name":"MariaDB High Perf SSD","price_cents":12900}' AS after""")
    row = engines.normalize("mariadb", maria, Source("store_catalog", ["sku"])).first()
    assert row["before"] is None and row["key"] == {"sku": "MARIA-SKU-99"} and row["after"]["price_cents"] == "12900"

    mongo = spark.sql("""SELECT 'items' AS collection, 'update' AS operation_type, '8263A29B000000012B0229296E04' AS token,
        named_struct('_id', 'item_4019') AS document_key, named_struct('_id', 'item_4019', 'stock', 42) AS full_document""")
    row = engines.normalize("mongodb", mongo, Source("catalog", ["_id"])).first()
    assert row["source"]["schema"] is None and row["before"] is None and row["position"]["type"] == "RESUME_TOKEN" and row["pos_ord"] is None

    mssql = spark.sql("""SELECT * FROM VALUES
        (3, '00000028:00000198:0001', 'a', 'Leads', named_struct('lead_id', 8802, 'status', 'NEW')),
        (4, '00000028:00000198:0001', 'a', 'Leads', named_struct('lead_id', 8802, 'status', 'QUALIFIED'))
        AS t(operation, start_lsn, seqval, table, columns)""")
    rows = engines.normalize("sqlserver", mssql, Source("CRM", ["lead_id"], "dbo")).collect()
    assert len(rows) == 1 and rows[0]["op"] == "u" and rows[0]["before"]["status"] == "NEW" and rows[0]["after"]["status"] == "QUALIFIED"


def test_engine_key_move_is_recognised(spark):
    pg = spark.sql("""SELECT 'orders' AS table, '0/1' AS lsn, 1 AS tx_id, named_struct('id', 1001) AS old_tuple, named_struct('id', 9999) AS new_tuple""")
    assert engines.normalize("postgres", pg, Source("d", ["id"])).first()["op"] == "pk"


def test_unknown_engine(spark):
    with pytest.raises(ValueError):
        engines.normalize("db2", spark.range(1), Source("d", ["id"]))
    engines.register_normalizer("db2", lambda raw, source: raw)
    try:
        assert engines.normalize("db2", spark.range(3), Source("d", ["id"])).count() == 3
    finally:
        del engines.NORMALIZERS["db2"]


def test_include_list_and_renames(spark):
    rows = spark.createDataFrame([("public", "orders"), ("public", "orders2"), ("dbo", "orders")], "s string, t string")
    keep = lambda entries: sorted(tuple(r) for r in transforms.include_tables(rows, entries, F.col("s"), F.col("t")).collect())
    assert keep("public.orders,public.customers") == [("public", "orders")]
    assert keep(["public\\.orders.*"]) == [("public", "orders"), ("public", "orders2")]
    renamed = schema_gov.rename_columns(rows, {"s": "a", "a": "b"})
    assert renamed.columns == ["b", "t"]


def test_null_written_by_new_version_stays(spark):
    old = spark.createDataFrame([(1,)], "id int")
    new = spark.createDataFrame([(2, None), (3, "GOLD")], "id int, tier string")
    got = {r["id"]: r["tier"] for r in schema_gov.read_with_defaults([old, new], {"tier": "BRONZE"}).collect()}
    assert got == {1: "BRONZE", 2: None, 3: "GOLD"}
