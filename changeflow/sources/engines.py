"""Normalisers from the change formats of six engines to the canonical envelope.

A normaliser is one projection (SQL Server needs one grouping to pair its update images). Row
images may arrive as struct, map or JSON text columns. Many rows share one position, so the place of a
row in its transaction is taken in (``row_ord``, where the source gives it) and becomes, with the key,
part of the event id and of the order. Where there is none, a digest of both images is part of the id, so that
two changes of one key at one position stay two, and the topic ``offset`` orders them. ``source_ts``, ``capture_ts``, ``tx_ts`` and ``tx_id`` are
taken in under these names where the raw changes have them.

``from_envelope`` turns envelopes into the flat log that the state operators read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..envelope import STATUSES, canonical_mssql_op, canonical_op, category, event_type
from ..functions.diffing import diff_fields
from ..functions.positions import parse_seqval, position_ordinal, position_stream
from ..functions.routing import event_id
from ..operators.failover import epochs, with_epoch
from ..operators.transforms import extract_key


class Source(NamedTuple):
    """Where the changes come from, and the primary-key fields of their tables."""

    database: str
    pk: Sequence[str]
    schema: str | None = None
    cluster: str | None = None
    connector: str | None = None


Normalizer = Callable[[DataFrame, Source], DataFrame]
NORMALIZERS: dict[str, Normalizer] = {}


def register_normalizer(engine: str, normalizer: Normalizer) -> None:
    NORMALIZERS[engine] = normalizer


def normalize(engine: str, raw: DataFrame, source: Source) -> DataFrame:
    if engine not in NORMALIZERS:
        raise ValueError(f"unknown engine {engine!r}; known: {sorted(NORMALIZERS)}")
    return NORMALIZERS[engine](raw, source)


def image(df: DataFrame, name: str) -> Column:
    """A row image as ``map<string,string>``; an absent column is NULL."""
    if name not in df.columns:
        return F.lit(None).cast("map<string,string>")
    kind = df.schema[name].dataType
    if isinstance(kind, T.MapType):
        return F.col(name)
    if isinstance(kind, T.StructType):
        names = F.array(*[F.lit(f.name) for f in kind.fields])
        values = F.array(*[F.col(name)[f.name].cast("string") for f in kind.fields])
        return F.when(F.col(name).isNotNull(), F.map_from_arrays(names, values))
    return F.from_json(F.col(name), "map<string,string>")


def _envelope(
    df: DataFrame, engine: str, source: Source, op: Column, position_type: str, position: str, table: Column,
    key: Column | None = None, before: str = "before", after: str = "after", tx: str | None = None,
    schema: Column | None = None, moved: bool = False, sub: Column | None = None,
) -> DataFrame:
    df = df.withColumns({"__b": image(df, before), "__a": image(df, after)})
    b, a = F.col("__b"), F.col("__a")
    given = lambda name, kind: (F.col(name) if name in df.columns else F.lit(None)).cast(kind)
    if tx is None and "tx_id" in df.columns:
        tx = "tx_id"
    if moved:
        changed = F.lit(False)
        for k in source.pk:
            changed = changed | ~b[k].eqNullSafe(a[k])
        op = F.when((op == "u") & changed, "pk").otherwise(op)
    if schema is None:
        schema = F.lit(source.schema).cast("string")
    key = extract_key(b, a, source.pk) if key is None else key
    place = given("row_ord", "decimal(38,0)") if sub is None else sub
    images = F.when(place.isNull(), F.sha2(F.concat_ws("|", F.to_json(b), F.lit("to"), F.to_json(a)), 256))
    return df.select(
        event_id(F.lit(engine), F.lit(source.database), schema, table, F.col(position), F.coalesce(place.cast("string"), images),
                 F.to_json(key), op).alias("event_id"),
        event_type(op).alias("event_type"), op.alias("op"), category(op).alias("category"),
        F.struct(
            F.lit(engine).alias("type"), F.lit(source.cluster).cast("string").alias("cluster"),
            F.lit(source.database).alias("database"), schema.alias("schema"), table.alias("table")).alias("source"),
        F.struct(
            (F.col(tx).cast("string") if tx else F.lit(None).cast("string")).alias("id"),
            given("tx_ts", "timestamp").alias("ts"), place.cast("decimal(38,0)").alias("ord")).alias("tx"),
        F.struct(F.lit(position_type).alias("type"), F.col(position).cast("string").alias("value")).alias("position"),
        position_ordinal(engine, F.col(position).cast("string")).alias("pos_ord"),
        key.alias("key"), b.alias("before"), a.alias("after"), diff_fields(b, a).alias("diff_fields"),
        given("topic", "string").alias("topic"), given("partition", "int").alias("partition"), given("offset", "long").alias("offset"),
        given("schema_id", "int").alias("schema_id"), given("schema_version", "int").alias("schema_version"),
        F.lit(source.connector).cast("string").alias("connector"), (op == "r").alias("snapshot"),
        given("source_ts", "timestamp").alias("source_ts"), given("capture_ts", "timestamp").alias("capture_ts"),
        F.lit(STATUSES[0]).alias("status"))


def _postgres(raw: DataFrame, source: Source) -> DataFrame:
    """``table, old_tuple, new_tuple, lsn, tx_id``; the tuples tell the operation."""
    op = F.when(F.col("old_tuple").isNull(), "c").when(F.col("new_tuple").isNull(), "d").otherwise("u")
    return _envelope(raw, "postgres", source, op, "LSN", "lsn", F.col("table"), before="old_tuple", after="new_tuple",
                     tx="tx_id", moved=True)


def _mysql(raw: DataFrame, source: Source) -> DataFrame:
    """``table, op, gtid, before, after``. Databases are schemas here, so none is set."""
    return _envelope(raw, "mysql", source, canonical_op(F.col("op")), "GTID", "gtid", F.col("table"), moved=True)


def _mariadb(raw: DataFrame, source: Source) -> DataFrame:
    """``table, op, gtid, after`` and possibly ``before``."""
    return _envelope(raw, "mariadb", source, canonical_op(F.col("op")), "GTID", "gtid", F.col("table"), moved=True)


def _oracle(raw: DataFrame, source: Source) -> DataFrame:
    """``owner, table, operation, scn, before, after``."""
    return _envelope(raw, "oracle", source, canonical_op(F.upper("operation")), "SCN", "scn", F.col("table"),
                     schema=F.col("owner"), moved=True)


def pair_mssql(raw: DataFrame, columns: str = "columns") -> DataFrame:
    """Change-table rows ``operation, start_lsn, seqval, table, columns`` with the two images of an
    update in one row. At most two rows share a (position, sequence)."""
    code = F.col("operation")
    kept = [c for c in ("row_ord", "source_ts", "capture_ts", "tx_ts", "tx_id") if c in raw.columns]
    picked = lambda *codes: F.max_by(F.col(columns), F.when(code.isin(*codes), code))
    return raw.groupBy("table", "start_lsn", "seqval").agg(
        F.max(code).alias("operation"), picked(1, 3).alias("before"), picked(2, 4).alias("after"), *[F.max(c).alias(c) for c in kept])


def _sqlserver(raw: DataFrame, source: Source) -> DataFrame:
    paired = pair_mssql(raw)
    return _envelope(paired, "sqlserver", source, canonical_mssql_op(F.col("operation")), "LSN", "start_lsn", F.col("table"),
                     sub=parse_seqval(F.col("seqval")))


def _mongodb(raw: DataFrame, source: Source) -> DataFrame:
    """``operation_type, collection, token, document_key, full_document``; there is no before image."""
    return _envelope(raw, "mongodb", source, canonical_op(F.upper("operation_type")), "RESUME_TOKEN", "token",
                     F.col("collection"), key=image(raw, "document_key"), after="full_document",
                     schema=F.lit(None).cast("string"))


for _name, _fn in (
    ("postgres", _postgres), ("mysql", _mysql), ("mariadb", _mariadb),
    ("oracle", _oracle), ("sqlserver", _sqlserver), ("mongodb", _mongodb),
):
    register_normalizer(_name, _fn)


def normalize_all(raws: dict[str, tuple[DataFrame, Source]]) -> DataFrame:
    """One envelope frame from the raw changes of several engines."""
    out = None
    for engine, (raw, source) in raws.items():
        one = normalize(engine, raw, source)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


_CLUSTER = ["__type", "__cluster", "__database"]


def _numbered(envelopes: DataFrame, arrival: Column, starts: DataFrame | None) -> DataFrame:
    """Adds ``__epoch``, the place of a stream among those of its cluster."""
    rows = envelopes.withColumns({
        "__type": F.col("source.type"), "__cluster": F.coalesce("source.cluster", F.lit("")), "__database": F.coalesce("source.database", F.lit("")),
        "__stream": position_stream(F.col("source.type"), F.col("position.value")), "__arrived": arrival})
    if starts is None and not rows.isStreaming:
        # One row, whatever the number of clusters: is there one of several streams, and one whose order is unknown?
        found = rows.filter(F.col("__type").isin("mysql", "mariadb")).groupBy(*_CLUSTER).agg(
            (F.min("__stream") != F.max("__stream")).alias("several"), F.count_if(F.col("__arrived").isNull()).alias("unknown")).filter("several").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("unknown") > 0, F.to_json(F.struct(*_CLUSTER)))).alias("unknown")).first()
        if found["unknown"]:
            raise ValueError(f"several servers without an arrival in {found['unknown']}: their order is unknown")
        if found["n"]:
            starts = position_epochs(envelopes, arrival)
    if starts is None:
        return rows.withColumn("__epoch", F.lit(1).cast("long"))
    return with_epoch(rows, starts, _CLUSTER, "__stream", "pos_ord").withColumn("__epoch", F.coalesce("epoch", F.lit(1)))


def first_arrival() -> Column:
    """When an envelope came in: the time of its capture and the offset in its topic; NULL where neither is known."""
    known = F.col("capture_ts").isNotNull() | F.col("offset").isNotNull()
    return F.when(known, F.struct(F.col("capture_ts").alias("ts"), F.col("offset").alias("offset")))


def position_epochs(envelopes: DataFrame, arrival: Column | None = None) -> DataFrame:
    """Where the epochs of each cluster begin. Keep them with the table, so that the positions of later batches join up."""
    rows = envelopes.filter(F.col("source.type").isin("mysql", "mariadb")).select(
        F.col("source.type").alias("__type"), F.coalesce("source.cluster", F.lit("")).alias("__cluster"),
        F.coalesce("source.database", F.lit("")).alias("__database"), position_stream(F.col("source.type"), F.col("position.value")).alias("__stream"),
        "pos_ord", (first_arrival() if arrival is None else arrival).alias("__arrived"))
    return epochs(rows, _CLUSTER, "__stream", "pos_ord", "__arrived")


def from_envelope(envelopes: DataFrame, arrival: Column | None = None, starts: DataFrame | None = None) -> DataFrame:
    """The flat change log of envelopes: ``tbl, op, key_id, old_key_id, before, after, pos, sub_order,
    tx_id, source_ts, event_id``.

    A key of any number of fields becomes JSON text, with its fields in one order. Tables of different
    sources never share a name, and a table has one source, so positions of one kind are compared: numbers of
    one width as text, resume tokens as they are.

    Where a cluster has several servers or domains, the number of the epoch comes first: positions are ordered by
    number within a stream and by first ``arrival`` across streams (see ``failover``); by default that is the time of
    capture and the topic offset. Without an arrival several streams are refused. ``starts`` are epochs known from before.
    """
    rows = _numbered(envelopes, first_arrival() if arrival is None else arrival, starts)
    key = F.col("key")
    before = F.map_from_arrays(F.map_keys(key), F.transform(F.map_keys(key), lambda k: F.try_element_at(F.col("before"), k)))
    text = lambda m: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
    number = F.lpad(F.col("pos_ord").cast("string"), 38, "0")
    number = F.when(F.col("source.type").isin("mysql", "mariadb"), F.concat_ws(".", F.lpad(F.col("__epoch").cast("string"), 10, "0"), number)).otherwise(number)
    return rows.select(
        F.concat_ws(".", "source.type", "source.database", "source.schema", "source.table").alias("tbl"), "op",
        F.when(F.size(key) > 0, text(key)).alias("key_id"), F.when(F.col("op") == "pk", text(before)).alias("old_key_id"),
        "before", "after", F.coalesce(F.when(F.col("pos_ord").isNotNull(), number), "position.value").alias("pos"),
        F.coalesce("tx.ord", F.col("offset").cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("sub_order"),
        F.col("tx.id").alias("tx_id"), "source_ts", "event_id")
