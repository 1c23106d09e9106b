"""Stateless transforms of change events: narrow, no shuffle, usable on streams."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..envelope import category
from ..functions import masking
from ..functions.diffing import both_present, diff_fields

Transform = Callable[[DataFrame], DataFrame]


def with_category(df: DataFrame, op: str = "op") -> DataFrame:
    return df.withColumn("category", category(F.col(op)))


def filter_category(df: DataFrame, choice: str = "ALL", op: str = "op") -> DataFrame:
    """``ALL``, ``DML``, ``DDL`` or one operation code."""
    if choice == "ALL":
        return df
    if choice in ("DML", "DDL"):
        return df.filter(category(F.col(op)) == choice)
    return df.filter(F.col(op) == choice)


def include_tables(df: DataFrame, entries: str | Sequence[str], schema: Column, table: Column) -> DataFrame:
    """Rows of the listed ``schema.table`` names; an entry may be an anchored regular expression."""
    items = [e.strip() for e in (entries.split(",") if isinstance(entries, str) else entries) if e.strip()]
    plain = [e for e in items if re.fullmatch(r"[\w$#]+(\.[\w$#]+)*", e)]
    name = F.concat_ws(".", schema, table)
    keep = name.isin(plain) if plain else F.lit(False)
    for pattern in (e for e in items if e not in plain):
        keep = keep | name.rlike(f"^(?:{pattern})$")
    return df.filter(keep)


def gtid_source_filter(df: DataFrame, servers: Sequence, server: Column, op: str = "op") -> DataFrame:
    """Drops row events of other servers; DDL passes."""
    return df.filter((category(F.col(op)) != "DML") | server.isin(list(servers)))


def decimals_to_double(df: DataFrame) -> DataFrame:
    return df.withColumns({
        f.name: F.col(f.name).cast("double") for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)})


def unwrap_after(df: DataFrame, keep: Sequence[str], after: str = "after") -> DataFrame:
    """Row state in place of the envelope; a delete gives a row of NULLs besides ``keep``."""
    return df.select(*keep, f"{after}.*")


def extract_key(before: Column, after: Column, pk: Sequence[str]) -> Column:
    """Primary-key fields of a map image, from the after image when there is one."""
    return F.map_filter(F.coalesce(after, before), lambda k, _: k.isin(*pk))


def compaction_key(key: Column) -> Column:
    return F.to_json(key)


def stamp_metadata(
    df: DataFrame, connector: str, schema_id: int, schema_version: int, snapshot: bool = False,
    status: str = "EMITTED_TO_KAFKA",
) -> DataFrame:
    return df.withColumns({
        "connector": F.lit(connector), "schema_id": F.lit(schema_id), "schema_version": F.lit(schema_version),
        "snapshot": F.lit(snapshot), "status": F.lit(status)})


def render_payload(
    event_id: Column, event_type: Column, source: Column, position: Column, key: Column,
    before: Column, after: Column, metadata: Column,
) -> Column:
    """Message body as JSON; absent images are written as null."""
    return F.to_json(F.struct(
        event_id.alias("eventId"), event_type.alias("eventType"), source.alias("source"), position.alias("position"),
        key.alias("key"), before.alias("before"), after.alias("after"), metadata.alias("metadata"),
    ), {"ignoreNullFields": "false"})


def unwrap_payload(df: DataFrame, value: str, payload_schema: str) -> DataFrame:
    """Fields of the ``payload`` of a message that carries its schema next to it."""
    parsed = F.from_json(value, f"struct<schema:string,payload:{payload_schema}>")
    return df.withColumn("__doc", parsed).select(*[c for c in df.columns if c != value], "__doc.payload.*")


def smt_transform(
    df: DataFrame, email_fields: Sequence[str] = masking.EMAIL_FIELDS, card_fields: Sequence[str] = masking.CARD_FIELDS,
    mode: str = masking.HASH, salt: str = masking.SALT, images: Sequence[str] = ("before", "after"),
    diff_raw: bool = True, before: str = "before", after: str = "after",
) -> DataFrame:
    """Diff and mask the map images; adds ``diff_fields`` and ``masked_fields``.

    By default the diff compares raw images and both images are masked. With
    ``images=("after",), diff_raw=False`` only the after image is masked, and the diff then compares
    it with the raw before image, so a masked field always shows as changed.
    """
    raw_b, raw_a = F.col(before), F.col(after)
    shown = {
        c: masking.mask_image(F.col(c), email_fields, card_fields, mode, salt) if c in images else F.col(c)
        for c in (before, after)
    }
    diff = diff_fields(raw_b, raw_a) if diff_raw else diff_fields(shown[before], shown[after])
    return df.withColumns({
        "diff_fields": F.when(both_present(raw_b, raw_a), diff),
        "masked_fields": masking.masked_fields(raw_a, email_fields, card_fields),
        **shown,
    })


def chain(df: DataFrame, *steps: Transform) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df
