"""Topic names, partitions and event ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default partition count of a topic and the dead-letter prefix.
PARTITIONS = 3
DLQ_PREFIX = "cdc.dlq"


def topic_name(env: Column, system: Column, database: Column, schema: Column, table: Column) -> Column:
    """``cdc.env.system.database.schema.table``; no schema part when absent or equal to the database."""
    shown = F.when(schema != database, schema)
    return F.concat_ws(".", F.lit("cdc"), env, system, database, shown, table)


def dlq_topic(system: Column, table: Column, prefix: str = DLQ_PREFIX) -> Column:
    return F.concat_ws(".", F.lit(prefix), system, table)


# Fixed value: shard suffix of a physical table.
_SHARD = r"_shard_(\d+)$"


def logical_table(table: Column) -> Column:
    return F.regexp_replace(table, _SHARD, "")


def shard_id(table: Column) -> Column:
    """Shard number added to the key of a logical table; NULL for an unsharded table."""
    digits = F.regexp_extract(table, _SHARD, 1)
    return F.when(digits != "", digits.cast("int"))


def partition_of(key: Column, partitions: int = PARTITIONS) -> Column:
    """Partition of a numeric key."""
    return F.pmod(key, F.lit(partitions)).cast("int")


def partition_of_text(key: Column, partitions: int = PARTITIONS) -> Column:
    """Partition of a text or composite key, by the first 32 bits of its MD5 digest."""
    digest = F.conv(F.substr(F.md5(key.cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return F.pmod(digest, F.lit(partitions).cast("long")).cast("int")


def event_id(*parts: Column) -> Column:
    """Deterministic id, so that a replay gives the same id. NULL parts count as empty text."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit("evt_"), F.substr(F.sha2(text, 256), F.lit(1), F.lit(26)))
