"""Five-byte message header: a zero byte and a big-endian schema id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_BYTES = 5


def wire_header(schema_id: Column) -> Column:
    """The header of a schema id; an id that does not fit in 32 bits is an error."""
    fits = schema_id.isNull() | ((schema_id >= 0) & (schema_id < 2**32))
    schema_id = F.when(fits, schema_id.cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("schema id does not fit in four bytes: "), schema_id.cast("string"))).cast("long"))
    return F.concat(F.lit(b"\x00"), F.unhex(F.lpad(F.hex(schema_id.cast("long")), 8, "0")))


def wire_encode(schema_id: Column, payload: Column) -> Column:
    return F.concat(wire_header(schema_id), payload.cast("binary"))


def wire_decode(value: Column) -> Column:
    """Struct of ``valid``, ``schema_id`` and ``payload``; the last two are NULL without a valid header."""
    valid = F.coalesce(
        (F.octet_length(value) >= HEADER_BYTES) & (F.substr(value, F.lit(1), F.lit(1)) == F.lit(b"\x00")),
        F.lit(False))
    schema_id = F.conv(F.hex(F.substr(value, F.lit(2), F.lit(4))), 16, 10).cast("long")
    return F.struct(
        valid.alias("valid"),
        F.when(valid, schema_id).alias("schema_id"),
        F.when(valid, F.substr(value, F.lit(HEADER_BYTES + 1), F.octet_length(value))).alias("payload"),
    )
