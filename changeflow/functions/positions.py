"""Log positions as comparable ordinals. Positions of different engines are never compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("decimal(20,0)")


def parse_lsn(text: Column) -> Column:
    """PostgreSQL ``hi/lo`` in hex as one number; NULL when malformed."""
    ok = text.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$")
    parts = F.split(text, "/")
    value = _hex(F.get(parts, 0)) * F.lit(2**32).cast("decimal(11,0)") + _hex(F.get(parts, 1))
    return F.when(ok, value.cast("decimal(20,0)"))


def parse_gtid(text: Column) -> Column:
    """MySQL ``uuid:sequence`` as struct of ``server`` and ``seq``."""
    parts = F.split(text, ":")
    return F.struct(F.get(parts, 0).alias("server"), F.element_at(parts, -1).try_cast("long").alias("seq"))


def parse_mariadb_gtid(text: Column) -> Column:
    """MariaDB ``domain-server-sequence`` as struct of three numbers; NULL without exactly three."""
    parts = F.split(text, "-")
    return F.when(
        F.size(parts) == 3,
        F.struct(
            F.get(parts, 0).try_cast("long").alias("domain"),
            F.get(parts, 1).try_cast("long").alias("server"),
            F.get(parts, 2).try_cast("long").alias("seq"),
        ),
    )


def parse_scn(text: Column) -> Column:
    return text.try_cast("decimal(20,0)")


# Weights of the three parts of a SQL Server position (4, 4 and 2 bytes).
_MSSQL_WEIGHTS = (2**48, 2**16, 1)


def parse_mssql_lsn(text: Column) -> Column:
    """SQL Server ``a:b:c`` in hex packed into one number of at most 80 bits; NULL when malformed."""
    parts = F.split(text, ":")
    ok = text.rlike("^[0-9A-Fa-f]{1,8}:[0-9A-Fa-f]{1,8}:[0-9A-Fa-f]{1,4}$")
    terms = [
        F.conv(F.get(parts, i), 16, 10).cast("decimal(10,0)") * F.lit(w).cast("decimal(16,0)")
        for i, w in enumerate(_MSSQL_WEIGHTS)
    ]
    return F.when(ok, (terms[0] + terms[1] + terms[2]).cast("decimal(38,0)"))


def parse_seqval(text: Column) -> Column:
    """SQL Server sequence value, up to ten bytes in hex (with or without ``0x``), as one number; NULL when malformed."""
    digits = F.regexp_replace(text, "^0[xX]", "")
    padded = F.lpad(digits, 20, "0")
    parts = F.concat_ws(":", F.substring(padded, 1, 8), F.substring(padded, 9, 8), F.substring(padded, 17, 4))
    return F.when(digits.rlike("^[0-9A-Fa-f]{1,20}$"), parse_mssql_lsn(parts))


def position_stream(engine: Column, value: Column) -> Column:
    """Within which positions are numbered: the server of a MySQL position, the domain of a MariaDB one, else the source."""
    return F.when(engine == "mysql", parse_gtid(value)["server"]).when(
        engine == "mariadb", parse_mariadb_gtid(value)["domain"].cast("string")).otherwise("")


# How each engine turns a position into an ordinal. MongoDB tokens order as text.
_ORDINALS = {
    "postgres": parse_lsn,
    "mysql": lambda v: parse_gtid(v)["seq"],
    "mariadb": lambda v: parse_mariadb_gtid(v)["seq"],
    "oracle": parse_scn,
    "sqlserver": parse_mssql_lsn,
}


def position_ordinal(engine: str, value: Column) -> Column:
    """Ordinal of a position of one engine; NULL where there is none."""
    ordinal = _ORDINALS[engine](value) if engine in _ORDINALS else F.lit(None)
    return ordinal.cast("decimal(38,0)")
