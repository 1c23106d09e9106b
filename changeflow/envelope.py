"""The canonical change envelope and the vocabulary of operations."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MAP = T.MapType(T.StringType(), T.StringType())

ENVELOPE = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("source", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("cluster", T.StringType()),
        T.StructField("database", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("table", T.StringType()),
    ])),
    T.StructField("tx", T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ord", T.DecimalType(38, 0)),  # SQL Server sequence values have ten bytes
    ])),
    T.StructField("position", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("value", T.StringType()),
    ])),
    T.StructField("pos_ord", T.DecimalType(38, 0)),
    T.StructField("key", _MAP),
    T.StructField("before", _MAP),
    T.StructField("after", _MAP),
    T.StructField("diff_fields", T.ArrayType(T.StringType())),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("schema_id", T.IntegerType()),
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("connector", T.StringType()),
    T.StructField("snapshot", T.BooleanType()),
    T.StructField("source_ts", T.TimestampType()),
    T.StructField("capture_ts", T.TimestampType()),
    T.StructField("status", T.StringType()),
])

# The six source engines, the event statuses and the position types.
ENGINES = ("postgres", "mysql", "mariadb", "oracle", "sqlserver", "mongodb")
STATUSES = ("EMITTED_TO_KAFKA", "SCHEMA_EVOLVED", "ROLLED_BACK_ZERO_EMISSION", "DLQ_QUARANTINE")
POSITION_TYPES = ("LSN", "GTID", "SCN", "RESUME_TOKEN")

# Operation codes and the event type each one carries.
EVENT_TYPES = {
    "c": "CREATE",
    "u": "UPDATE",
    "d": "DELETE",
    "r": "READ",
    "t": "TRUNCATE",
    "pk": "PK_UPDATE",
    "rb": "ROLLBACK",
    "DDL_ADD_COL": "DDL_ADD_COL",
    "DDL_ALTER_TYPE": "DDL_ALTER_TYPE",
    "DDL_DROP_COL": "DDL_DROP_COL",
}

# Names under which sources deliver an operation. LARGE_TX is a bulk insert.
OP_ALIASES = {
    "CREATE": "c",
    "INSERT": "c",
    "LARGE_TX": "c",
    "UPDATE": "u",
    "REPLACE": "u",
    "DELETE": "d",
    "READ": "r",
    "TRUNCATE": "t",
    "PK_UPDATE": "pk",
    "ROLLBACK": "rb",
}

# SQL Server change-table codes. 3 is the image before an update, 4 the one after.
MSSQL_OPS = {1: "d", 2: "c", 3: "u", 4: "u"}


class Layout(NamedTuple):
    """Column names of a change log. One row is one row mutation (or one table-level event).

    ``before`` and ``after`` are struct (typed) or map (bus form) columns. ``order`` lists the
    columns giving commit order within a table, the first of them numeric.
    """

    table: str = "tbl"
    op: str = "op"
    key: str = "key_id"
    old_key: str = "old_key_id"
    before: str = "before"
    after: str = "after"
    pos: str = "pos"
    sub: str = "sub_order"
    tx: str = "tx_id"
    ts: str = "source_ts"

    @property
    def row_key(self) -> list[str]:
        return [self.table, self.key]


LAYOUT = Layout()


def _lookup(mapping: dict, col: Column) -> Column:
    """Literal map lookup; NULL when the key is absent."""
    pairs = ", ".join(repr(x) for kv in mapping.items() for x in kv)
    return F.try_element_at(F.expr(f"map({pairs})"), col)


def canonical_op(col: Column) -> Column:
    """Operation code for a code or name from any source; unknown names give NULL."""
    return _lookup({**{k: k for k in EVENT_TYPES}, **OP_ALIASES}, col)


def canonical_mssql_op(col: Column) -> Column:
    return _lookup(MSSQL_OPS, col.cast("int"))


def event_type(op: Column) -> Column:
    return _lookup(EVENT_TYPES, op)


def category(op: Column) -> Column:
    return F.when(op.startswith("DDL"), "DDL").otherwise("DML")
