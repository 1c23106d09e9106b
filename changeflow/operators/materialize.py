"""Table state from a change log: current, as of a position, compacted, net and historical.

The last event per key comes from a partial ``max_by`` aggregation, so a key that holds a large
share of the events is reduced before the shuffle.

Rows of one transaction share a position, so everything is compared by (position, place in the transaction)
as one value: the last event of a key, the barrier of a truncate, the cut that ends a version. Where a
truncate and a row have the same place too, the truncate counts as the later one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..envelope import LAYOUT, Layout
from ..functions.diffing import diff_struct
from .commit import committed_only
from .expand import split_pk_update
from .skew import HOT_ROWS, bounded, join_small, neighbours, next_value, skew_join

FEW_TRUNCATES = 1000


def _order(layout: Layout) -> Column:
    return F.struct(layout.pos, layout.sub)


def place_of(df: DataFrame, layout: Layout = LAYOUT) -> Column:
    """(position, place in the transaction) as one value; the place is 0 where a log has none."""
    wide = layout.sub in df.columns and isinstance(df.schema[layout.sub].dataType, T.DecimalType)
    kind = "decimal(38,0)" if wide else "long"
    sub = F.coalesce(F.col(layout.sub).cast(kind), F.lit(0).cast(kind)) if layout.sub in df.columns else F.lit(0).cast(kind)
    return F.struct(F.col(layout.pos).alias("pos"), sub.alias("sub"))


def truncates(committed: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Truncate events of a committed log: table, position, place and time.

    Take them from the same form of the log as the events, as ``split_pk_update`` doubles places.
    """
    rows = committed.filter(F.col(layout.op) == "t")
    return rows.select(layout.table, layout.pos, place_of(rows, layout)["sub"].alias(layout.sub), layout.ts)


def _barriers(truncated: DataFrame, layout: Layout) -> DataFrame:
    return truncated.groupBy(layout.table).agg(F.max(place_of(truncated, layout)).alias("__barrier"))


def truncate_barrier(events: DataFrame, truncated: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Keeps keyed events after the last truncate of their table, also within its transaction."""
    met = join_small(events.filter(F.col(layout.key).isNotNull()), _barriers(truncated, layout), [layout.table], "left")
    return met.filter(F.col("__barrier").isNull() | (place_of(events, layout) > F.col("__barrier"))).drop("__barrier")


def latest_per_key(
    events: DataFrame, layout: Layout = LAYOUT, keep: Sequence[str] | None = None, one_of: str | None = None,
) -> DataFrame:
    """The last event of every key, by position and sub-order. Fails where the last ones differ in the number ``one_of``."""
    keep = list(keep) if keep else [c for c in events.columns if c not in layout.row_key]
    last = F.max_by(F.struct(*keep), _order(layout)).alias("__last")
    if one_of is None:
        return events.groupBy(*layout.row_key).agg(last).select(*layout.row_key, "__last.*")
    # The largest and the smallest number at the last place, by one maximum each.
    ends = [F.max(F.struct(_order(layout), sign.alias("what")))["what"].alias(n) for n, sign in (("__hi", F.col(one_of)), ("__lo", F.bitwise_not(one_of)))]
    found = events.groupBy(*layout.row_key).agg(last, *ends)
    tie = F.raise_error(F.concat(F.lit("several last changes at one place of key "), F.to_json(F.struct(*layout.row_key))))
    return found.filter((F.col("__hi") == F.bitwise_not("__lo")) | tie.cast("boolean")).select(*layout.row_key, "__last.*")


def materialize(
    log: DataFrame, tx: DataFrame | None = None, layout: Layout = LAYOUT, hot_rows: int = HOT_ROWS, strict: bool = False,
) -> DataFrame:
    """Current rows of all tables: table, key, ``after`` image and position of the last change.

    ``strict`` fails where different changes share the last place of a key, so that none can be told to be the last.
    """
    committed = log if tx is None else committed_only(log, tx, layout, hot_rows=hot_rows)
    rows = split_pk_update(committed, layout)
    events = truncate_barrier(rows.filter(F.col(layout.op) != "t"), truncates(rows, layout), layout)
    if strict:
        events = events.withColumn("__what", F.xxhash64(layout.op, F.to_json(F.struct(layout.after))))
    last = latest_per_key(events, layout, [layout.op, layout.after, layout.pos, layout.sub], "__what" if strict else None)
    return last.filter(F.col(layout.op) != "d").select(*layout.row_key, layout.after, layout.pos)


def state_as_of(
    log: DataFrame, position: int, tx: DataFrame | None = None, layout: Layout = LAYOUT, place: int | None = None,
) -> DataFrame:
    """State after a position, or after one place in the transaction at that position."""
    upto = F.col(layout.pos) <= position
    if place is not None:
        upto = upto & ((F.col(layout.pos) < position) | (place_of(log, layout)["sub"] <= place))
    return materialize(log.filter(upto), tx, layout)


def compact_log(events: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Last event per key of a split log, without deleted keys. Of events without a key, the last one
    of each operation stays."""
    kinds = events.withColumn("__kind", F.when(F.col(layout.key).isNull(), F.col(layout.op)))
    keep = [c for c in events.columns if c not in layout.row_key]
    last = kinds.groupBy(*layout.row_key, "__kind").agg(F.max_by(F.struct(*keep), _order(layout)).alias("__last"))
    return last.select(*layout.row_key, "__last.*").filter(F.col(layout.op) != "d")


def net_changes(events: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """One row per key that exists before or after the span: first before-image, last after-image."""
    spans = events.filter(F.col(layout.key).isNotNull()).groupBy(*layout.row_key).agg(
        F.min_by(F.struct(layout.before), _order(layout)).alias("__first"),
        F.max_by(F.struct(layout.after), _order(layout)).alias("__last"),
        F.count(F.lit(1)).alias("events"),
    ).select(*layout.row_key, f"__first.{layout.before}", f"__last.{layout.after}", "events")
    b, a = F.col(layout.before).isNotNull(), F.col(layout.after).isNotNull()
    return spans.withColumn("net_op", F.when(b & a, "u").when(a, "c").when(b, "d")).filter("net_op IS NOT NULL")


def with_next_truncate(
    events: DataFrame, truncated: DataFrame, layout: Layout = LAYOUT, limit: int = FEW_TRUNCATES, **split,
) -> DataFrame:
    """Adds ``cut``: place (position and place in the transaction) and time of the first truncate of the
    table after the event, or NULL.

    A few truncates are broadcast as one sorted list per table. Beyond ``limit`` they are merged
    into the order of the events instead.
    """
    cut = F.struct(place_of(truncated, layout).alias("at"), F.col(layout.ts).alias("ts"))
    here = place_of(events, layout)
    few = bounded(truncated, limit)
    if few is not None:
        lists = few.groupBy(layout.table).agg(F.sort_array(F.collect_set(cut)).alias("__cuts"))
        joined = events.join(F.broadcast(lists), layout.table, "left")
        later = F.get(F.filter("__cuts", lambda c: c["at"] >= here), 0)
        return joined.withColumn("cut", later).drop("__cuts")
    marks = truncated.select(layout.table, cut["at"].alias("__at"), F.lit(1).alias("__rank"), cut.alias("__mark"))
    merged = events.withColumns({"__at": here, "__rank": F.lit(0)}).unionByName(marks, allowMissingColumns=True)
    filled = next_value(merged, [layout.table], ["__at", "__rank"], "__mark", "cut", **split)
    return filled.filter(F.col("__mark").isNull()).drop("__at", "__rank", "__mark")


def change_history(
    events: DataFrame, truncated: DataFrame, layout: Layout = LAYOUT, few_truncates: int = FEW_TRUNCATES, **split,
) -> DataFrame:
    """Validity intervals of row versions; ``valid_to`` is NULL for the current version.

    A version ends with the next event of its key or with the next truncate of its table.
    """
    keyed = events.filter(F.col(layout.key).isNotNull())
    linked = neighbours(keyed.withColumn("__at", place_of(keyed, layout)), layout.row_key, ["__at"], ["__at", layout.ts], "__next", following=True, **split).drop("__at")
    versions = with_next_truncate(linked.filter(F.col(layout.op) != "d"), truncated, layout, few_truncates, **split)
    nxt, cut = F.col("__next"), F.col("cut")
    ended = F.when(nxt.isNull() | (cut["at"] < nxt["__at"]), cut["ts"]).otherwise(nxt[layout.ts])
    return versions.withColumns({"valid_from": F.col(layout.ts), "valid_to": ended}).drop("__next", "cut")


def truncate_counts(
    events: DataFrame, truncated: DataFrame, layout: Layout = LAYOUT, few_truncates: int = FEW_TRUNCATES, **split,
) -> DataFrame:
    """Rows that each truncate removed: keys alive since the truncate before it."""
    keyed = with_next_truncate(events.filter(F.col(layout.key).isNotNull()), truncated, layout, few_truncates, **split)
    at = [F.col("at.pos").alias("truncate_pos"), F.col("at.sub").alias("truncate_sub")]
    alive = (
        keyed.withColumn("at", F.col("cut.at")).filter("at IS NOT NULL")
        .groupBy(*layout.row_key, "at").agg(F.max_by(layout.op, place_of(events, layout)).alias("__op"))
        .groupBy(layout.table, "at").agg(F.count_if(F.col("__op") != "d").alias("purged"))
    )
    empty = truncated.select(layout.table, place_of(truncated, layout).alias("at"), F.lit(0).cast("long").alias("purged"))
    return alive.unionByName(empty).groupBy(layout.table, "at").agg(F.sum("purged").alias("purged")).select(layout.table, *at, "purged")


def update_lookup(
    updates: DataFrame, state: DataFrame, layout: Layout = LAYOUT, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Completes partial updates with the current row (``full``); NULL when the row is gone."""
    full = state.select(*layout.row_key, F.col(layout.after).alias("full"))
    return skew_join(updates, full, layout.row_key, "left", hot_rows=hot_rows)


def dedupe_events(events: DataFrame, event_id: str = "event_id") -> DataFrame:
    """One row per event id. Copies are removed before the shuffle, so many copies are harmless."""
    return events.dropDuplicates([event_id])


def idempotent_apply(events: DataFrame, ledger: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Events not applied before, once each. Both sides are unique when they meet."""
    return dedupe_events(events, event_id).join(ledger.select(event_id).distinct(), event_id, "left_anti")


def transitions(updates: DataFrame, field: str, fields: Sequence[str], layout: Layout = LAYOUT) -> DataFrame:
    """Updates that change ``field``: key, old value, new value, time."""
    b, a = F.col(layout.before), F.col(layout.after)
    return updates.filter(F.array_contains(diff_struct(b, a, fields), field)).select(
        *layout.row_key, layout.pos, b[field].alias("old_value"), a[field].alias("new_value"), layout.ts)


def search_feed(events: DataFrame, truncated: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Work list of a search index: CLEAR per truncated table, MAPPING_UPDATE per DDL event, and the
    last UPSERT or REMOVE per document after the last CLEAR. Apply in order of position and place.

    One pass: a document, a table and a DDL event are each a group of their own.
    """
    op = F.col(layout.op)
    is_doc, is_ddl = op.isin("c", "u", "r", "d"), op.startswith("DDL")
    relevant = join_small(events.filter(is_doc | is_ddl | (op == "t")), _barriers(truncated, layout), [layout.table], "left").filter(
        ~is_doc | F.col("__barrier").isNull() | (place_of(events, layout) > F.col("__barrier")))
    keep = [layout.op, layout.pos, layout.sub, layout.after]
    grouped = (
        relevant.withColumns({
            layout.key: F.when(is_doc, F.col(layout.key)),
            layout.after: F.when(is_doc, F.col(layout.after)),
            "__ddl": F.when(is_ddl, F.col(layout.pos))})
        .groupBy(*layout.row_key, "__ddl").agg(F.max_by(F.struct(*keep), _order(layout)).alias("__last"))
        .select(*layout.row_key, "__last.*"))
    action = F.when(is_ddl, "MAPPING_UPDATE").when(op == "t", "CLEAR").when(op == "d", "REMOVE").otherwise("UPSERT")
    return grouped.select(*layout.row_key, action.alias("action"), layout.pos, layout.sub, layout.after)


def retention_filter(df: DataFrame, ts: str, days: float = 7, now: str | None = None) -> DataFrame:
    """Rows within ``days`` of ``now`` (timestamp text), or of the newest row.

    The bound reaches the scan as a literal.
    """
    if now is None:
        now = df.agg(F.max(ts).cast("string")).first()[0]
    bound = F.lit(now).cast(df.schema[ts].dataType) - F.expr(f"INTERVAL '{int(days * 86400)}' SECOND")
    return df.filter(F.col(ts) >= bound) if now is not None else df


def recent_events(df: DataFrame, layout: Layout = LAYOUT, keep: int = 25) -> DataFrame:
    """The newest ``keep`` events, newest first."""
    return df.orderBy(F.col(layout.pos).desc(), F.col(layout.table)).limit(keep)


def position_order(events: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Events sorted by table, key and position within partitions of disjoint ranges.

    Ranges end inside a key when it is large, so no task has to take one key alone.
    """
    order = [*layout.row_key, layout.pos, layout.sub]
    return events.repartitionByRange(*order).sortWithinPartitions(*order)
