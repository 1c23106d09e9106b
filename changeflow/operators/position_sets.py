"""Sets of executed positions: per server, intervals of sequence numbers.

A set is a frame with the columns ``by`` (any number, may be none), ``server``, ``low`` and ``high``, both ends
included. Sets are compared by a sweep over the ends of their intervals, so the work grows with the number of
intervals and not with the positions inside them. A server with very many intervals is swept in segments.

NULL servers and ends, and intervals whose end lies before their start, are empty.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import bounded, neighbours, next_value, running

FEW_INTERVALS = 10_000
_SET = ["server", "low", "high"]


def parse_position_set(text: Column) -> Column:
    """``uuid:1-5:11,uuid:7`` as array of ``server, low, high``. Parts that are no interval are left out."""
    def intervals(fields: Column) -> Column:
        server = F.lower(F.trim(F.get(fields, 0)))
        return F.transform(F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0))), lambda r: F.struct(
            server.alias("server"), F.trim(F.get(F.split(r, "-"), 0)).try_cast("long").alias("low"),
            F.trim(F.element_at(F.split(r, "-"), -1)).try_cast("long").alias("high")))
    # Parts are split in a step of their own: inside the function over intervals a part would be split again for each of them.
    parts = F.transform(F.split(text, ","), lambda part: F.split(F.trim(part), ":"))
    found = F.flatten(F.transform(parts, intervals))
    return F.filter(found, lambda i: i["low"] <= i["high"])


def parse_domain_positions(text: Column) -> Column:
    """``domain-server-sequence`` positions, joined by commas: all of a domain up to its sequence."""
    def upto(part: Column) -> Column:
        fields = F.split(F.trim(part), "-")
        return F.struct(F.get(fields, 0).alias("server"), F.lit(1).cast("long").alias("low"),
                        F.when(F.size(fields) == 3, F.get(fields, 2).try_cast("long")).alias("high"))
    return F.filter(F.transform(F.split(text, ","), upto), lambda i: i["low"] <= i["high"])


def _sweep(sides: Sequence[DataFrame], by: Sequence[str], keep: Callable[..., Column], **split) -> DataFrame:
    """The set of the positions whose cover, one number for each side, ``keep`` accepts; intervals neither touch nor overlap."""
    group, names = [*by, "server"], [f"__c{i}" for i in range(len(sides))]
    ends = None
    for i, side in enumerate(sides):
        good = side.filter(F.col("server").isNotNull() & (F.col("low") <= F.col("high")))
        step = lambda at, sign, i=i: F.struct(
            at.alias("at"), *[F.lit(sign if i == j else 0).cast("long").alias(n) for j, n in enumerate(names)])
        one = good.select(*group, F.explode(F.array(step(F.col("low"), 1), step(F.col("high") + 1, -1))).alias("e")).select(*group, "e.*")
        ends = one if ends is None else ends.unionByName(one)
    # Ends that coincide are one point, so the order of points has no ties.
    points = ends.groupBy(*group, "at").agg(*[F.sum(n).alias(n) for n in names])
    cover = running(points, group, ["at"], {n + "s": (F.sum, n) for n in names}, **split)
    held = cover.select(*group, "at", keep(*[F.col(n + "s") for n in names]).alias("__in"))
    last = neighbours(held, group, ["at"], ["__in"], "__before", **split)
    turns = last.filter(F.col("__in") != F.coalesce(F.col("__before.__in"), F.lit(False))).drop("__before")
    closed = neighbours(turns, group, ["at"], ["at"], "__next", following=True, **split)
    return closed.filter("__in").select(*group, F.col("at").alias("low"), (F.col("__next.at") - 1).alias("high"))


def positions_to_set(positions: DataFrame, by: Sequence[str] = (), server: str = "server", seq: str = "seq", **split) -> DataFrame:
    """The set of single positions. A position with a neighbour on both sides is dropped before anything is ordered."""
    group = [*by, "server"]
    rows = positions.filter(F.col(server).isNotNull() & F.col(seq).isNotNull()).select(
        *by, F.col(server).alias("server"), F.col(seq).cast("long").alias("at"))
    sides = F.explode(F.array(F.struct(F.col("at"), F.lit(1).alias("own"), F.lit(0).alias("left")),
                              F.struct((F.col("at") + 1).alias("at"), F.lit(0).alias("own"), F.lit(1).alias("left"))))
    met = rows.select(*group, sides.alias("s")).groupBy(*group, F.col("s.at").alias("at")).agg(F.max("s.own").alias("own"), F.max("s.left").alias("left"))
    turns = met.filter("own <> left")
    closed = neighbours(turns, group, ["at"], ["at"], "__next", following=True, **split)
    return closed.filter("own = 1").select(*group, F.col("at").alias("low"), (F.col("__next.at") - 1).alias("high"))


def union(a: DataFrame, b: DataFrame, by: Sequence[str] = (), **split) -> DataFrame:
    return _sweep([a, b], by, lambda x, y: x + y > 0, **split)


def difference(a: DataFrame, b: DataFrame, by: Sequence[str] = (), **split) -> DataFrame:
    """Positions of ``a`` that ``b`` does not hold."""
    return _sweep([a, b], by, lambda x, y: (x > 0) & (y == 0), **split)


def intersection(a: DataFrame, b: DataFrame, by: Sequence[str] = (), **split) -> DataFrame:
    return _sweep([a, b], by, lambda x, y: (x > 0) & (y > 0), **split)


def normalized(a: DataFrame, by: Sequence[str] = (), **split) -> DataFrame:
    """The same set in as few intervals as it has."""
    return _sweep([a], by, lambda x: x > 0, **split)


def missing_from(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """By group of ``a``: its positions, how many of them ``b`` lacks, and whether ``b`` contains all."""
    count = lambda df, name: df.groupBy(*by).agg(F.sum(F.col("high") - F.col("low") + 1).alias(name))
    held, lost = count(normalized(a, by), "positions"), count(difference(a, b, by), "missing")
    rows = held.withColumn("missing", F.lit(0).cast("long")).unionByName(lost.withColumn("positions", F.lit(0).cast("long")))
    return rows.groupBy(*by).agg(F.sum("positions").alias("positions"), F.sum("missing").alias("missing")).withColumn(
        "contained", F.col("missing") == 0)


def set_text(a: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One text per group, as servers write it: ``server:1-5:7`` by server name, joined by commas."""
    part = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("-", "low", "high"))
    servers = a.groupBy(*by, "server").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("low", part.alias("part")))), lambda x: x["part"]), ":").alias("parts"))
    return servers.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "server", "parts"))), ",").alias("positions"))


def not_executed(
    events: DataFrame, executed: DataFrame, server: str = "server", seq: str = "seq", limit: int = FEW_INTERVALS, **split,
) -> DataFrame:
    """Events whose position ``executed`` does not hold: what is left to do after a failover.

    A set of few intervals is broadcast as one sorted list per server. A larger one is merged into the order of the events.
    """
    held = normalized(executed, **split)
    few = bounded(held, limit)
    if few is not None:
        lists = few.groupBy(F.col("server").alias("__server")).agg(F.collect_list(F.struct("low", "high")).alias("__held"))
        met = events.join(F.broadcast(lists), F.col(server) == F.col("__server"), "left")
        inside = F.exists("__held", lambda i: (i["low"] <= F.col(seq)) & (F.col(seq) <= i["high"]))
        return met.filter(~F.coalesce(inside, F.lit(False))).select(*events.columns)
    marks = held.select(F.col("server").alias(server), (-F.col("low")).alias("__back"), F.lit(1).alias("__rank"), F.col("high").alias("__mark"))
    merged = events.withColumns({"__back": -F.col(seq), "__rank": F.lit(0)}).unionByName(marks, allowMissingColumns=True)
    # Backwards, the next interval is the one that begins last at or before the event.
    met = next_value(merged, [server], ["__back", "__rank"], "__mark", "__high", **split)
    return met.filter(F.col("__mark").isNull() & (F.col("__high").isNull() | F.col(seq).isNull() | (F.col(seq) > F.col("__high")))).select(*events.columns)
