"""The order of changes from several servers of one cluster.

Sequence numbers are compared within a stream (a MySQL server, a MariaDB domain). Across streams the order is that
of arrival: a transaction counts from its first arrival, so one that is delivered again after a failover keeps its
place, and a late one joins the part of its stream that its number belongs to. What results is ``(epoch, seq)``,
where an epoch is a stretch of one stream that no other interrupts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import bounded, neighbours, next_value, row_numbers, running

FEW_EPOCHS = 10_000


def mixed(log: DataFrame, by: Sequence[str], stream: str = "server") -> DataFrame:
    """The groups (``by``) whose changes come from more than one stream."""
    return log.groupBy(*by).agg(F.min(stream).alias("__low"), F.max(stream).alias("__high")).filter("__low <> __high").select(*by)


def epochs(
    log: DataFrame, by: Sequence[str], stream: str = "server", seq: str = "seq", arrival: str = "arrival", **split,
) -> DataFrame:
    """(by, stream, from_seq, epoch): where in its stream each epoch begins.

    Transactions are reduced to one row before they are ordered. Only those that carry their stream on make an epoch.
    """
    by = list(by)
    known = log.filter(F.col(stream).isNotNull() & F.col(seq).isNotNull())
    first = known.groupBy(*by, stream, seq).agg(F.min(arrival).alias("__arrival"))
    seen = running(first, [*by, stream], ["__arrival", seq], {"__most": (F.max, seq)}, before=True, **split)
    ahead = seen.filter(F.col("__most").isNull() | (F.col(seq) > F.col("__most"))).drop("__most")
    order = ["__arrival", stream, seq]
    last = neighbours(ahead, by, order, [stream], "__before", **split)
    starts = last.filter(F.col("__before").isNull() | (F.col(f"__before.{stream}") != F.col(stream))).drop("__before")
    return row_numbers(starts, by, order, "epoch", **split).select(*by, stream, F.col(seq).alias("from_seq"), "epoch")


def with_epoch(
    log: DataFrame, starts: DataFrame, by: Sequence[str], stream: str = "server", seq: str = "seq", limit: int = FEW_EPOCHS, **split,
) -> DataFrame:
    """Adds ``epoch``: that of the last start at or before the number of an event in its stream, or of the first one.

    Few epochs are broadcast as one sorted list per stream. Many are merged into the order of the events.
    """
    by = list(by)
    few = bounded(starts, limit)
    if few is not None:
        lists = few.groupBy(*by, stream).agg(F.sort_array(F.collect_list(F.struct("from_seq", "epoch"))).alias("__starts"))
        upto = F.filter("__starts", lambda s: s["from_seq"] <= F.col(seq))
        found = F.coalesce(F.try_element_at(upto, F.lit(-1)), F.get("__starts", 0))
        return log.join(F.broadcast(lists), [*by, stream], "left").withColumn("epoch", found["epoch"]).select(*log.columns, "epoch")
    back = -F.col("from_seq")
    first = starts.groupBy(*by, stream).agg(F.min_by("epoch", "from_seq").alias("epoch"), F.min("from_seq").alias("from_seq"))
    lowest = F.lit(2**63 - 1).cast(starts.select(back.alias("b")).schema["b"].dataType)
    marks = starts.withColumn("__back", back).unionByName(first.withColumn("__back", lowest)).select(
        *by, stream, "__back", F.lit(1).alias("__rank"), F.col("epoch").alias("__mark"))
    merged = log.withColumns({"__back": -F.col(seq), "__rank": F.lit(0)}).unionByName(marks, allowMissingColumns=True)
    met = next_value(merged, [*by, stream], ["__back", "__rank"], "__mark", "epoch", **split)
    return met.filter(F.col("__mark").isNull()).select(*log.columns, "epoch")


def failover_order(
    log: DataFrame, by: Sequence[str], stream: str = "server", seq: str = "seq", arrival: str | Column = "arrival", **split,
) -> DataFrame:
    """Adds ``pos``: (epoch, seq) as one value, in the order of the cluster. Refuses several streams without an arrival."""
    timed = log.withColumn("__arrived", F.col(arrival) if isinstance(arrival, str) else arrival)
    several = mixed(timed, by, stream)
    unknown = timed.filter(F.col("__arrived").isNull()).join(several, list(by), "left_semi").select(*by).limit(1).collect()
    if unknown:
        raise ValueError(f"several streams without an arrival in {unknown[0].asDict()}: their order is unknown")
    numbered = with_epoch(timed, epochs(timed, by, stream, seq, "__arrived", **split), by, stream, seq, **split)
    return numbered.withColumn("pos", F.struct("epoch", F.col(seq).alias("seq"))).drop("__arrived", "epoch")
