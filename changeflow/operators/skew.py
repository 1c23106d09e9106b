"""Joins and ordered computations that stay balanced when one key holds a large share of the rows.

``hot_hashes`` counts the rows of every key with one column-pruned scan and names the keys that exceed
what one task should take. When there are none, callers build the plain plan. Otherwise

* ``skew_join`` salts the rows of the hot keys over many tasks and repeats only the matching hot
  rows of the other side;
* ``row_numbers``, ``running``, ``neighbours``, ``next_value`` and ``previous_value`` cut each hot group into ordered segments, compute
  inside every segment, and carry one row per segment across the borders.

The counts decide only where rows are computed, never what is computed: NULL groups, text or NULL
order columns and ties give the same rows with and without segments.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import accumulate
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS = 5_000_000
SALTS = 64
SEGMENT_ROWS = 1_000_000
MAX_SEGMENTS = 100_000  # of all hot groups together; segments grow with the rows beyond that
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 2**20

_SAMPLES = 40  # rows looked at per segment to place its border
_FEW_CUTS = 256  # borders that are searched in one list, which is copied with every row
_HASH, _SALT, _SEG, _CUTS, _TIE, _PART = "__hash", "__salt", "__seg", "__cuts", "__tie", "__part"


def _hash(cols: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols]) if cols else F.lit(0).cast("long")


def _hashable(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]


def _tied(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` and its order with a hash of the whole row last: ties get one order, and can be cut like other rows."""
    return df.withColumn(_TIE, _hash(_hashable(df))), [*order, _TIE]


def _hot_counts(df: DataFrame, cols: Sequence[str], hot_rows: int) -> dict[int, int]:
    """Rows per hash of the hot keys; there are at most as many as all rows over ``hot_rows``."""
    counts = df.select(_hash(cols).alias(_HASH)).groupBy(_HASH).agg(F.count(F.lit(1)).alias("n"))
    return {r[_HASH]: r["n"] for r in counts.filter(F.col("n") > hot_rows).collect()}


def hot_hashes(df: DataFrame, cols: Sequence[str], hot_rows: int = HOT_ROWS) -> list[int]:
    """Hashes of the ``cols`` values held by more than ``hot_rows`` rows.

    A hash shared by two values only means that one more group is split.
    """
    return list(_hot_counts(df, cols, hot_rows))


def _fixed_width(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_fixed_width(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.VariantType))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame | None:
    """``df`` as a local frame when it has at most ``rows`` rows and ``size`` bytes, else None.

    Rows of fixed width are bounded by their number. Others are measured on the executors first.
    """
    few = df.limit(rows + 1)
    wide = [f.name for f in df.schema.fields if not _fixed_width(f.dataType)]
    if wide:
        text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in wide]))
        found = few.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
        if found["n"] > rows or (found["bytes"] or 0) > size:
            return None
    small = few.toArrow()
    return None if small.num_rows > rows or small.nbytes > size else df.sparkSession.createDataFrame(small, df.schema)


def join_small(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
    limit: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS, hot: Sequence[int] | None = None,
) -> DataFrame:
    """Join with a side expected to be small: broadcast after its size was checked, else shuffle.

    A side found too large is merged by a hint, or Spark may broadcast it all the same by its own estimate.
    """
    small = bounded(right, limit)
    if small is None:
        return skew_join(left, right.hint("merge"), on, how, hot_rows=hot_rows, hot=hot)
    return left.join(F.broadcast(small), list(on), how)


def skew_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
    hot_rows: int = HOT_ROWS, salts: int = SALTS, hot: Sequence[int] | None = None,
) -> DataFrame:
    """Join a large left side, skewed on ``on``, with a right side of few rows per key.

    ``how`` is inner, left, left_semi or left_anti. ``hot`` may pass hashes known from before.
    """
    on = list(on)
    if hot is None:
        hot = hot_hashes(left, on, hot_rows)
    if not hot:
        return left.join(right, on, how)
    is_hot = _hash(on).isin(list(hot))
    spread = _hashable(left)
    # The partition id spreads identical rows too, and is the same again when a task is repeated.
    salt = F.pmod(F.xxhash64(F.lit(7), *spread) + F.spark_partition_id(), F.lit(salts)).cast("int")
    salted = left.withColumn(_SALT, F.when(is_hot, salt).otherwise(0))
    copies = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    return salted.join(right.withColumn(_SALT, copies), [*on, _SALT], how).drop(_SALT)


def _segment_of(value: Column, cuts: Column, longest: int) -> Column:
    """Number of cut points not above ``value``, by binary search."""
    step, steps = 1, []
    while step <= longest:
        steps.append(step)
        step *= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in reversed(steps)]), F.lit(0),
        lambda low, s: F.when(F.get(cuts, low + s - 1) <= value, low + s).otherwise(low))


def _parts(cuts: pa.Table, width: int) -> tuple[pa.Table, pa.Table]:
    """The lists of ``cuts`` in parts of ``width`` borders, numbered, and for each hash the first borders of its parts."""
    lists = cuts.column(_CUTS).combine_chunks()
    values, sizes = lists.flatten(), [len(x) for x in lists]
    ends = list(accumulate(sizes, initial=0))
    starts = [list(range(end, end + size, width)) for end, size in zip(ends, sizes)]
    flat = [i for s in starts for i in s]
    ints = lambda rows: pa.array(rows, pa.int32())
    first = pa.ListArray.from_arrays(ints(list(accumulate(map(len, starts), initial=0))), values.take(ints(flat)))
    parts = pa.table({
        _HASH: cuts.column(_HASH).combine_chunks().take(ints([g for g, s in enumerate(starts) for _ in s])),
        _PART: ints([i for s in starts for i in range(1, len(s) + 1)]), _CUTS: pa.ListArray.from_arrays(ints([*flat, ends[-1]]), values)})
    return pa.table({_HASH: cuts.column(_HASH), _CUTS: first}), parts


def _segmented(
    df: DataFrame, group: Sequence[str], order: Sequence[str], hot_rows: int, segment_rows: int,
) -> tuple[DataFrame, bool]:
    """``df`` with a segment column: -1 for normal groups, an ordered number for hot ones.

    Each hot group is cut at rows of its own: a sample by hash of the order columns, of which every so
    manieth is a border. Borders compare as the order itself does, whatever its types.
    """
    hot = _hot_counts(df, group, hot_rows)
    segment_rows = max(segment_rows, -(-sum(hot.values()) // MAX_SEGMENTS))
    if not any(n > segment_rows for n in hot.values()):
        return df.withColumn(_SEG, F.lit(-1)), False
    spark, place = df.sparkSession, F.struct(*order)
    names = spark.createDataFrame([(h,) for h in hot], f"{_HASH} long")
    rate = max(1, segment_rows // _SAMPLES)
    sample = df.select(_hash(group).alias(_HASH), place.alias("place")).join(F.broadcast(names), _HASH).filter(
        F.pmod(F.xxhash64(F.lit(3), "place"), F.lit(rate)) == 0)
    along = Window.partitionBy(_HASH).orderBy("place")
    borders = sample.distinct().withColumn("i", F.row_number().over(along)).filter(F.col("i") % _SAMPLES == 0)
    cuts = borders.groupBy(_HASH).agg(F.sort_array(F.collect_list("place")).alias(_CUTS)).toArrow()
    if not cuts.num_rows:
        return df.withColumn(_SEG, F.lit(-1)), False
    longest = max(len(c) for c in cuts.column(_CUTS))
    lists = T.StructField(_CUTS, T.ArrayType(sample.schema["place"].dataType))
    kind, part = T.StructField(_HASH, T.LongType()), T.StructField(_PART, T.IntegerType())
    marked = df.withColumn(_HASH, _hash(group))
    if longest <= _FEW_CUTS:
        cuts = spark.createDataFrame(cuts, T.StructType([kind, lists]))
        segment = F.when(F.col(_CUTS).isNotNull(), _segment_of(place, F.col(_CUTS), longest)).otherwise(-1)
        return marked.join(F.broadcast(cuts), _HASH, "left").withColumn(_SEG, segment).select(*df.columns, _SEG), True
    # A long list would be copied with every row: first the part of it, then the place in that part.
    width = isqrt(longest - 1) + 1
    first, parts = _parts(cuts, width)
    first = spark.createDataFrame(first, T.StructType([kind, lists]))
    parts = spark.createDataFrame(parts, T.StructType([kind, part, lists]))
    found = F.when(F.col(_CUTS).isNotNull(), _segment_of(place, F.col(_CUTS), -(-longest // width)))
    placed = marked.join(F.broadcast(first), _HASH, "left").withColumn(_PART, found).select(*df.columns, _HASH, _PART)
    inside = (F.col(_PART) - 1) * width + _segment_of(place, F.col(_CUTS), width)
    segment = F.when(F.col(_PART).isNull(), -1).when(F.col(_PART) == 0, 0).otherwise(inside)
    return placed.join(F.broadcast(parts), [_HASH, _PART], "left").withColumn(_SEG, segment).select(*df.columns, _SEG), True


def _carried(rows: DataFrame, carry: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Adds ``value`` of ``carry``, one row per group and segment, also where the group is NULL."""
    small = carry.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col(_SEG).alias("__gs"), value)
    same = F.col(_SEG) == F.col("__gs")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return rows.join(F.broadcast(small), same, "left")


def row_numbers(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str,
    hot_rows: int = HOT_ROWS, segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """``row_number()`` per group; NULL is a group.

    ``group`` may be empty: one numbering over everything, still computed in segments.
    """
    group, columns = list(group), df.columns
    df, order = _tied(df, order)
    marked, split = _segmented(df, group, order, hot_rows, segment_rows)
    numbered = marked.withColumn(name, F.row_number().over(Window.partitionBy(*group, _SEG).orderBy(*order)).cast("long"))
    if not split:
        return numbered.drop(_SEG, _TIE)
    before = Window.partitionBy(*group).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    base = (
        marked.filter(F.col(_SEG) >= 0).groupBy(*group, _SEG).agg(F.count(F.lit(1)).alias("__n"))
        .select(*group, _SEG, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    )
    return (
        _carried(numbered, base, group, "__base")
        .withColumn(name, F.col(name) + F.coalesce(F.col("__base"), F.lit(0)))
        .select(*columns, name)
    )


def running(
    df: DataFrame, group: Sequence[str], order: Sequence[str], values: Mapping[str, tuple[Callable[[str], Column], str]],
    before: bool = False, hot_rows: int = HOT_ROWS, segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Adds running aggregates: ``values`` maps a new name to an aggregate that can be taken of its own parts
    (``F.sum``, ``F.max``, ``F.min``) and its column. ``before`` leaves the row itself out.

    Rows that tie in ``order`` have an order all the same. NULL where nothing came before.
    """
    group, columns = list(group), df.columns
    df, order = _tied(df, order)
    marked, split = _segmented(df, group, order, hot_rows, segment_rows)
    local = Window.partitionBy(*group, _SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    here = marked.withColumns({name: f(c).over(local) for name, (f, c) in values.items()})
    if not split:
        return here.drop(_SEG, _TIE)
    along = Window.partitionBy(*group).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.filter(F.col(_SEG) >= 0).groupBy(*group, _SEG).agg(*[f(c).alias(name) for name, (f, c) in values.items()])
    carry = sums.select(*group, _SEG, F.struct(*[f(name).over(along).alias(name) for name, (f, _) in values.items()]).alias("__base"))
    met = _carried(here, carry, group, "__base")
    pair = lambda name: F.filter(F.array(F.col(name), F.col("__base")[name]), lambda x: x.isNotNull())
    folds = {F.sum: lambda x, y: x + y, F.max: lambda x, y: F.greatest(x, y), F.min: lambda x, y: F.least(x, y)}
    both = {name: F.aggregate(F.slice(pair(name), 2, 1), F.get(pair(name), 0), folds[f]) for name, (f, _) in values.items()}
    return met.withColumns(both).select(*columns, *values)


def neighbours(
    df: DataFrame, group: Sequence[str], order: Sequence[str], values: Sequence[str], name: str,
    following: bool = False, hot_rows: int = HOT_ROWS, segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Adds ``name``: a struct of ``values`` from the previous (or following) row of the group.

    The struct is NULL on the first (last) row. Same conditions as ``row_numbers``.
    """
    group, columns = list(group), df.columns
    df, order = _tied(df, order)
    marked, split = _segmented(df, group, order, hot_rows, segment_rows)
    local = Window.partitionBy(*group, _SEG).orderBy(*order)
    shift = F.lead if following else F.lag
    payload = F.struct(*values)
    shifted = marked.withColumn(name, shift(payload).over(local))
    if not split:
        return shifted.drop(_SEG, _TIE)
    edge = F.min_by if following else F.max_by
    across = Window.partitionBy(*group).orderBy(_SEG)
    carry = (
        marked.filter(F.col(_SEG) >= 0).groupBy(*group, _SEG)
        .agg(edge(payload, F.struct(*order)).alias("__edge"))
        .select(*group, _SEG, shift("__edge").over(across).alias("__carry"))
    )
    return (
        _carried(shifted, carry, group, "__carry")
        .withColumn(name, F.coalesce(name, "__carry"))
        .select(*columns, name)
    )


def next_value(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str,
    hot_rows: int = HOT_ROWS, segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Adds ``name``: the nearest non-NULL ``value`` on a later row of the group.

    Same conditions as ``row_numbers``. Rows are visited backwards, so frames only grow.
    """
    group, columns = list(group), df.columns
    df, order = _tied(df, order)
    marked, split = _segmented(df, group, order, hot_rows, segment_rows)
    growing = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    backwards = growing(Window.partitionBy(*group, _SEG).orderBy(*[F.col(c).desc() for c in order]))
    filled = marked.withColumn(name, F.last(value, ignorenulls=True).over(backwards))
    if not split:
        return filled.drop(_SEG, _TIE)
    across = growing(Window.partitionBy(*group).orderBy(F.col(_SEG).desc()))
    first = F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    carry = (
        marked.filter(F.col(_SEG) >= 0).groupBy(*group, _SEG).agg(first.alias("__first"))
        .select(*group, _SEG, F.last("__first", ignorenulls=True).over(across).alias("__carry"))
    )
    return (
        _carried(filled, carry, group, "__carry")
        .withColumn(name, F.coalesce(name, "__carry"))
        .select(*columns, name)
    )


def previous_value(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str,
    hot_rows: int = HOT_ROWS, segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Adds ``name``: the nearest non-NULL ``value`` on an earlier row of the group.

    Same conditions as ``row_numbers``.
    """
    group, columns = list(group), df.columns
    df, order = _tied(df, order)
    marked, split = _segmented(df, group, order, hot_rows, segment_rows)
    growing = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    filled = marked.withColumn(name, F.last(value, ignorenulls=True).over(growing(Window.partitionBy(*group, _SEG).orderBy(*order))))
    if not split:
        return filled.drop(_SEG, _TIE)
    last = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    carry = (
        marked.filter(F.col(_SEG) >= 0).groupBy(*group, _SEG).agg(last.alias("__last"))
        .select(*group, _SEG, F.last("__last", ignorenulls=True).over(growing(Window.partitionBy(*group).orderBy(_SEG))).alias("__carry")))
    return _carried(filled, carry, group, "__carry").withColumn(name, F.coalesce(name, "__carry")).select(*columns, name)
