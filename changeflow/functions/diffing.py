"""Field-level differences between two row images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _empty(image: Column) -> Column:
    return image.isNull() | (F.size(image) == 0)


def diff_fields(before: Column, after: Column) -> Column:
    """Sorted names of the fields whose values differ, over the union of keys of two map images.

    A missing key equals NULL. An absent or empty image gives an empty list.
    """
    keys = F.array_union(F.map_keys(before), F.map_keys(after))
    changed = F.filter(keys, lambda k: ~F.try_element_at(before, k).eqNullSafe(F.try_element_at(after, k)))
    return F.when(_empty(before) | _empty(after), F.array().cast("array<string>")).otherwise(F.array_sort(changed))


def diff_struct(before: Column, after: Column, fields: Sequence[str]) -> Column:
    """Typed form for struct images with the same fields; values are compared by type."""
    changed = F.array_compact(F.array(*[
        F.when(~before[f].eqNullSafe(after[f]), F.lit(f)) for f in sorted(fields)
    ]))
    return F.when(before.isNull() | after.isNull(), F.array().cast("array<string>")).otherwise(changed)


def both_present(before: Column, after: Column) -> Column:
    """True when a transform chain reports a diff at all: both images hold fields."""
    return ~(_empty(before) | _empty(after))
