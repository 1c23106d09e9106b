"""Differences and masks on nested documents, by a walk over their type when the plan is built.

A path is written with dots, and with ``[]`` for the elements of a list: ``customer.address.zip``, ``items[].card``. In a difference
the elements have their places: ``items[2].price``. Documents that come as JSON text get the type of all of them first.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Mask = Callable[[Column], Column]


def document_type(df: DataFrame, *columns: str) -> T.StructType:
    """One type that holds every document of the JSON text columns; text that is no JSON counts nowhere. One pass, partial results."""
    rows = None
    for c in columns:
        one = df.select(F.try_parse_json(c).alias("v"))
        rows = one if rows is None else rows.unionByName(one)
    found = rows.agg(F.schema_of_variant_agg("v").alias("s")).first()["s"]
    # Variant types are named differently: OBJECT<...> is a struct.
    kind = T._parse_datatype_string(found.replace("OBJECT<", "STRUCT<")) if found and "<" in found else T.StructType([])
    return kind if isinstance(kind, T.StructType) else T.StructType([])


def parsed(df: DataFrame, kind: T.StructType, *columns: str) -> DataFrame:
    return df.withColumns({c: F.from_json(c, kind) for c in columns})


def _changed(b: Column, a: Column, kind: T.DataType, path: Column) -> Column:
    """Array of the paths below ``path`` whose values differ. A missing level is a level of NULLs."""
    if isinstance(kind, T.StructType):
        parts = [_changed(b[f.name], a[f.name], f.dataType, F.concat(path, F.lit("." + f.name))) for f in kind.fields]
        return F.flatten(F.array(*parts)) if parts else F.array().cast("array<string>")
    if isinstance(kind, T.ArrayType):
        length = F.greatest(F.coalesce(F.size(b), F.lit(0)), F.coalesce(F.size(a), F.lit(0)), F.lit(0))
        places = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
        within = F.flatten(F.transform(places, lambda i: _changed(
            F.get(b, i), F.get(a, i), kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        # An element of NULLs alone has no path that differs, so the list itself is named where its length is all that changed.
        longer = F.coalesce(F.size(b), F.lit(-1)) != F.coalesce(F.size(a), F.lit(-1))
        return F.when((F.size(within) == 0) & longer, F.array(path)).otherwise(within)
    same = b.eqNullSafe(a) if not isinstance(kind, T.MapType) else F.to_json(b).eqNullSafe(F.to_json(a))
    return F.when(same, F.array().cast("array<string>")).otherwise(F.array(path))


def diff_nested(before: Column, after: Column, kind: T.StructType) -> Column:
    """Sorted dotted paths of the values that differ; none where an image is absent."""
    parts = [_changed(before[f.name], after[f.name], f.dataType, F.lit(f.name)) for f in kind.fields]
    found = F.array_sort(F.flatten(F.array(*parts))) if parts else F.array().cast("array<string>")
    return F.when(before.isNull() | after.isNull(), F.array().cast("array<string>")).otherwise(found)


def mask_nested(value: Column, kind: T.DataType, masks: Mapping[str, Mask], path: str = "") -> Column:
    """The document with ``masks`` applied at their paths, also in every element of a list. Missing levels stay missing, NULL stays
    NULL, and only documents that hold a masked path are rebuilt. A path that the type doesn't hold is an error."""
    if not path:
        unknown = set(masks) - set(paths_of(kind))
        if unknown:
            raise ValueError(f"no such path: {sorted(unknown)}")
    if path in masks:
        return F.when(value.isNotNull(), masks[path](value))
    if not any(m.startswith(path) for m in masks):
        return value
    if isinstance(kind, T.StructType):
        fields = [mask_nested(value[f.name], f.dataType, masks, f"{path}.{f.name}" if path else f.name).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: mask_nested(v, kind.elementType, masks, f"{path}[]"))
    return value


def paths_of(kind: T.DataType, path: str = "") -> list[str]:
    """All paths of a type that a mask may name: values, and the elements of lists of values."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths_of(f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, f"{path}[]")
    return [path]
