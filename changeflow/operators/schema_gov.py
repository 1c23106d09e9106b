"""Schema versions, differences, compatibility verdicts and reads across versions.

A registry is a long table: ``subject, version, field, type, has_default, default_value``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import join_small, row_numbers

AUTO_REGISTER, QUARANTINE = "AUTO_REGISTER", "QUARANTINE_DLQ"
REFERENCE, AVRO_BACKWARD = "reference", "avro_backward"
ADDED, DROPPED, ALTERED, SAME = "ADDED", "DROPPED", "ALTERED", "SAME"

# First schema id, and the type promotions that keep old data readable.
FIRST_SCHEMA_ID = 43
WIDENINGS = (
    ("int", "long"), ("int", "float"), ("int", "double"), ("long", "float"), ("long", "double"), ("float", "double"),
)


def is_widening(old: Column, new: Column) -> Column:
    """True for a promotion of the fixed matrix; as a literal list it needs no join."""
    return F.concat_ws(">", old, new).isin([f"{a}>{b}" for a, b in WIDENINGS])


def schema_diff(registry: DataFrame) -> DataFrame:
    """Each field of each version compared with the version before it; numbers may have gaps.

    Both roles of a field row meet in one grouping. The versions that follow are as many as the registry has, so they are
    merged with it: Spark would take the size of the files below for theirs, and send the whole registry through the driver.
    """
    new = registry.select("subject", "version", "field", F.lit(True).alias("is_new"), "type", "has_default")
    following = registry.select("subject", "version").distinct().withColumn(
        "next", F.lead("version").over(Window.partitionBy("subject").orderBy("version")))
    old = registry.join(following.filter("next IS NOT NULL").hint("merge"), ["subject", "version"]).select(
        "subject", F.col("next").alias("version"), "field", F.lit(False).alias("is_new"), "type", "has_default")
    pick = lambda col, role: F.max(F.when(F.col("is_new") == role, F.col(col)))
    fields = new.unionByName(old).groupBy("subject", "version", "field").agg(
        pick("type", False).alias("old_type"), pick("type", True).alias("new_type"),
        pick("has_default", True).alias("has_default"))
    per_version = Window.partitionBy("subject", "version")
    exists = F.count("new_type").over(per_version) > 0
    has_previous = F.count("old_type").over(per_version) > 0
    change = (
        F.when(F.col("old_type").isNull(), ADDED).when(F.col("new_type").isNull(), DROPPED)
        .when(F.col("old_type") != F.col("new_type"), ALTERED).otherwise(SAME))
    return (
        fields.withColumns({"__keep": exists & has_previous, "change": change}).filter("__keep").drop("__keep")
        .withColumn("widening", F.when(F.col("change") == ALTERED, is_widening(F.col("old_type"), F.col("new_type")))))


def incompatible(policy: str = REFERENCE, check_added_defaults: bool = True, check_types: bool = True) -> Column:
    """Condition on a ``schema_diff`` row.

    ``reference`` quarantines every dropped field; ``avro_backward`` lets a reader ignore it.
    """
    bad = (F.col("change") == ALTERED) & ~F.col("widening") if check_types else F.lit(False)
    if policy == REFERENCE:
        bad = bad | (F.col("change") == DROPPED)
    elif policy != AVRO_BACKWARD:
        raise ValueError(f"unknown policy {policy!r}")
    if check_added_defaults:
        bad = bad | ((F.col("change") == ADDED) & ~F.coalesce("has_default", F.lit(False)))
    return bad


def compatible(policy: str = REFERENCE, check_added_defaults: bool = True, check_types: bool = True) -> Column:
    """Verdict over the ``schema_diff`` rows of a version, so that several policies can be judged in one grouping."""
    return ~F.bool_or(incompatible(policy, check_added_defaults, check_types))


def schema_compat(
    diff: DataFrame, policy: str = REFERENCE, check_added_defaults: bool = True, check_types: bool = True,
) -> DataFrame:
    """Verdict per subject and version, with the fields behind it."""
    listed = lambda change: F.array_sort(F.collect_list(F.when(F.col("change") == change, F.col("field"))))
    return diff.groupBy("subject", "version").agg(
        compatible(policy, check_added_defaults, check_types).alias("compatible"),
        listed(ADDED).alias("added_fields"), listed(ALTERED).alias("altered_fields"), listed(DROPPED).alias("dropped_fields"),
    ).withColumn("policy_action", F.when(F.col("compatible"), AUTO_REGISTER).otherwise(QUARANTINE))


def schema_verdicts(registry: DataFrame, policy: str = REFERENCE, check_added_defaults: bool = True) -> DataFrame:
    """(subject, version, compatible) of every registered version; the first of a subject is compatible."""
    judged = schema_compat(schema_diff(registry), policy, check_added_defaults).select("subject", "version", "compatible")
    first = registry.groupBy("subject").agg(F.min("version").alias("version")).withColumn("compatible", F.lit(True))
    return judged.unionByName(first)


def quarantine_split(
    events: DataFrame, verdicts: DataFrame, on: Sequence[str] = ("subject", "version"),
) -> DataFrame:
    """Adds ``route``: ``main`` for events written under a schema known as compatible, else ``dlq``."""
    known = verdicts.filter("compatible").select(*on, F.lit(True).alias("__good"))
    joined = join_small(events, known, on, "left")
    return joined.withColumn("route", F.when(F.col("__good"), "main").otherwise("dlq")).drop("__good")


def schema_versions(
    observed: DataFrame, subject: str, fingerprint: str, pos: str, first_id: int = FIRST_SCHEMA_ID, **split,
) -> DataFrame:
    """Version per distinct schema of a subject in order of first use, and a dense schema id.

    Numbering runs over the distinct schemas only.
    """
    distinct = observed.groupBy(subject, fingerprint).agg(F.min(pos).alias("first_pos"))
    versioned = row_numbers(distinct, [subject], ["first_pos", fingerprint], "version", **split)
    numbered = row_numbers(versioned, [], ["first_pos", subject, fingerprint], "schema_id", **split)
    return numbered.withColumns({
        "version": F.col("version").cast("int"), "schema_id": F.col("schema_id") + F.lit(first_id - 1)})


def schema_drift(payloads: DataFrame, value: str, group: Sequence[str], registered: Sequence[str]) -> DataFrame:
    """Fields seen in JSON payloads but not registered, with the number of rows that carry them."""
    seen = payloads.select(*group, F.explode(F.json_object_keys(value)).alias("field"))
    return seen.filter(~F.col("field").isin(list(registered))).groupBy(*group, "field").agg(
        F.count(F.lit(1)).alias("rows"))


def schema_drift_windows(
    payloads: DataFrame, value: str, ts: str, registry: DataFrame, window: str = "1 day", subject: str = "subject",
) -> DataFrame:
    """Fields seen in JSON payloads that the newest registered version of their subject lacks, by subject and
    time window, with the rows that carry them. A subject that was never registered drifts in all fields."""
    newest = registry.groupBy(subject).agg(F.max("version").alias("version"))
    known = registry.join(newest, [subject, "version"], "left_semi").select(subject, "field").distinct()
    seen = payloads.select(subject, F.window(ts, window).getField("start").alias("window_start"), F.explode(F.json_object_keys(value)).alias("field"))
    counted = seen.groupBy(subject, "window_start", "field").agg(F.count(F.lit(1)).alias("rows"))
    return join_small(counted, known, [subject, "field"], "left_anti").select(subject, "window_start", "field", "rows")


def read_with_defaults(versions: Sequence[DataFrame], defaults: Mapping[str, object]) -> DataFrame:
    """One table from files of several schema versions; columns a version lacks take their default.

    A NULL written by a version that has the column stays NULL.
    """
    out = None
    for df in versions:
        df = df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def rename_columns(df: DataFrame, history: Mapping[str, str]) -> DataFrame:
    """Applies renames (old name to new name), following chains of renames."""
    final = {}
    for old in history:
        new, seen = history[old], {old}
        while new in history and new not in seen:
            seen.add(new)
            new = history[new]
        final[old] = new
    return df.withColumnsRenamed({o: n for o, n in final.items() if o in df.columns})


def ddl_events(log: DataFrame, tbl: str = "tbl", op: str = "op", pos: str = "pos") -> DataFrame:
    """Schema-history rows of DDL events, keyed by subject."""
    return log.filter(F.col(op).startswith("DDL")).select(
        F.concat(F.col(tbl), F.lit("-value")).alias("subject"), op, pos,
        F.when(F.col(op) == "DDL_DROP_COL", "DLQ_QUARANTINE").otherwise("SCHEMA_EVOLVED").alias("status"))


def schema_lookup(messages: DataFrame, registry: DataFrame, schema_id: str = "schema_id") -> DataFrame:
    """Adds ``known`` and the registry columns for the schema id of a decoded message."""
    rows = registry.withColumn("known", F.lit(True))
    joined = join_small(messages, rows, [schema_id], "left")
    return joined.withColumn("known", F.coalesce("known", F.lit(False)))


