"""A registry grows with its subjects: it is compared, judged and met by its events without going through the driver."""

import pytest
from pyspark.sql import functions as F

from changeflow.operators import schema_gov, skew
from changeflow.plans import QUERIES
from changeflow.plans import schemas


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Twelve parts, two of each kind of change, and a line for each of them."""
    folder = str(tmp_path_factory.mktemp("registry"))
    spark.range(12).select(F.col("id").alias("p_partkey")).write.parquet(f"{folder}/part.parquet")
    spark.range(24).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"), (F.col("id") % 12).alias("l_partkey")).write.parquet(
        f"{folder}/lineitem.parquet")
    return folder


def joins(df):
    """The joins of the plan that was made before anything is known of sizes."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [kind for kind in ("BroadcastExchange", "SortMergeJoin") if kind in plan]


@pytest.mark.parametrize("name", ["schema_diff", "schema_compat", "added_default_check", "schema_compat_policies", "type_widening"])
def test_a_registry_is_not_broadcast(spark, tables, name):
    assert joins(QUERIES[name](spark, tables)) == ["SortMergeJoin"]


@pytest.mark.parametrize("name", ["schema_quarantine", "schema_quarantine_gaps"])
def test_verdicts_beyond_the_limit_are_not_broadcast(spark, tables, name, monkeypatch):
    """Twelve subjects, where a join takes five rows as few."""
    want = sorted(map(tuple, QUERIES[name](spark, tables).collect()))
    small = skew.join_small
    monkeypatch.setattr(schema_gov, "join_small", lambda *args, **how: small(*args, **how, limit=5))
    got = QUERIES[name](spark, tables)
    assert joins(got) == ["SortMergeJoin"] and len(want) == 24
    assert sorted(map(tuple, got.collect())) == want


def test_policies_in_one_grouping_equal_each_of_them(spark, tables):
    diff = schema_gov.schema_diff(schemas.registry(spark, tables))
    one = lambda **policy: {(r["subject"], r["version"]): r["compatible"] for r in schema_gov.schema_compat(diff, **policy).collect()}
    both = QUERIES["schema_compat_policies"](spark, tables).collect()
    assert {(r[0], r[1]): r["parity_compatible"] for r in both} == one(check_added_defaults=False, check_types=False)
    assert {(r[0], r[1]): r["avro_compatible"] for r in both} == one(policy=schema_gov.AVRO_BACKWARD)
    assert len(both) == 12 and {(r["parity_compatible"], r["avro_compatible"]) for r in both} == {(True, True), (True, False), (False, True)}


def test_unknown_subjects_and_versions_have_no_difference(spark):
    """Versions 1 and 3; rows without a subject or a version are compared with nothing, and a field named twice is one."""
    rows = [("s", 1, "a", "int", False), ("s", 1, "a", "int", False), ("s", 3, "a", "long", False), ("s", 3, "b", "int", None),
            ("s", None, "a", "int", False), (None, 1, "a", "int", False), (None, 2, "a", "long", False)]
    diff = schema_gov.schema_diff(spark.createDataFrame(rows, "subject string, version int, field string, type string, has_default boolean"))
    got = {(r["subject"], r["version"], r["field"], r["change"], r["widening"]) for r in diff.collect()}
    assert got == {("s", 3, "a", "ALTERED", True), ("s", 3, "b", "ADDED", None)}
