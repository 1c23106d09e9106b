"""Shapes of physical plans that matter at scale."""

import re

import pytest

from changeflow.operators import commit, materialize
from changeflow.plans import ORACLES, QUERIES
from changeflow.sources.fixtures import change_log, transactions

from .conftest import SF_DIR

WRITES = {"scan_change_log", "topic_sink", "apply_changes"}
BATCH = sorted(n for n in QUERIES if not n.startswith("stream") and n not in WRITES)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_joins_and_no_python_on_the_rows(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"):
        assert word not in plan, plan


STATELESS = ["smt_transform", "mask_image", "diff_fields", "wire_encode", "wire_decode", "route_topic", "parse_lsn", "parse_gtid",
             "parse_mssql_lsn", "dlq_split", "dlq_retry", "snapshot_initial", "decimal_to_double", "unwrap_schema_payload"]


@pytest.mark.parametrize("name", STATELESS)
def test_stateless_transforms_do_not_shuffle(spark, name):
    assert "Exchange" not in plan_of(QUERIES[name](spark, SF_DIR))


def test_snapshot_condition_reaches_the_scan(spark):
    plan = QUERIES["snapshot_condition"](spark, SF_DIR)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PushedFilters: \[.*GreaterThan\(o_totalprice,100000", plan)
    assert "o_orderdate" not in re.search(r"ReadSchema: (.*)", plan).group(1)


def test_commit_filter_does_not_shuffle_the_log(spark):
    log = change_log(spark, SF_DIR)
    plan = plan_of(commit.committed_only(log, transactions(log)).select("tbl", "pos", "after"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_state_shuffles_reduced_rows_once(spark):
    log = change_log(spark, SF_DIR)
    plan = plan_of(materialize.materialize(log, transactions(log)))
    assert plan.count("hashpartitioning(tbl") == 1 and "partial_max_by" in plan


def test_unused_columns_are_not_read(spark):
    plan = plan_of(QUERIES["chunk_plan"](spark, SF_DIR))
    assert re.findall(r"ReadSchema: (\S+)", plan) == ["struct<o_orderkey:bigint>"]


def test_registry():
    assert len(QUERIES) >= 100 and len(set(QUERIES) - set(ORACLES)) <= 2
