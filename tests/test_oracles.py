"""Each registered query against its SQL on the same files."""

import pytest

from changeflow.plans import ORACLES, QUERIES

from .conftest import SF_DIR
from .oracle import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name not in ORACLES:
        assert df.count() > 0
        return
    ok, note = compare(df, con, ORACLES[name])
    assert ok, note


def test_known_counts(spark, con):
    got = {r["tbl"]: (r["n"], r["s"]) for r in QUERIES["materialize_table"](spark, SF_DIR)
           .groupBy("tbl").agg({"key_id": "count", "amount_cents": "sum"})
           .withColumnsRenamed({"count(key_id)": "n", "sum(amount_cents)": "s"}).collect()}
    assert got == {"orders": (1415, 35216729739), "staging_orders": (8, 170536635)}


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
