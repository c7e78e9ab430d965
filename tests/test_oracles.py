"""Every query with a SQL oracle matches DuckDB on the smallest driver tables."""
import pytest

import __spark_entry__ as E
from sieve.plans.oracle import check, duck
from tests.conftest import SMALL

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    r = check(spark, name, SMALL, E.queries(), E.oracle_sql(), con)
    assert r["ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(df.columns) == {"query_id", "query_p", "query_call", "rank", "ref_id", "neighbour_label", "cosine"}


def test_every_query_reads_the_tables():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_join_in_plan(spark, name):
    """No registered query plans a cartesian product or a nested-loop join."""
    plan = E.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
