"""Every registered query against its SQL, and the plans of those that must not pair everything."""

import os

import pytest
from oracle_check import compare, duck

from placework.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")

ROWS = (
    [f"s{i}" for i in range(1, 9)] + [f"f{i}" for i in range(1, 11)] + [f"j{i}" for i in range(1, 13)]
    + [f"a{i}" for i in range(1, 11)] + [f"w{i}" for i in range(1, 5)] + [f"l{i}" for i in range(1, 4)]
    + [f"u{i}" for i in range(1, 4)] + ["g1"] + [f"m{i}" for i in range(1, 6)] + [f"x{i}" for i in range(1, 31)]
    + [f"h{i}" for i in range(1, 16)] + [f"e{i}" for i in range(1, 10)] + ["t1"]
)


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_inventory_is_covered():
    assert len(ROWS) == 111
    assert {name.split("_")[0] for name in QUERIES} == set(ROWS)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    assert "ArrowEvalPython" not in plan or name in ("x2_similarity", "x2_similarity_built", "j9_match_nearby", "j9_match_built_names")
    # The smallest tables have no row for some filters; then the SQL has none either.
    assert compare(con, df, ORACLES.get(name), allow_empty=name in ORACLES) == ""


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["f2_select_like"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_nationkey,3)" in plan or "EqualNullSafe(c_nationkey,3)" in plan
    plan = QUERIES["f4_select_columns"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
