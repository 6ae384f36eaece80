"""Every registered query against its SQL, and the shape of its plan."""

import re

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck
from tests.conftest import SF



def own(registered):
    """Without the queries of the optional subpackage, which has its own tests."""
    return {k: v for k, v in registered.items() if not re.match(r"op\d+_|pipeline$", k)}


QUERIES, ORACLES = own(entry.queries()), own(entry.oracle_sql())
ITERATIVE = {
    "F11_logistic_regression", "F12_linear_svm", "F13_calibrated_svm", "F14_score_all",
    "F16_experiment_grid", "F19_graph", "F20_neighbour_map",
}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql_or_is_iterative():
    assert set(QUERIES) - set(ORACLES) == ITERATIVE
    assert not set(ORACLES) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert compare(df, con, ORACLES[name]) == ""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5
    assert sum(r["n_rows"] for r in rows) > 0
