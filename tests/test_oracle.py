"""Every query against DuckDB on the same tables, and a look at its plan."""

import re

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries
from loanlens.plans import closed_forms, oracles
from loanlens.plans import queries as plain

# Those of the optional subpackage have tests of their own.
QUERIES, ORACLES = plain.QUERIES | closed_forms.QUERIES, oracles.ORACLES | closed_forms.ORACLES

# Checked by invariants in test_invariants.py: models, and values that depend on
# approximate quantiles or iteration.
ROWS_ONLY = {
    "impute_chained",
    "vote_features",
    "pca",
    "explained_variance_of_seven",
    "logistic",
    "logistic_on_woe",
    "random_forest",
    "boosted_trees",
    "boosted_importance",
    "model_curves",
    "score",
    "cross_validate",
    "cross_validate_forest",
    "cv_results",
    "grid_search_boosted",
    "feature_importance",
}


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_is_checked_somewhere():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, connection, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    # A grouped aggregate that sorts all its input rows first.
    assert not re.search(r"SortAggregate\(key=\[[^\]]", plan)
    assert oracle.differences(df, connection, ORACLES[name]) == []


def test_all_are_registered():
    assert QUERIES.items() <= queries().items() and ORACLES.items() <= oracle_sql().items()


def test_entry(spark):
    assert entry(spark).columns == ["dimension", "value", "applicants", "outcome", "percent"]
