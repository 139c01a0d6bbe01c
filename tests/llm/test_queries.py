"""Every query of the subpackage runs; those with SQL equal it."""

import pytest

import oracle
from loanlens.llm.oracles import ORACLES
from loanlens.llm.queries import QUERIES

BY_BRUTE_FORCE = {"op2_hilbert_shards", "op4_marginal_language", "op7_weak_supervision", "op8_template_leaks"}


def test_every_query_is_checked_somewhere():
    assert set(QUERIES) - set(ORACLES) == BY_BRUTE_FORCE
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert oracle.differences(QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), ORACLES[name]) == []
