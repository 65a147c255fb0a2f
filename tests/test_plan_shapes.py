"""Physical-plan guards: no registered job uses a cross product or a
nested-loop join, and the scoring jobs never exchange pair-sized data."""

import re

import pytest

from trapwise.plans import registry

from .conftest import SMALL

FORBIDDEN = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|localCheckpoint")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_cross_products(spark, name):
    plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not FORBIDDEN.search(plan), name


def test_scoring_exchanges_only_partials(spark):
    # the dense beta sweep shuffles partial counts keyed by (query, beta), never (query, doc)
    plan = registry.QUERIES["dense_beta_sweep"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for part in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan):
        assert "doc_id" not in part
