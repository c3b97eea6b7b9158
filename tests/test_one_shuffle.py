"""Queries on pairs of a sheet move its rows once and write nothing in between."""

import os

import pytest

from lengthloom.plans import registry


@pytest.mark.parametrize("name", ["sample_weights", "relations", "guard_decisions"])
def test_rows_are_shuffled_once(spark, name):
    d = registry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert all(os.path.basename(f) == "lineitem.parquet" for f in d.inputFiles())
