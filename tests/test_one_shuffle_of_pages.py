"""Queries on pages write nothing in between and move the lines once for the candidates, once for what the pages say of themselves."""

import os

import pytest

from lengthloom.plans import registry


@pytest.mark.parametrize(("name", "times"), [("text_spans", 1), ("frame_reason", 1), ("page_candidates", 1), ("sheet_meta", 1), ("prompt_texts", 2), ("review_texts", 2)])
def test_lines_are_shuffled_by_page(spark, name, times):
    d = registry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == plan.count("Exchange hashpartitioning") == times
    assert all(os.path.basename(f) == "lineitem.parquet" for f in d.inputFiles())
