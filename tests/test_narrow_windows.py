"""Pairs are judged before the window that gathers edges, so it doesn't carry a row's sheet; lines that nobody asks aren't made."""

import re

from lengthloom.plans import registry


def test_sheet_is_gone_before_edges_are_gathered(spark):
    d = registry.queries()["sequential_neighbor"](spark, "/root/testdata/sf0.001")
    plan = d._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "Window [collect_set(_sure" in line)
    assert not any("exists(_sheet" in line or "_sheet" in line for line in plan[:at])
    assert not any(re.search(r"AS x[12]#|AS offset#", line) for line in plan)
