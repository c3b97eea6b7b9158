"""Pairs are judged before the windows of runs, relations and rules, which see neither places nor other candidates' columns."""

from lengthloom.plans import registry


def _windows(plan):
    if plan.nodeName() == "Window":
        yield plan.expressions().toString(), [plan.output().apply(i) for i in range(plan.output().size())]
    for i in range(plan.children().size()):
        yield from _windows(plan.children().apply(i))


def test_no_wide_row_reaches_the_windows_of_runs(spark):
    d = registry.queries()["guard_decisions"](spark, "/root/testdata/sf0.001")
    found = list(_windows(d._jdf.queryExecution().optimizedPlan()))
    carried = next(out for what, out in found if "_kids" in what)
    assert not {"x1", "y2", "dir_x", "_support"} & {a.name() for a in carried}
    sheet = next(a for a in carried if a.name() == "_sheet")
    assert list(sheet.dataType().elementType().fieldNames()) == ["ord", "cid", "value_mm"]
    assert sum("count(1)" in what for what, _ in found) == 1
