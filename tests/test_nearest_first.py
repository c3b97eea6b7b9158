"""A short reach that is tried first changes no nearest line, and what a join asks of a pair is cheap."""

import random

import pytest

from lengthloom.operators import geometry as G
from lengthloom.plans import registry


@pytest.mark.parametrize("first", [0.5, 7.5, 59.0])
def test_short_reach_finds_the_same_lines(spark, first):
    r = random.Random(11)
    way = lambda: r.choice([(1.0, 0.0), (0.0, 1.0), (0.6, 0.8), (0.8, -0.6)])
    points, lines = [], []
    for i in range(300):
        (ux, uy), far = way(), 150 if i % 3 else 1500  # some lie alone
        points.append((i % 4 if i % 50 else None, i if i % 60 else None, float(r.randint(-far, far)), float(r.randint(-far, far)), ux, uy))
    for i in range(260):
        (ax, ay), n, x, y = way(), r.randint(0, 200), float(r.randint(-150, 150)), float(r.randint(-150, 150))
        lines.append((i % 4, i, x, y, x + n * ax, y + n * ay, ax, ay))
    p = spark.createDataFrame(points, "sheet_no long, seg long, x double, y double, ux double, uy double")
    l = spark.createDataFrame(lines, "sheet_no long, line long, x1 double, y1 double, x2 double, y2 double, ax double, ay double")  # noqa: E741
    for same in (True, False):
        want = sorted(map(tuple, G.nearest_lines(p, l, 60.0, 0.9, same).collect()), key=repr)
        got = sorted(map(tuple, G.nearest_lines(p, l, 60.0, 0.9, same, first=first).collect()), key=repr)
        assert got == want and len(want) > 100


def test_joins_ask_no_distances(spark):
    plan = registry.queries()["nearest_line"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join Inner" in line]
    assert len(joins) >= 2 and not any("SQRT" in line for line in joins)
