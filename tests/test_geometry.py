"""Strokes, dimension lines, ticks and links on small drawings, with the expected values written out, and against all pairs."""

import math
import random

from lengthloom.operators import evaluation as E
from lengthloom.operators import geometry as G

ITEMS = "sheet_no long, seqno long, width double, items array<struct<kind:string,x0:double,y0:double,x1:double,y1:double>>"


def strokes(spark, *rows, sheet=1, width=0.5):
    """Lines by their ends, a drawing each."""
    return G.flatten(spark.createDataFrame([(sheet, i, width, [("l", *map(float, r))]) for i, r in enumerate(rows)], ITEMS))


def lines(spark, *rows):
    return sorted(((r["line"], round(r["x1"], 6), round(r["y1"], 6), round(r["x2"], 6), round(r["y2"], 6), [b["seqno"] for b in r["bodies"]]) for r in G.dimension_lines(strokes(spark, *rows)).collect()))


def test_items_become_strokes(spark):
    d = spark.createDataFrame([(1, 0, None, [("l", 0.0, 0.0, 3.0, 4.0), ("re", 0.0, 0.0, 10.0, 0.5), ("c", 0.0, 0.0, 9.0, 9.0), ("l", 1.0, 1.0, 1.5, 1.0), None]), (1, 1, 0.3, None)], ITEMS)
    got = sorted((r["seg"]["item_no"], r["seg"]["edge_no"], r["length"], round(r["angle"], 6), r["width"]) for r in G.flatten(d).collect())
    assert got == [(0, 0, 5.0, 0.927295, 0.0), (1, 0, 10.0, 0.0, 0.0), (1, 2, 10.0, round(math.pi, 6), 0.0)]


def test_kinds(spark):
    d = spark.createDataFrame([(28.0, 0.18), (27.9, 0.5), (900.0, 1.2), (900.1, 0.5), (16.0, 0.0), (16.1, 0.0), (3.5, 1.2), (3.4, 1.0), (30.0, 1.3), (30.0, 0.17)], "length double, width double")
    assert [r[0] for r in d.select(G.kind()).collect()] == ["body", None, "body", None, "tick", None, "tick", None, None, None]


def test_strokes_join_over_small_gaps(spark):
    assert lines(spark, (0, 10, 40, 10), (54, 10, 90, 10), (104.5, 10, 150, 10), (20, 10, 30, 10)) == [(1, 0.0, 10.0, 90.0, 10.0, [0, 1, 3]), (2, 104.5, 10.0, 150.0, 10.0, [2])]


def test_direction_doesnt_matter(spark):
    assert lines(spark, (90, 10, 50, 10), (0, 10, 40, 10)) == [(1, 0.0, 10.0, 90.0, 10.0, [0, 1])]
    assert lines(spark, (5, 90, 5, 50), (5, 0, 5, 40)) == [(1, 5.0, 0.0, 5.0, 90.0, [0, 1])]


def test_lines_are_numbered_by_their_first_stroke(spark):
    got = lines(spark, (200, 50, 240, 50), (0, 10, 40, 10), (0, 50, 40, 50), (0, 30, 40, 30))
    assert [(r[0], r[-1]) for r in got] == [(1, [2]), (2, [0]), (3, [1]), (4, [3])]


def test_the_first_stroke_gives_the_frame(spark):
    """Strokes of a bucket that lie a little beside are projected onto the first one's line."""
    assert lines(spark, (0, 10, 40, 10), (45, 10.4, 80, 10.4)) == [(1, 0.0, 10.0, 80.0, 10.0, [0, 1])]
    assert lines(spark, (45, 10.4, 80, 10.4), (0, 10, 40, 10)) == [(1, 0.0, 10.4, 80.0, 10.4, [0, 1])]


def test_ticks_and_links_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(150):
        a, n, x, y = rng.choice([0, math.pi / 2, rng.random() * 3]), rng.choice([5, 10, 40, 300]), rng.uniform(-300, 300), rng.uniform(-300, 300)
        rows.append((x, y, x + n * math.cos(a), y + n * math.sin(a)))
    s = strokes(spark, *rows).withColumn("kind", G.kind())
    lines_ = G.dimension_lines(s.filter("kind = 'body'"))
    ticks = s.filter("kind = 'tick'")
    ends = [r.asDict() for r in lines_.collect()]

    def away(px, py, r):
        vx, vy = r["x2"] - r["x1"], r["y2"] - r["y1"]
        t = ((px - r["x1"]) * vx + (py - r["y1"]) * vy) / (vx * vx + vy * vy)
        c = min(1, max(0, t))
        return math.hypot(px - r["x1"] - c * vx, py - r["y1"] - c * vy), t

    want = {(r["line"], t["seg"]["seqno"]) for t in ticks.collect() for r in ends if abs(t["ux"] * r["ax"] + t["uy"] * r["ay"]) <= 0.35 and min(away(t["x1"], t["y1"], r)[0], away(t["x2"], t["y2"], r)[0]) <= 4}
    for size in (5.0, 32.0, 1000.0):
        assert {(r["line"], r["seg"]["seqno"]) for r in G.extension_ticks(ticks, lines_, size).collect()} == want
    assert want

    points = [(i, rng.uniform(-300, 300), rng.uniform(-300, 300), rng.random() * math.pi) for i in range(200)]
    best = {}
    for i, x, y, a in points:
        for r in ends:
            cos = abs(math.cos(a) * r["ax"] + math.sin(a) * r["ay"])
            end, t = away(x, y, r)
            off = abs((y - r["y1"]) * r["ax"] - (x - r["x1"]) * r["ay"])
            dist = end if end <= 60 else off if off <= 60 and -0.15 <= t <= 1.15 else None
            if cos >= 0.9 and dist is not None:
                best[i] = min(best.get(i, (9e9,)), (dist, -cos, r["line"]))
    d = spark.createDataFrame([(1, i, x, y, math.cos(a), math.sin(a)) for i, x, y, a in points], "sheet_no long, seg long, x double, y double, ux double, uy double")
    for size in (7.0, None):
        got = {r["seg"]: (round(r["dist"], 9), r["line"]) for r in G.nearest_lines(d, lines_, 60.0, 0.9, size=size).collect()}
        assert got == {i: (round(b[0], 9), b[2]) for i, b in best.items()}
    assert len(best) > 20


def test_no_points_and_no_lines(spark):
    none = strokes(spark, (0, 0, 40, 0)).filter("seg is null")
    assert G.dimension_lines(none).count() == 0 and G.extension_ticks(none, G.dimension_lines(none)).count() == 0


def test_islands_are_the_same_in_any_ranges(spark):
    rng = random.Random(1)
    rows = [(b, i, t := rng.uniform(0, 4000), t + rng.choice([0.0, 5.0, 900.0 if i % 40 == 0 else 1.0])) for b in range(3) for i in range(300)]
    d = spark.createDataFrame(rows, "bucket int, ord int, t0 double, t1 double")
    got = [sorted(map(tuple, E.islands(d, span=s).collect())) for s in (1e9, 1440.0, 10.0)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 30
    begun, reach, want = 0, None, []
    for _, i, a, b in sorted((r for r in rows if r[0] == 0), key=lambda r: r[2]):
        begun += reach is None or a > reach + 14
        reach = b if reach is None else max(reach, b)
        want.append((begun, i))
    assert {r[1]: r[3] for r in got[0] if r[0] == 0} == {k: sum(w[0] == k for w in want) for k in {w[0] for w in want}}
