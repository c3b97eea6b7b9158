"""Dimension lines of a drawing: items flattened to strokes, strokes joined to lines, ticks and texts linked to lines by a grid."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lengths and widths of a line's body and of a tick (points), and the gap that a line bridges.
BODY_LENGTH, BODY_WIDTH, TICK_LENGTH, GAP = (28.0, 900.0), (0.18, 1.2), (3.5, 16.0), 14.0
#: How near a tick's end lies, and how far it may lean; reach, direction and overhang of a text beside a line.
TICK_REACH, TICK_LEAN, TEXT_REACH, PARALLEL, OVERHANG = 4.0, 0.35, 22.0, 0.97, 0.15
#: Fixed value: what rounding may add to a distance.
SLACK = 1e-6


def flatten(drawings: DataFrame) -> DataFrame:
    """sheet_no, seg (drawing, item, edge), two ends, width, length, unit direction ux, uy and angle: strokes of a point or more.

    drawings: sheet_no, seqno, width, items of kind ``l`` (a line by its ends) or ``re`` (a rectangle by two corners, four edges in
    a ring). Other kinds and null items give nothing.
    """
    d = drawings.select("sheet_no", "seqno", F.coalesce("width", F.lit(0.0)).alias("width"), F.posexplode("items").alias("item_no", "i"))
    line = lambda a, b, c, e: F.struct(*(F.col(f"i.{k}").alias(n) for k, n in zip((a, b, c, e), ("x1", "y1", "x2", "y2"), strict=True)))
    ring = F.array(line("x0", "y0", "x1", "y0"), line("x1", "y0", "x1", "y1"), line("x1", "y1", "x0", "y1"), line("x0", "y1", "x0", "y0"))
    edges = F.when(F.col("i.kind") == "l", F.array(line("x0", "y0", "x1", "y1"))).when(F.col("i.kind") == "re", ring)
    d = d.select("sheet_no", "seqno", "item_no", "width", F.posexplode(edges).alias("edge_no", "e"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    d = d.select("sheet_no", F.struct("seqno", "item_no", "edge_no").alias("seg"), "width", "e.*").withColumn("length", F.sqrt(dx * dx + dy * dy)).filter("length >= 1")
    return d.withColumns({"ux": dx / F.col("length"), "uy": dy / F.col("length")}).withColumn("angle", F.atan2("uy", "ux"))


def kind() -> Column:
    """body, tick, or null for what is neither."""
    n, w = F.col("length"), F.col("width")
    return F.when(n.between(*BODY_LENGTH) & w.between(*BODY_WIDTH), "body").when(n.between(*TICK_LENGTH) & (w <= BODY_WIDTH[1]), "tick")


def dimension_lines(bodies: DataFrame, gap: float = GAP) -> DataFrame:
    """sheet_no, line, angle, offset, axis, two ends and the strokes of every dimension line, numbered in a sheet.

    A stroke's axis points into the right half-plane (straight lines up); its angle in steps of five degrees and the distance of its
    line from the origin in steps of two points name its bucket. The bucket's first stroke gives the axis and origin on which all are
    projected; those with gaps of up to ``gap`` between them are one line. Lines count in order of their bucket's first stroke, then along the axis.
    Buckets are parts of a sheet: nothing is sorted beyond one, and numbers are given to the lines of a sheet, not to its strokes.
    """
    turned = (F.col("ux") < -1e-9) | ((F.abs("ux") <= 1e-9) & (F.col("uy") < 0))
    d = bodies.withColumns({"ax": F.when(turned, -F.col("ux")).otherwise(F.col("ux")), "ay": F.when(turned, -F.col("uy")).otherwise(F.col("uy"))})
    d = d.withColumns({"turn": F.rint(F.atan2("ay", "ax") * 36 / pi).cast("int"), "lane": F.rint((F.col("y1") * F.col("ax") - F.col("x1") * F.col("ay")) / 2).cast("int")})
    bucket = ["sheet_no", "turn", "lane"]
    d = d.withColumn("f", F.first(F.struct("seg", "ax", "ay", F.col("x1").alias("x"), F.col("y1").alias("y"))).over(Window.partitionBy(*bucket).orderBy("seg")))
    on = lambda i: (F.col(f"x{i}") - F.col("f.x")) * F.col("f.ax") + (F.col(f"y{i}") - F.col("f.y")) * F.col("f.ay")
    d = d.withColumns({"lo": F.least(on(1), on(2)), "hi": F.greatest(on(1), on(2))})
    w = Window.partitionBy(*bucket).orderBy("lo", "seg")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("new", F.coalesce((F.col("lo") > before + gap).cast("int"), F.lit(1)))
    d = d.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = d.groupBy(*bucket, "island").agg(F.first("f").alias("f"), F.min("lo").alias("t0"), F.max("hi").alias("t1"), F.sort_array(F.collect_list("seg")).alias("bodies"))
    end = lambda a, t: F.col(f"f.{a}") + F.col(f"f.a{a}") * F.col(t)
    g = g.select("sheet_no", "f.seg", "island", "f.ax", "f.ay", *(end(a, f"t{i}").alias(f"{a}{i + 1}") for i in (0, 1) for a in "xy"), "bodies")
    line = F.row_number().over(Window.partitionBy("sheet_no").orderBy("seg", "island"))
    return g.select("sheet_no", line.alias("line"), F.atan2("ay", "ax").alias("angle"), (F.col("y1") * F.col("ax") - F.col("x1") * F.col("ay")).alias("offset"), "ax", "ay", "x1", "y1", "x2", "y2", "bodies")


def cells(d: DataFrame, pad: float, size: float) -> DataFrame:
    """d, once in each cell (cx, cy) of a grid that has a point within pad of the stroke from x1, y1 to x2, y2.

    Column by column of the grid, the part of the stroke that lies within pad of the column gives its cells: a stroke of n cells' length has in the
    order of n rows, whatever its direction.
    """
    at = lambda c: F.floor(c / size).cast("int")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    d = d.withColumn("cx", F.explode(F.sequence(at(F.least("x1", "x2") - pad), at(F.greatest("x1", "x2") + pad))))
    part = lambda edge: F.when(F.abs(dx) < 1e-9, None).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (edge - F.col("x1")) / dx)))
    a, b = F.coalesce(part(F.col("cx") * size - pad), F.lit(0.0)), F.coalesce(part((F.col("cx") + 1) * size + pad), F.lit(1.0))
    ya, yb = F.col("y1") + dy * a, F.col("y1") + dy * b
    return d.withColumn("cy", F.explode(F.sequence(at(F.least(ya, yb) - pad), at(F.greatest(ya, yb) + pad))))


def _to_segment(px: Column, py: Column, s: str) -> Column:
    """Distance of a point from the segment of alias s."""
    vx, vy = F.col(f"{s}.x2") - F.col(f"{s}.x1"), F.col(f"{s}.y2") - F.col(f"{s}.y1")
    qx, qy, n2 = px - F.col(f"{s}.x1"), py - F.col(f"{s}.y1"), vx * vx + vy * vy
    t = F.when(n2 < 1e-9, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (qx * vx + qy * vy) / n2)))
    ex, ey = qx - t * vx, qy - t * vy
    return F.sqrt(ex * ex + ey * ey)


def extension_ticks(ticks: DataFrame, lines: DataFrame, size: float = 32.0) -> DataFrame:
    """sheet_no, line, seg of ticks across a line of which an end lies on it, joined by the cells of a grid."""
    ends = F.explode(F.array(*(F.struct(F.col(f"x{i}").alias("px"), F.col(f"y{i}").alias("py")) for i in (1, 2)))).alias("p")
    t = ticks.select("sheet_no", "seg", "ux", "uy", ends).select("*", "p.px", "p.py").withColumns({"cx": F.floor(F.col("px") / size).cast("int"), "cy": F.floor(F.col("py") / size).cast("int")})
    on = [F.col(f"t.{c}") == F.col(f"l.{c}") for c in ("sheet_no", "cx", "cy")]
    j = t.alias("t").join(cells(lines.drop("bodies"), TICK_REACH, size).alias("l"), on)
    across = F.abs(F.col("t.ux") * F.col("l.ax") + F.col("t.uy") * F.col("l.ay")) <= TICK_LEAN
    return j.filter(across & (_to_segment(F.col("t.px"), F.col("t.py"), "l") <= TICK_REACH)).select("l.sheet_no", "l.line", "t.seg").distinct()


def nearest_lines(points: DataFrame, lines: DataFrame, reach: float = TEXT_REACH, parallel: float = PARALLEL, same: bool = False, size: float | None = None, first: float | None = None) -> DataFrame:
    """sheet_no, seg, line, dist: the nearest line of like direction; a point may lie past an end by 0.15 of the length.

    points: sheet_no, seg, x, y and a unit direction ux, uy. lines: sheet_no, line, two ends and unit axis ax, ay; with ``same``, points
    and lines share their names, and none is its own line. Of equally near and parallel lines the first wins. A point meets the lines whose prolonged stroke comes near its cell of the grid.
    Where lines are many, ``first`` is a shorter reach that is tried before: who has a line within it meets no others.
    """
    if first is None:
        best = _nearest(points, lines, reach, reach, parallel, same, size or max(64.0, 2 * reach))
    else:
        found = _nearest(points.filter("seg is not null"), lines, first, reach, parallel, same, size or 2 * first).filter(F.col("m.dist") <= first - SLACK)
        rest = points.join(found.select("sheet_no", "seg"), ["sheet_no", "seg"], "left_anti")
        best = found.unionByName(_nearest(rest, lines, reach, reach, parallel, same, size or max(64.0, 2 * reach)))
    return best.select("sheet_no", "seg", "m.line", "m.dist")


def _nearest(points: DataFrame, lines: DataFrame, near: float, reach: float, parallel: float, same: bool, size: float) -> DataFrame:
    """sheet_no, seg, m (dist, c, line): the best of the lines that pass a point within ``near``; all whose dist is less are among them."""
    over = {f"_{a}{i}": F.col(f"{a}{i}") + s * OVERHANG * (F.col(f"{a}2") - F.col(f"{a}1")) for i, s in ((1, -1), (2, 1)) for a in "xy"}
    ends = ["x1", "y1", "x2", "y2"]
    l = lines.select("sheet_no", "line", "ax", "ay", *ends).withColumns(over)  # noqa: E741
    l = cells(l.select("sheet_no", "line", "ax", "ay", F.struct(*ends).alias("own"), *(F.col(f"_{c}").alias(c) for c in ends)), near, size)  # noqa: E741
    l = l.select("sheet_no", "line", "ax", "ay", "own.*", "cx", "cy").alias("l")  # noqa: E741
    p = points.withColumns({"cx": F.floor(F.col("x") / size).cast("int"), "cy": F.floor(F.col("y") / size).cast("int")}).alias("p")
    vx, vy = F.col("l.x2") - F.col("l.x1"), F.col("l.y2") - F.col("l.y1")
    qx, qy, n2 = F.col("p.x") - F.col("l.x1"), F.col("p.y") - F.col("l.y1"), vx * vx + vy * vy
    off, cos = F.abs(qy * F.col("l.ax") - qx * F.col("l.ay")), F.abs(F.col("p.ux") * F.col("l.ax") + F.col("p.uy") * F.col("l.ay"))
    on = [F.col(f"p.{c}") == F.col(f"l.{c}") for c in ("sheet_no", "cx", "cy")] + [cos >= parallel, off <= near + SLACK]  # no line is nearer than its axis
    j = p.join(l, [*on, F.col("p.seg") != F.col("l.line")] if same else on)
    t = F.when(n2 < 1e-9, 0.0).otherwise((qx * vx + qy * vy) / n2)
    j = j.withColumns({"t": t, "off": off, "cos": cos, "end": _to_segment(F.col("p.x"), F.col("p.y"), "l")})
    j = j.withColumn("dist", F.when(F.col("end") <= reach, F.col("end")).when((F.col("off") <= reach) & F.col("t").between(-OVERHANG, 1 + OVERHANG), F.col("off")))
    best = F.min(F.when(F.col("dist").isNotNull(), F.struct("dist", (-F.col("cos")).alias("c"), F.col("l.line").alias("line"))))  # a filter would be moved into the join, with all that it asks
    return j.groupBy("p.sheet_no", "p.seg").agg(best.alias("m")).filter("m is not null")
