"""Queries on the strokes of drawings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..sources import adapters as A
from .oracle import A3


def _strokes(spark, sf) -> DataFrame:
    return G.flatten(A.drawings(A.table(spark, sf, "embeddings"))).withColumn("kind", G.kind())


def _lines(spark, sf) -> DataFrame:
    return G.dimension_lines(_strokes(spark, sf).filter("kind = 'body'"))


def _rounded(*names: str):
    return [(F.round(n, 6) + 0.0).alias(n) for n in names]  # no negative zeros


def drawing_strokes(spark, sf) -> DataFrame:
    """Strokes of lines and rectangles in nested drawings, with their direction and kind."""
    return _strokes(spark, sf).select("sheet_no", "seg.seqno", "seg.item_no", "seg.edge_no", *_rounded("length", "angle"), F.coalesce("kind", F.lit("drop")).alias("kind"))


def dimension_lines(spark, sf) -> DataFrame:
    """Dimension lines of every sheet with the strokes that they consist of."""
    name = lambda s: F.concat_ws("/", s["seqno"].cast("string"), s["item_no"].cast("string"), s["edge_no"].cast("string"))
    return _lines(spark, sf).select("sheet_no", "line", *_rounded("angle", "offset", "x1", "y1", "x2", "y2"), F.size("bodies").alias("n_bodies"), F.array_join(F.transform("bodies", name), " ").alias("bodies"))


def extension_ticks(spark, sf) -> DataFrame:
    """Ticks across a dimension line that end on it."""
    return G.extension_ticks(_strokes(spark, sf).filter("kind = 'tick'"), _lines(spark, sf)).select("sheet_no", "line", "seg.seqno", "seg.item_no", "seg.edge_no")


def line_links(spark, sf) -> DataFrame:
    """The dimension line beside which each drawing's rectangle stands, by the rectangle's middle and its direction."""
    r = A.drawings(A.table(spark, sf, "embeddings")).select("sheet_no", "seqno", F.col("items")[7].alias("r"))
    points = r.select("sheet_no", F.col("seqno").alias("seg"), ((F.col("r.x0") + F.col("r.x1")) / 2).alias("x"), ((F.col("r.y0") + F.col("r.y1")) / 2).alias("y"), (F.col("seqno") % 2).cast("double").alias("ux"), (1.0 - F.col("seqno") % 2).alias("uy"))
    return G.nearest_lines(points, _lines(spark, sf)).select("sheet_no", F.col("seg").alias("seqno"), "line", F.round("dist", 6).alias("dist"))


def nearest_line(spark, sf) -> DataFrame:
    """Midpoints of strokes that are no lines, and the nearest line of like direction; wide limits, as strokes are few."""
    d = A.segments(A.table(spark, sf, "embeddings"))
    body = F.col("length").between(*G.BODY_LENGTH) & F.col("width").between(*G.BODY_WIDTH)
    mid = d.filter(~body & (F.col("length") > 0)).selectExpr("sheet_no", "seg", "(x1 + x2) / 2 as x", "(y1 + y2) / 2 as y", "(x2 - x1) / length as ux", "(y2 - y1) / length as uy")
    lines = d.filter(body).selectExpr("sheet_no", "seg as line", "x1", "y1", "x2", "y2", "(x2 - x1) / length as ax", "(y2 - y1) / length as ay")
    return G.nearest_lines(mid, lines, reach=60.0, parallel=0.9, same=True, first=7.5).select("seg", "line", F.round("dist", 6).alias("dist"))


STROKES = """e as (select cast(floor(vec_id / 25) as bigint) as sheet_no, vec_id % 25 as seqno, list_transform(embedding, lambda v: cast(v as double)) as v, unnest(range(8)) as g from embeddings
), b as (select sheet_no, seqno, cast(g as integer) as g, abs(v[7]) * 4 + 0.1 as width, round_even(v[8 * g + 1] * 32, 0) * 20 + 300 as x0, round_even(v[8 * g + 2] * 32, 0) * 20 + 300 as y0,
    cast(floor(abs(v[8 * g + 3]) * 64) as bigint) % 4 as k, v[8 * g + 4] < 0 as back, case when abs(v[8 * g + 5]) < 0.05 then abs(v[8 * g + 5]) * 200 + 4 else abs(v[8 * g + 5]) * 400 + 28 end as n from e
), i as (select sheet_no, seqno, g, width, x0, y0, x0 + m * case when g = 7 then 1.0::double else ([1, 0, 0.7071067811865476, 0.8660254037844387]::double[])[k + 1] end as x1, y0 + m * case when g = 7 then 0.5::double else ([0, 1, 0.7071067811865476, 0.5]::double[])[k + 1] end as y1
  from (select *, case when back then -n else n end as m from b)
), r as (select sheet_no, seqno, g as item_no, 0 as edge_no, width, x0 as x1, y0 as y1, x1 as x2, y1 as y2 from i where g < 7
  union all select sheet_no, seqno, g, 0, width, x0, y0, x1, y0 from i where g = 7 union all select sheet_no, seqno, g, 1, width, x1, y0, x1, y1 from i where g = 7
  union all select sheet_no, seqno, g, 2, width, x1, y1, x0, y1 from i where g = 7 union all select sheet_no, seqno, g, 3, width, x0, y1, x0, y0 from i where g = 7
), s as (select *, (x2 - x1) / length as ux, (y2 - y1) / length as uy, seqno * 100 + item_no * 10 + edge_no as seg,
    case when length between 28 and 900 and width between 0.18 and 1.2 then 'body' when length between 3.5 and 16 and width <= 1.2 then 'tick' else 'drop' end as kind
  from (select *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) as length from r) where length >= 1)"""
LINES = STROKES + """, ax as (select *, case when f then -ux else ux end as ax, case when f then -uy else uy end as ay from (select *, ux < -1e-9 or (abs(ux) <= 1e-9 and uy < 0) as f from s where kind = 'body')
), bk as (select *, round_even(atan2(ay, ax) * 36 / pi(), 0) as turn, round_even((y1 * ax - x1 * ay) / 2, 0) as lane from ax
), fr as (select *, first_value(seg) over w as fs, first_value(ax) over w as fax, first_value(ay) over w as fay, first_value(x1) over w as fx, first_value(y1) over w as fy from bk window w as (partition by sheet_no, turn, lane order by seg)
), pr as (select *, least(p, q) as lo, greatest(p, q) as hi from (select *, (x1 - fx) * fax + (y1 - fy) * fay as p, (x2 - fx) * fax + (y2 - fy) * fay as q from fr)
), nw as (select *, coalesce(lo > max(hi) over (partition by sheet_no, turn, lane order by lo, seg rows between unbounded preceding and 1 preceding) + 14, true) as new from pr
), isl as (select *, sum(new::int) over (partition by sheet_no, turn, lane order by lo, seg rows unbounded preceding) as island from nw
), ln as (select sheet_no, fs, island, fax as ax, fay as ay, fx + fax * min(lo) as x1, fy + fay * min(lo) as y1, fx + fax * max(hi) as x2, fy + fay * max(hi) as y2, count(*) as n_bodies, string_agg(seqno || '/' || item_no || '/' || edge_no, ' ' order by seg) as bodies
  from isl group by sheet_no, turn, lane, fs, island, fax, fay, fx, fy
), dl as (select *, cast(row_number() over (partition by sheet_no order by fs, island) as integer) as line, y1 * ax - x1 * ay as off from ln)"""
_END = "sqrt(pow(qx - c * vx, 2) + pow(qy - c * vy, 2))"

ORACLE = {
    "drawing_strokes": f"with {STROKES} select sheet_no, seqno, item_no, edge_no, round(length, 6) + 0.0 as length, round(atan2(uy, ux), 6) + 0.0 as angle, kind from s",
    "dimension_lines": f"with {LINES} select sheet_no, line, round(atan2(ay, ax), 6) + 0.0 as angle, round(off, 6) + 0.0 as \"offset\", round(x1, 6) + 0.0 as x1, round(y1, 6) + 0.0 as y1, round(x2, 6) + 0.0 as x2, round(y2, 6) + 0.0 as y2, cast(n_bodies as integer) as n_bodies, bodies from dl",
    "extension_ticks": f"""with {LINES}, t as (select sheet_no, seqno, item_no, edge_no, ux, uy, x1 as px, y1 as py from s where kind = 'tick' union all select sheet_no, seqno, item_no, edge_no, ux, uy, x2, y2 from s where kind = 'tick'
    ), j as (select t.*, dl.line, x2 - x1 as vx, y2 - y1 as vy, px - x1 as qx, py - y1 as qy from t join dl on t.sheet_no = dl.sheet_no and abs(t.ux * dl.ax + t.uy * dl.ay) <= 0.35
    ), k as (select *, greatest(0, least(1, (qx * vx + qy * vy) / (vx * vx + vy * vy))) as c from j) select distinct sheet_no, line, seqno, item_no, edge_no from k where {_END} <= 4""",
    "line_links": f"""with {LINES}, pt as (select sheet_no, seqno, (x0 + x1) / 2 as x, (y0 + y1) / 2 as y, cast(seqno % 2 as double) as ux, cast(1 - seqno % 2 as double) as uy from i where g = 7
    ), j as (select pt.sheet_no, seqno, line, x2 - x1 as vx, y2 - y1 as vy, x - x1 as qx, y - y1 as qy, abs(ux * ax + uy * ay) as cs, abs((y - y1) * ax - (x - x1) * ay) as off from pt join dl on pt.sheet_no = dl.sheet_no
    ), k as (select *, (qx * vx + qy * vy) / (vx * vx + vy * vy) as t, greatest(0, least(1, (qx * vx + qy * vy) / (vx * vx + vy * vy))) as c from j where cs >= 0.97
    ), d as (select *, case when {_END} <= 22 then {_END} when off <= 22 and t between -0.15 and 1.15 then off end as dist from k)
    select sheet_no, seqno, line, round(dist, 6) as dist from (select *, row_number() over (partition by sheet_no, seqno order by dist, cs desc, line) as r from d where dist is not null) where r = 1""",
    "nearest_line": f"""with {A3}, body as (select * from a3 where length between 28 and 900 and width between 0.18 and 1.2
    ), pt as (select sheet_no, seg, (x1 + x2) / 2 as x, (y1 + y2) / 2 as y, (x2 - x1) / length as ux, (y2 - y1) / length as uy from a3 where not (length between 28 and 900 and width between 0.18 and 1.2) and length > 0
    ), j as (select pt.seg, l.seg as line, l.x2 - l.x1 as vx, l.y2 - l.y1 as vy, x - l.x1 as qx, y - l.y1 as qy, l.length as n, ux, uy from pt join body l on pt.sheet_no = l.sheet_no and pt.seg <> l.seg
    ), k as (select *, (qx * vx + qy * vy) / (vx * vx + vy * vy) as t, abs(qx * vy - qy * vx) / n as off, abs(ux * vx + uy * vy) / n as cs from j
    ), m as (select *, sqrt((qx - least(greatest(t, 0), 1) * vx) * (qx - least(greatest(t, 0), 1) * vx) + (qy - least(greatest(t, 0), 1) * vy) * (qy - least(greatest(t, 0), 1) * vy)) as e from k where cs >= 0.9
    ), d as (select *, case when e <= 60 then e when off <= 60 and t between -0.15 and 1.15 then off end as dist from m)
    select seg, line, round(dist, 6) as dist from (select *, row_number() over (partition by seg order by dist, cs desc, line) as r from d where dist is not null) where r = 1""",
}
QUERIES = {n: globals()[n] for n in ORACLE}
