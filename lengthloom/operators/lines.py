"""Relations by dimension lines: which candidate lies inside the length of another.

Candidates carry line (null without one), two ends x1, y1, x2, y2, and offset, the line's distance from its axis. A row carries its
sheet's other candidates (pairs.pair_table); a is the smaller candidate of a pair, b the larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..arrays import F, Frame
from . import pairs as P

#: A run's least length (mm), how far pieces lie beside it and past its ends (points), and their score.
RUN, BESIDE, PAST, ALONG = 8000, 110.0, 24.0, 0.82
SURE = 0.75


def _on_axis(x: Column, y: Column, b) -> Column:
    """Where a point falls on b's direction, from b's first end."""
    return (x - b["x1"]) * b["dir_x"] + (y - b["y1"]) * b["dir_y"]


def _apart(a, b) -> Column:
    return F.abs(a["offset"] - b["offset"])


def _cos(a, b) -> Column:
    return a["dir_x"] * b["dir_x"] + a["dir_y"] * b["dir_y"]


def _touch(a, b) -> Column:
    sq = lambda i, j: (a[f"x{i}"] - b[f"x{j}"]) * (a[f"x{i}"] - b[f"x{j}"]) + (a[f"y{i}"] - b[f"y{j}"]) * (a[f"y{i}"] - b[f"y{j}"])
    return F.least(*(sq(i, j) for i in (1, 2) for j in (1, 2))) <= 22.0 * 22.0


def _by_overlap(a, b, judge) -> Column:
    """What judge makes of the overlap of a's line on b's, as a part of a's."""
    ends = F.struct(_on_axis(a["x1"], a["y1"], b).alias("c0"), _on_axis(a["x2"], a["y2"], b).alias("c1"), _on_axis(b["x2"], b["y2"], b).alias("p1"))

    def overlap(e):
        inner = F.greatest(F.lit(0.0), F.least(F.greatest(e["c0"], e["c1"]), F.greatest(F.lit(0.0), e["p1"])) - F.greatest(F.least(e["c0"], e["c1"]), F.least(F.lit(0.0), e["p1"])))
        return inner / F.greatest(F.lit(1.0), F.abs(e["c1"] - e["c0"]))

    return F.get(F.transform(F.transform(F.array(ends), overlap), judge), F.lit(0))


def with_pairs(c: DataFrame) -> DataFrame:
    """Candidates with supportish and larger: of each larger one that is parallel or long, as no other is a parent, parent_ord, d2, geo (the score by lines), text (by neighbours), along, and no_parent for handwheels and insulation."""
    d = P.pair_table(c).withColumn("supportish", F.col("_support") | F.upper("nearby").rlike("Н[.]О|H[.]O"))
    larger = F.filter("_sheet", lambda b: (b["value_mm"] > F.col("value_mm")) & ((b["value_mm"] >= RUN) | (_cos(P.OWN, b) >= 0.985)))

    def judged(b):
        return F.struct(
            b["ord"].alias("parent_ord"), P.d2(P.OWN, b).alias("d2"), b["_apart"].alias("no_parent"),
            _geometry(P.OWN, b).alias("geo"), P.text_score(P.OWN, b).alias("text"), _along(P.OWN, b).alias("along"),
        )

    return d.withColumn("larger", F.transform(larger, judged))


def pairs(c: DataFrame) -> DataFrame:
    """A row for each larger candidate of the sheet, as with_pairs judges it."""
    return with_pairs(c).select("sheet_no", "ord", "line", "supportish", F.explode(F.array_compact("larger")).alias("p")).select("sheet_no", "ord", "line", "supportish", "p.*")


def _geometry(a, b) -> Column:
    """How surely a lies inside b by their lines: parallel, 6 to 140 apart, overlapping, near; then by what they share."""
    r, named, touch, apart = a["value_mm"] / b["value_mm"], P.mentions(a, b) | P.mentions(b, a), _touch(a, b), _apart(a, b)
    possible = (
        (_cos(a, b) >= 0.985) & ~b["_whole"] & (r >= 0.20) & (a["line"] != b["line"]) & apart.between(6.0, 140.0) & (P.d2(a, b) <= 220.0 * 220.0)
    )
    scored = lambda o: (
        F.when(~F.coalesce(o >= 0.35, F.lit(False)), 0.0)
        .when(a["_support"] & (o >= 0.5), F.when(touch & (o >= 0.55), 1.0).otherwise(0.85))
        .when(touch & b["_bare"] & ((named & r.between(0.28, 0.55)) | ((o >= 0.55) & (r <= 0.40))), 0.85)
        .when(touch & (o >= 0.55), 0.65).when((o >= 0.7) & (apart <= 90), 0.60).otherwise(0.50)
    )
    return F.when(possible, _by_overlap(a, b, scored)).otherwise(0.0)


def _projects(a, b) -> Column:
    """Whether a falls on b's line: parallel, overlapping and 4 to 160 points beside it, or without a line; its middle near and between the ends."""
    middle = lambda k: F.when(a["line"].isNotNull(), (a[f"{k}1"] + a[f"{k}2"]) / 2).otherwise(a[k])
    x, y = middle("x"), middle("y")
    n = _on_axis(b["x2"], b["y2"], b)
    beside = F.abs((x - b["x1"]) * b["dir_y"] - (y - b["y1"]) * b["dir_x"])
    lined = a["line"].isNull() | ((F.abs(_cos(a, b)) >= 0.97) & _apart(a, b).between(4.0, 160.0) & _by_overlap(a, b, lambda o: o >= 0.45))
    return (n >= 8) & (beside <= BESIDE) & lined & _on_axis(x, y, b).between(-PAST, n + PAST)


def _along(a, b) -> Column:
    """Whether a is a piece that falls on the long line b, before other runs are asked."""
    return (b["value_mm"] >= RUN) & b["line"].isNotNull() & (a["value_mm"] >= 250) & ~a["f_handwheel"] & ~a["f_insulation_thickness"] & _projects(a, b)


def with_best_parent(d: DataFrame) -> DataFrame:
    """Rows of with_pairs with best (score, o, d2): the parent with the best score by lines or neighbours, -o its ord; the first wins a tie. Null without one."""
    best = F.array_max(F.transform(F.filter("larger", lambda p: ~p["no_parent"]), lambda p: F.struct(F.greatest(p["geo"], p["text"]).alias("score"), (-p["parent_ord"]).alias("o"), p["d2"].alias("d2"))))
    return d.withColumn("best", best).withColumn("best", F.when(F.col("best.score") > 0, F.col("best")))


def best_parents(c: DataFrame) -> DataFrame:
    """sheet_no, ord, parent_ord, score, d2: the parent with the best score by lines or neighbours."""
    return P.having(with_best_parent(with_pairs(c)), "best").select("sheet_no", "ord", (-F.col("o")).alias("parent_ord"), "score", "d2")


def with_kids(d: DataFrame) -> DataFrame:
    """Rows of with_pairs with _kids: the long lines that a row falls on, but for those that give it to another run; asked of others only where there are any."""
    if "_kids" in d.columns:
        return d
    d = P.with_other_runs(d, F.exists("larger", lambda p: p["along"]))
    kids = F.filter("larger", lambda p: p["along"] & ~F.coalesce(F.exists("problems", lambda o: o["parent_ord"] == p["parent_ord"]), F.lit(False)))
    return d.withColumn("_kids", F.transform(kids, lambda p: F.struct("line", "supportish", p["parent_ord"].alias("parent_ord"), p["d2"].alias("d2")))).drop("problems")


def judged(c: DataFrame) -> DataFrame:
    """Candidates with all that relations, chains and rules ask of their pairs, and _sheet with names alone: no wide row reaches a window."""
    d = with_kids(with_best_parent(with_pairs(c))).drop("larger")
    d = P.with_mentioned(P.with_facts(with_chain(d)))
    names = F.transform("_sheet", lambda b: F.struct(b["ord"].alias("ord"), b["cid"].alias("cid"), b["value_mm"].alias("value_mm")))
    d = d.drop("_sheet") if isinstance(d, Frame) else d.withColumn("_sheet", names)  # a frame gathers them where they are asked for
    return d.drop("supportish", *P.SEEN, *(n for n in P.PLACES if n not in ("nearby", "line")))


def with_run(d: DataFrame) -> DataFrame:
    """Rows of with_pairs with run (d2, parent_ord): of pieces of long runs, the nearest run; null for others.

    Pieces may belong to another run (pairs.with_other_runs). A run has pieces only if they lie on two lines or more, one
    without a line counting by itself, or if one has a support or an overall mark beside it.
    """
    d = with_kids(d).drop("larger")
    d = d.withColumn("_pieces", F.flatten(F.collect_list("_kids").over(P.sheet())))

    def holds(k):
        mine = F.filter("_pieces", lambda x: x["parent_ord"] == k["parent_ord"])
        lines = F.transform(mine, lambda x: x["line"])
        n = F.size(F.array_distinct(F.array_compact(lines))) + F.size(F.filter(lines, lambda x: x.isNull()))
        return (n >= 2) | F.exists(mine, lambda x: x["supportish"])

    near = F.array_min(F.transform(F.filter("_kids", holds), lambda k: F.struct(k["d2"].alias("d2"), k["parent_ord"].alias("parent_ord"))))
    return d.withColumn("run", near).drop("_kids", "_pieces")


def along_runs(c: DataFrame) -> DataFrame:
    """sheet_no, ord, parent_ord, d2: pieces of long runs; the nearest run wins."""
    return P.having(with_run(with_pairs(c)), "run").select("sheet_no", "ord", "parent_ord", "d2")


def with_relation(c: DataFrame) -> DataFrame:
    """Candidates with relation (parent_ord, score, dist): a run takes the place of a weaker parent; a sure parent of others has none itself.

    A piece of a run keeps its parent even so: a length with a support inside may lie in a longer run.
    """
    d = with_run(c if "_kids" in c.columns else with_best_parent(with_pairs(c)))
    run = F.col("run").isNotNull() & (F.coalesce("best.score", F.lit(0.0)) < ALONG)
    parent = F.when(run, F.struct("run.parent_ord", F.lit(ALONG).alias("score"), F.sqrt("run.d2").alias("dist"))).when(F.col("best").isNotNull(), F.struct((-F.col("best.o")).alias("parent_ord"), "best.score", F.sqrt("best.d2").alias("dist")))
    d = d.withColumns({"relation": parent, "_in_run": F.col("run").isNotNull()}).drop("run", "best", "supportish")
    d = d.withColumn("_above", F.collect_set(F.when(F.col("relation.score") >= SURE, F.col("relation.parent_ord"))).over(P.sheet()))
    return d.withColumn("relation", F.when(F.col("_in_run") | ~F.array_contains("_above", F.col("ord")), F.col("relation"))).drop("_in_run", "_above")


def with_chain(c: DataFrame, band: float = 60.0) -> DataFrame:
    """Candidates with parts (part_ord, part_mm): the pieces along each overall mark; null for others.

    Seeds name the overall, or are named by it within 160 points; the larger of a pair may be one. The two farthest seeds (or the
    only one and the overall) give the direction. Pieces lie in a band around it, and on the overall's line if it has one.
    """
    if "parts" in c.columns:
        return c
    b, c = P.OWN, P.pair_table(c)
    fits = F.filter("_sheet", lambda a: (a["value_mm"] >= 300) & (a["value_mm"] < b["value_mm"]) & ~a["f_overall_mark"])

    def piece(a):
        seed = P.mentions(a, b) | (P.mentions(b, a) & (P.d2(a, b) <= 160.0 * 160.0))
        lies = ~a["f_overall_pair"] & ~a["_apart"] & (b["line"].isNull() | F.coalesce(_projects(a, b), F.lit(False)))
        return F.struct(a["ord"].alias("ord"), a["x"].alias("x"), a["y"].alias("y"), a["value_mm"].alias("mm"), seed.alias("seed"), lies.alias("piece"))

    d = c.withColumn("_all", F.when(b["f_overall_mark"], F.transform(fits, piece))).withColumn("_seeds", F.filter("_all", lambda s: s["seed"]))
    two = F.flatten(F.transform("_seeds", lambda s: F.transform(F.filter("_seeds", lambda t: t["ord"] > s["ord"]), lambda t: F.struct(((t["x"] - s["x"]) * (t["x"] - s["x"]) + (t["y"] - s["y"]) * (t["y"] - s["y"])).alias("d"), (-s["ord"]).alias("i"), (-t["ord"]).alias("j"), (t["x"] - s["x"]).alias("ux"), (t["y"] - s["y"]).alias("uy")))))
    only = F.struct((F.get("_seeds", F.lit(0))["x"] - b["x"]).alias("ux"), (F.get("_seeds", F.lit(0))["y"] - b["y"]).alias("uy"))
    d = d.withColumn("_far", F.when(F.size("_seeds") > 1, F.array_max(two)))
    d = d.withColumn("_way", F.when(F.size("_seeds") == 1, only).when(F.size("_seeds") > 1, F.struct("_far.ux", "_far.uy")))

    def inside(p):
        cross = (p["x"] - b["x"]) * F.col("_way.uy") - (p["y"] - b["y"]) * F.col("_way.ux")
        return p["piece"] & (cross * cross <= band * band * (F.col("_way.ux") * F.col("_way.ux") + F.col("_way.uy") * F.col("_way.uy")))

    parts = F.transform(F.filter("_all", inside), lambda p: F.struct(p["ord"].alias("part_ord"), p["mm"].alias("part_mm")))
    return d.withColumn("parts", F.when((F.col("_way.ux") != 0) | (F.col("_way.uy") != 0), parts)).drop("_all", "_seeds", "_far", "_way")


def chain_parts(c: DataFrame) -> DataFrame:
    """sheet_no, ord, length, part_ord, part_mm: the pieces along each overall mark."""
    return with_chain(c).select("sheet_no", "ord", F.col("value_mm").alias("length"), F.explode(F.array_compact("parts")).alias("p")).select("sheet_no", "ord", "length", "p.part_ord", "p.part_mm")


def covers(total: Column, length: Column) -> Column:
    """Whether pieces make up a length: 0.97 of it, or all but 80 mm."""
    return (total >= length * 0.97) | (length - total <= 80)


def chain_cover(parts: DataFrame) -> DataFrame:
    """sheet_no, ord, n_parts, sum_parts, covers: whether the pieces make up the length."""
    g = parts.groupBy("sheet_no", "ord", "length").agg(F.count("*").alias("n_parts"), F.sum("part_mm").cast("long").alias("sum_parts"))
    return g.select("sheet_no", "ord", "n_parts", "sum_parts", covers(F.col("sum_parts"), F.col("length")).alias("covers"))


def sure_relations(c: DataFrame, write=lambda d: d) -> DataFrame:
    """sheet_no, ord, parent_ord, score, dist of the candidates that have a relation; ``write`` may make a table of them."""
    return write(P.having(with_relation(c), "relation"))
