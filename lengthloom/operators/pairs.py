"""Pairs of candidates inside a sheet: neighbours, overlaps, envelopes, parents.

A row carries the other candidates of its sheet as an array, so all of a sheet's relations are columns of its rows: lines are
shuffled once, by sheet, and no pair is a row of its own. a and b are a pair's candidates, read by name (a row's own columns, or an item of the array).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame

from ..arrays import F, Window
#: Radii and limits of the drawing rules, in points and millimetres.
NEAR, NEAREST_SHOWN = 55.0, 12
#: Fixed value: from here on (mm) an LT beside a value makes it an overall.
LT_LEAST = 2500
#: A support mark in a joined list of neighbours, as relations read it; a neighbour that is a support tag; a number in a balloon.
SUPPORT, SUPPORT_TAG = r"(?iU)\b[ОOФF][0-9]+", r"(?iU)(^|\|)\s*[ОOФFПP][0-9]+[АAБB]?\s*($|\|)"
BALLOON = "<[0-9]+>"


def sheet():
    return Window.partitionBy("sheet_no")


class _Own:
    """A row's own columns, read as those of an item of its sheet are."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


OWN = _Own()


def d2(a, b) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return dx * dx + dy * dy


def gathered(c: DataFrame, *columns: str | Column) -> DataFrame:
    """c with _sheet: those columns of its sheet's rows, itself included. A row without a sheet has none. The key is the sheet."""
    return c.withColumn("_sheet", F.collect_list(F.when(F.col("sheet_no").isNotNull(), F.struct(*columns))).over(sheet()))


def others(near) -> Column:
    """The other rows of the sheet for which near holds."""
    return F.filter("_sheet", lambda b: (b["ord"] != F.col("ord")) & near(b))


def exists(when, may: Column | bool = True) -> Column:
    """Whether when holds for one of the sheet; rows that may not are spared the look."""
    return F.coalesce(F.when(F.lit(may) if isinstance(may, bool) else may, F.exists("_sheet", when)), F.lit(False))


def having(d: DataFrame, name: str) -> DataFrame:
    """sheet_no, ord and the fields of a struct, of the rows that have it; unlike a filter it isn't moved below the steps that make the struct, which would be run twice."""
    return d.select("sheet_no", "ord", F.explode(F.array_compact(F.array(name))).alias("m")).select("sheet_no", "ord", "m.*")


#: What operators on pairs read of a candidate, and what no rule reads once its pairs are judged.
PLACES = ("x", "y", "dir_x", "dir_y", "line", "x1", "y1", "x2", "y2", "offset", "nearby")
PAIRED = ("ord", "cid", "value_mm", "nums", "f_overall_mark", "f_overall_pair", "f_nested_offset", *PLACES[:-1])
SEEN = ("_value", "_support", "_bare")
#: Columns that say of a candidate that nothing is a part of it, or that it is a part of nothing itself.
WHOLE, APART = ("f_overall_mark", "f_overall_pair", "lt", "f_pipe_opening"), ("f_handwheel", "f_insulation_thickness")


def pair_table(c: DataFrame) -> DataFrame:
    """Candidates with _sheet, the others of their sheet, which every operator on pairs reads; made once."""
    if "_sheet" in c.columns:
        return c
    d = c.withColumns({"_value": F.col("value_mm").cast("string"), "_support": F.col("nearby").rlike(SUPPORT), "_bare": ~F.col("nearby").rlike(BALLOON)})
    placed = F.col("sheet_no").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    flags = [any_of(names).alias(k) for k, names in (("_whole", WHOLE), ("_apart", APART)) if set(names) <= set(d.columns)]
    kept = [n for n in (*PAIRED, *SEEN) if n in d.columns]
    d = d.withColumn("_sheet", F.collect_list(F.when(placed, F.struct(*kept, *flags))).over(sheet()))
    return d.withColumn("_sheet", F.filter("_sheet", lambda b: placed & (b["ord"] != F.col("ord"))))


def any_of(names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, map(F.col, names))


def _near_texts(c: DataFrame) -> DataFrame:
    """Candidates with _near, the texts of each candidate within 55 points, in order.

    A candidate's own texts are its value, the support mark beside it and a note (null where there is none).
    """
    texts = F.array_compact(F.array(F.col("value_mm").cast("string"), F.when(F.col("has_support"), F.concat(F.lit("О"), F.col("ord").cast("string"))), F.col("note")))
    near = others(lambda b: d2(OWN, b) <= NEAR * NEAR)
    return gathered(c, "ord", "x", "y", texts.alias("t")).withColumn("_near", F.sort_array(F.transform(near, lambda b: F.struct(b["ord"].alias("o"), b["t"].alias("t"))))).drop("_sheet")


def _joined() -> Column:
    return F.array_join(F.slice(F.array_distinct(F.flatten("_near.t")), 1, NEAREST_SHOWN), " | ")


def neighbour_text(c: DataFrame) -> DataFrame:
    """sheet_no, ord, nearby: texts within 55 points, distinct in order, the first 12, joined by a bar."""
    return _near_texts(c).filter(F.size("_near") > 0).select("sheet_no", "ord", _joined().alias("nearby"))


def with_neighbours(c: DataFrame) -> DataFrame:
    """Candidates with nearby (empty where nothing is near), nums, the digit runs in it, and lt."""
    d = _near_texts(c).withColumn("nearby", _joined()).drop("_near")
    return d.withColumns({"nums": F.regexp_extract_all("nearby", F.lit("[0-9]+"), F.lit(0)), "lt": beside_lt()})


def beside_lt() -> Column:
    """Whether LT stands beside a value that is long enough to be an overall for it."""
    return (F.col("value_mm") >= LT_LEAST) & F.upper("nearby").rlike(r"(^|\|)\s*LT\s*($|\|)")


def mentions(a, b) -> Column:
    """Whether a's neighbours name b's value as a number of its own."""
    return F.array_contains(a["nums"], b["_value"])


def holds(a, b) -> Column:
    """Whether a's neighbours contain the digits of b's value anywhere."""
    return F.contains(a["nearby"], b["_value"])


def with_overlaps(c: DataFrame) -> DataFrame:
    """Candidates with f_nested_offset (the smaller of overlapping candidates) and f_overall_pair (the larger)."""
    envelope = (F.col("value_mm") >= 8000) | F.col("f_overall_mark")
    d = c.withColumns({"_value": F.col("value_mm").cast("string"), "_tag": F.col("nearby").rlike(SUPPORT_TAG), "_envelope": envelope})
    d = gathered(d, "ord", "value_mm", "x", "y", "nearby", "_value", "_tag", "_envelope")
    d = d.withColumn("_sheet", others(lambda b: (b["value_mm"] != F.col("value_mm")) & (d2(OWN, b) <= 28.0 * 28.0) & (holds(OWN, b) | holds(b, OWN))))

    def judged(lo, hi):
        r = hi["value_mm"] / lo["value_mm"]
        close, stacked = r.between(1.08, 1.55), r.between(2.0, 3.5)
        nested = close | (stacked & lo["_tag"] & ~hi["_envelope"])
        return nested, stacked & hi["_envelope"] & ~F.coalesce(nested, F.lit(False))

    small, large = exists(lambda b: (b["value_mm"] > F.col("value_mm")) & judged(OWN, b)[0]), exists(lambda b: (b["value_mm"] < F.col("value_mm")) & judged(b, OWN)[1])
    return d.withColumns({"f_nested_offset": small, "f_overall_pair": large}).drop("_sheet", "_value", "_tag", "_envelope")


def overlap_flags(c: DataFrame) -> DataFrame:
    """sheet_no, ord, flag: nested_offset for the smaller, overall_pair for the larger of overlapping candidates."""
    flags = F.array_compact(F.array(*(F.when(F.col(f"f_{f}"), F.lit(f)) for f in ("nested_offset", "overall_pair"))))
    return with_overlaps(c).select("sheet_no", "ord", F.explode(flags).alias("flag"))


def text_score(a, b) -> Column:
    """How surely b is the parent of a, by what their neighbours say; 0 if it isn't. Overalls, openings and what is no length have no parts."""
    r, d = a["value_mm"] / b["value_mm"], d2(a, b)
    along = a["dir_x"] * b["dir_x"] + a["dir_y"] * b["dir_y"] >= 0.985
    barred = a["f_overall_mark"] | a["f_overall_pair"] | b["_whole"] | b["_apart"]
    one, other = mentions(a, b), mentions(b, a)
    return (
        F.when(~along | ~r.between(0.15, 0.90) | (d > 190.0 * 190.0) | barred, 0.0)
        .when((r >= 0.65) & (d <= 75.0 * 75.0) & one & other, 0.9).when((a["_support"] | b["_support"]) & (one | other), 0.85).when(a["_support"] & (d >= 35.0 * 35.0), 0.7).otherwise(0.0)
    )


def with_parent(c: DataFrame) -> DataFrame:
    """Candidates with up (score, ord, value_mm, x, y of the best larger candidate by neighbours; null without one); the first in order wins a tie."""
    c = pair_table(c)
    near = F.filter("_sheet", lambda b: (b["value_mm"] > F.col("value_mm")) & (d2(OWN, b) <= 190.0 * 190.0))
    best = F.array_max(F.transform(near, lambda b: F.struct(text_score(OWN, b).alias("score"), (-b["ord"]).alias("o"), b["value_mm"].alias("value_mm"), b["x"].alias("x"), b["y"].alias("y"))))
    return c.withColumn("up", best).withColumn("up", F.when(F.col("up.score") > 0, F.struct("up.score", (-F.col("up.o")).alias("ord"), "up.value_mm", "up.x", "up.y")))


def best_parents(c: DataFrame) -> DataFrame:
    """sheet_no, ord, parent_ord, score: the best larger candidate; the first in order wins a tie."""
    return having(with_parent(c).withColumn("m", F.when(F.col("up").isNotNull(), F.struct(F.col("up.ord").alias("parent_ord"), "up.score"))), "m")


def with_edge(c: DataFrame, least: float = 0.75) -> DataFrame:
    """Candidates with edge, the best parent if it is sure enough and the candidate isn't a parent itself: nesting is one level deep."""
    d = with_parent(c).withColumn("_sure", F.when(F.col("up.score") >= least, F.col("up.ord")))
    d = d.withColumn("_above", F.collect_set("_sure").over(sheet()))
    return d.withColumn("edge", F.when(~F.array_contains("_above", F.col("ord")), F.col("_sure"))).drop("_sure", "_above")


def nesting(c: DataFrame) -> DataFrame:
    """sheet_no, ord, parent_ord, score of the edges."""
    return having(with_edge(c).withColumn("m", F.when(F.col("edge").isNotNull(), F.struct(F.col("edge").alias("parent_ord"), "up.score"))), "m")


def given_edges(c: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates with edge, the parent_ord that a table of edges (sheet_no, ord, parent_ord) has for them, and edge_parent, whether it names them as one."""
    above = edges.select("sheet_no", F.col("parent_ord").alias("ord"), F.lit(True).alias("edge_parent")).distinct()
    return pair_table(c).join(edges.select("sheet_no", "ord", F.col("parent_ord").alias("edge")), ["sheet_no", "ord"], "left").join(above, ["sheet_no", "ord"], "left")


def surrounds(a, b) -> Column:
    """Whether a is so much larger than b and so near that it is its overall."""
    r, d = a["value_mm"] / b["value_mm"], d2(a, b)
    large = (a["value_mm"] >= 8000) & (b["value_mm"] >= 800) & (r >= 2.2)
    return large & ((d <= 28.0 * 28.0) | ((d <= NEAR * NEAR) & (r >= 4.0) & (b["value_mm"] >= 2000) & holds(a, b)))


def continues(a, b) -> Column:
    lo, hi = F.least(a["value_mm"], b["value_mm"]), F.greatest(a["value_mm"], b["value_mm"])
    return (d2(a, b) <= 45.0 * 45.0) & (lo >= 500) & (hi / lo).between(1.5, 2.8)


def twin(a, b) -> Column:
    lo, hi = F.least(a["value_mm"], b["value_mm"]), F.greatest(a["value_mm"], b["value_mm"])
    return (hi < 8000) & (hi / lo <= 1.35) & (d2(a, b) >= 1600.0) & mentions(a, b)


def with_mentioned(c: DataFrame) -> DataFrame:
    """Candidates with _mentioned, the smaller ones that they name or that name them, and _part, whether one of those is a nested offset by its neighbours."""
    if "_mentioned" in c.columns:
        return c
    smaller = F.filter("_sheet", lambda b: (b["value_mm"] < F.col("value_mm")) & (mentions(OWN, b) | mentions(b, OWN)))
    d = c.withColumn("_smaller", F.transform(smaller, lambda b: F.struct(b["ord"].alias("ord"), b["f_nested_offset"].alias("nested"))))
    return d.withColumns({"_part": F.coalesce(F.exists("_smaller", lambda b: b["nested"]), F.lit(False)), "_mentioned": F.coalesce("_smaller.ord", F.array().cast("array<int>"))}).drop("_smaller")


def with_parts(c: DataFrame) -> DataFrame:
    """Candidates that have edge, with edge_parent (of others) and has_part: they name a smaller nested offset or are named by one; who has an edge is one."""
    d = c.withColumns({"_above": F.collect_set("edge").over(sheet()), "_nested": F.collect_set(F.when(F.col("edge").isNotNull(), F.col("ord"))).over(sheet())})
    d = with_mentioned(d)
    part = F.col("_part") | F.arrays_overlap("_mentioned", "_nested")
    above = F.array_contains("_above", F.col("ord"))
    if "edge_parent" in c.columns:
        above = above | F.coalesce("edge_parent", F.lit(False))
    return d.withColumns({"edge_parent": above, "has_part": part}).drop("_above", "_nested", "_part", "_mentioned")


def with_facts(c: DataFrame) -> DataFrame:
    """What the rules ask of a candidate's pairs: beside, target, continues_raw and twin.

    target: the first candidate (ord, cid, value_mm) that it mentions and surrounds; twin: the first mentioned one of like length.
    """
    first = lambda when, may: F.when(may, F.array_min(F.transform(F.filter("_sheet", when), lambda b: F.struct(b["ord"].alias("ord"), b["cid"].alias("cid"), b["value_mm"].alias("value_mm")))))
    long, v = F.col("value_mm") >= 8000, F.col("value_mm")
    facts = {
        "beside": exists(lambda b: surrounds(OWN, b), long), "target": first(lambda b: surrounds(OWN, b) & mentions(OWN, b), long),
        "twin": first(lambda b: twin(OWN, b), v < 8000),
    }
    return with_continues(c if "twin" in c.columns else c.withColumns(facts))


def run_parents(c: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """sheet_no, ord of candidates without a parent that have a part: by an edge, or a smaller nested offset that names them or is named.

    edges: a table of them; without it c has edge.
    """
    d = with_parts(c if edges is None else given_edges(c, edges))
    return d.filter(F.col("edge").isNull() & (F.col("edge_parent") | F.col("has_part"))).select("sheet_no", "ord")


def with_continues(c: DataFrame) -> DataFrame:
    """Candidates with continues_raw: a neighbour within 45 points continues them."""
    return c if "continues_raw" in c.columns else c.withColumn("continues_raw", exists(lambda b: continues(OWN, b), F.col("value_mm") >= 500))


def sequential(c: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Candidates without a parent and with a neighbour within 45 points that continues them: both at least 500, ratio 1.5 to 2.8."""
    d = c if edges is None else given_edges(c, edges)
    return with_continues(d).filter(F.col("edge").isNull() & F.col("continues_raw")).select("sheet_no", "ord")


def envelopes(c: DataFrame) -> DataFrame:
    """Pairs of a large candidate and a smaller one that it surrounds."""
    small = F.filter("_sheet", lambda b: surrounds(OWN, b))
    return pair_table(c).select("sheet_no", F.col("ord").alias("large_ord"), F.explode(F.transform(small, lambda b: b["ord"])).alias("small_ord"))


def twins(c: DataFrame) -> DataFrame:
    """sheet_no, ord, twin_ord: the first mentioned candidate of like length that lies apart."""
    first = F.array_min(F.transform(F.filter("_sheet", lambda b: twin(OWN, b)), lambda b: b["ord"]))
    return having(pair_table(c).withColumn("m", F.get(F.transform(F.array_compact(F.array(first)), lambda t: F.struct(t.alias("twin_ord"))), F.lit(0))), "m")


def overall_argmax(c: DataFrame, reach: float = 90.0) -> DataFrame:
    """For each overall mark, the largest candidate within reach; the first in order wins a tie."""
    d = gathered(c, "ord", "value_mm", "x", "y").filter("f_overall_mark")
    m = F.array_max(F.transform(others(lambda b: d2(OWN, b) <= reach * reach), lambda b: F.struct(b["value_mm"].alias("value_mm"), (-b["ord"]).alias("o"))))
    return having(d.withColumn("m", m), "m").select("sheet_no", "ord", (-F.col("o")).alias("target_ord"), F.col("value_mm").alias("target_value"))


def with_other_runs(c: DataFrame, asked: Column | bool = True) -> DataFrame:
    """Candidates with problems (parent_ord, problem): long parents from which their neighbours or their place take them.

    mentions: a number beside the piece is another candidate's value and over 0.45 of the parent. closer: another candidate
    of 8000 or more is nearer by over 25 points. Rows for which asked doesn't hold have none.
    """
    c = pair_table(c)
    d = c.withColumn("_long", F.transform("nums", lambda n: n.try_cast("long")))
    item = lambda b: F.struct(b["ord"].alias("ord"), b["value_mm"].alias("v"), F.sqrt(d2(OWN, b)).alias("d"), F.array_contains("_long", b["value_mm"].cast("long")).alias("named"))
    d = d.withColumn("_all", F.when((F.lit(asked) if isinstance(asked, bool) else asked) & (F.col("value_mm") >= 250) & F.exists("_sheet", lambda b: b["value_mm"] >= 8000), F.transform("_sheet", item)))

    def found(p):
        named = F.exists("_all", lambda x: x["named"] & (x["ord"] != p["ord"]) & (x["v"] != F.col("value_mm")) & (x["v"] != p["v"]) & (x["v"] > p["v"] * 0.45))
        closer = F.exists("_all", lambda x: (x["ord"] != p["ord"]) & (x["v"] >= 8000) & (x["d"] + 25 < p["d"]))
        one = lambda when, name: F.when(when, F.struct(p["ord"].alias("parent_ord"), F.lit(name).alias("problem")))
        return F.array_compact(F.array(one(named, "mentions"), one(closer, "closer")))

    long = F.filter("_all", lambda x: (x["v"] >= 8000) & (x["v"] > F.col("value_mm")))
    return d.withColumn("problems", F.flatten(F.transform(long, found))).drop("_long", "_all")


def other_runs(c: DataFrame) -> DataFrame:
    """sheet_no, ord, parent_ord, problem: pieces that their neighbours or their place give to another run than a long parent."""
    return with_other_runs(c).select("sheet_no", "ord", F.explode(F.array_compact("problems")).alias("p")).select("sheet_no", "ord", "p.parent_ord", "p.problem")
