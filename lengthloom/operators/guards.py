"""The whole chain of corrections on a sheet's decisions: each rule sees what the ones before it left, and says what it did.

A row carries its decision, its role and reason (null where nobody gave one) and a log. Passes run over a sheet's rows in order, so an entry
of the log is ordered by pass, row and place in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..arrays import F, Window
from . import lines as L
from . import marks as M
from . import pairs as P
from . import rules as R
from .rules import INCLUDE, NESTED, OPEN, OTHER

#: Roles, and words of reasons that rules read: a coordinate, reasons that keep a row nested, a place inside another.
MAIN, SAME, PART = "main", "overall_same_run", "support_offset"
COORDINATE, KEPT_NESTED, INSIDE = r"(?iU)z\+|координата z|вертикальная координата", r"н\.о|цепочка|полный размер|lt", "внутри"
ENTRY = "struct<pass:int,at:int,sub:int,text:string>"


def known(c: DataFrame) -> DataFrame:
    """Candidates of pair_table that have edge (a sure parent's ord, or null) with what the rules ask: parent (ord, cid, value_mm), edge_parent, is_parent, beside, continues, target, twin, lt, stamp, opening.

    Who has a sure parent is a nested offset too.
    """
    c = c if "_sheet" in c.columns else P.gathered(c, "ord", "cid", "value_mm")
    up = F.get(F.filter("_sheet", lambda b: b["ord"] == F.col("edge")), F.lit(0))
    d = P.with_facts(P.with_parts(c)).withColumn("parent", F.when(F.col("edge").isNotNull(), up))
    stamp = F.col("f_stamp") | F.col("nearby").rlike(M.PARTS_TABLE) | F.col("nearby").rlike(M.TITLE)
    d = d.withColumns({"lt": P.beside_lt(), "stamp": stamp, "opening": F.col("f_pipe_opening") | F.col("nearby").rlike(M.OPENING), "has_parent": F.col("parent").isNotNull(), "parent": F.struct("parent.ord", "parent.cid", "parent.value_mm")})
    d = R.facts(d.drop("_sheet", *P.SEEN, *P.PLACES))  # narrow rows for what is sorted below
    d = d.withColumn("f_nested_offset", F.col("f_nested_offset") | F.col("has_parent"))
    d = d.withColumns({"is_parent": (F.col("edge_parent") | F.col("has_part")) & ~F.col("has_parent"), "continues": F.col("continues_raw") & ~F.col("has_parent")})
    return d.withColumns({"wheel": F.col("f_handwheel") | (F.col("wheel_value") & ~F.col("opening")), "log": F.array().cast(f"array<{ENTRY}>")})


def facts(c: DataFrame, pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The same for edges from a table: sheet_no, ord, parent_ord of sure relations. pairs: pair_table of the candidates."""
    return known(P.given_edges(c.join(pairs.select("sheet_no", "ord", "_sheet", *P.SEEN), ["sheet_no", "ord"]), edges))


def _is(*kinds: str) -> Column:
    return F.col("decision").isin(*kinds)


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _own(text: str) -> Column:
    return _text(F.col("cid"), " " + text)


def rule(d: DataFrame, place: tuple[int, int], when: Column, decision: str | None, role: str | Column, reason: str | Column, say: Column | None = None, heard: Column | None = None) -> DataFrame:
    """One correction: rows for which ``when`` holds get decision, role and reason; ``say`` goes to the log where ``heard`` holds too."""
    new = {"role": role, "reason": reason} | ({"decision": decision} if decision else {})
    cols = {k: F.when(when, F.lit(v) if isinstance(v, str) else v).otherwise(F.col(k)) for k, v in new.items()}
    if say is not None:
        entry = F.struct(F.lit(place[0]).alias("pass"), F.col("ord").alias("at"), F.lit(place[1]).alias("sub"), say.alias("text"))
        cols["log"] = F.when(when if heard is None else when & heard, F.array_append("log", entry)).otherwise(F.col("log"))
    return d.withColumns(cols)


def row_rules(d: DataFrame) -> DataFrame:
    """The first pass, rules on one row: overalls, the larger of a pair, handwheels, insulation, stamps, repeats, coordinates, tiny values.

    The larger of a pair that has a part is a whole run, and none of the later rules of this pass touches it.
    """
    was = _is(INCLUDE)
    d = rule(d, (1, 0), F.col("f_overall_mark") & _is(INCLUDE, NESTED), NESTED, SAME, "метка Н.О.", _own("габарит Н.О."), was)
    d = d.withColumn("_whole", F.col("f_overall_pair") & F.col("is_parent") & _is(INCLUDE, NESTED))
    d = rule(d, (1, 1), F.col("_whole") & ~was, INCLUDE, MAIN, "полный участок, не габарит", _own("полный участок"))
    on = ~F.col("_whole")
    d = rule(d, (1, 2), on & F.col("f_overall_pair") & _is(INCLUDE, NESTED), NESTED, SAME, "габарит поверх соседнего", _own("габарит пара"), was)
    d = rule(d, (1, 3), on & F.col("lt") & _is(INCLUDE, NESTED), NESTED, SAME, "габарит LT", _own("габарит LT"), was)
    d = rule(d, (1, 4), on & F.col("wheel") & _is(INCLUDE, OPEN), OTHER, "valve", "штурвал", _own("штурвал"))
    d = rule(d, (1, 5), on & F.col("f_insulation_thickness") & _is(INCLUDE, OPEN), OTHER, "other", "толщина изоляции", _own("толщина изоляции"))
    d = rule(d, (1, 6), on & F.col("stamp") & _is(INCLUDE, OPEN), OTHER, "bom", "штамп/спецификация", _own("штамп"))
    d = rule(d, (1, 7), on & F.col("support_repeat") & was, OTHER, PART, "повтор опоры", _own("опора"))
    d = rule(d, (1, 8), on & F.col("f_near_plant_coord") & (F.col("value_mm") >= 9000) & was, OTHER, "other", "координата узла", _own("координата"))
    d = rule(d, (1, 9), on & (F.col("value_mm") <= 16) & _is(INCLUDE, OPEN), OTHER, "other", "номер позиции", _own("не длина"))
    return rule(d, (1, 10), on & F.col("small_repeat") & _is(INCLUDE, OPEN), OTHER, "other", "повтор мелкого", _own("мелкий повтор")).drop("_whole")


def nest_offsets(d: DataFrame) -> DataFrame:
    """A candidate with a sure parent, and a nested offset, is nested; overalls only with a parent or a part."""
    overall = (F.col("f_overall_mark") | F.col("f_overall_pair")) & ~F.col("has_parent") & ~F.col("is_parent")
    when = (F.col("has_parent") | F.col("f_nested_offset")) & ~overall & _is(INCLUDE, OPEN, NESTED)
    reason = F.when(F.col("has_parent"), _text("внутри ", F.col("parent.cid"), "=", F.col("parent.value_mm"))).otherwise("размер до опоры")
    return rule(d, (2, 0), when, NESTED, PART, reason, _text(F.col("cid"), " внутри ", F.coalesce("parent.cid", F.lit("участка"))), _is(INCLUDE, OPEN))


def restore_nested(d: DataFrame) -> DataFrame:
    """A nested candidate without a parent comes back, but for overalls, stamps, shells around others and reasons that keep it."""
    d = d.withColumn("_was", _is(NESTED))
    whole = F.col("_was") & F.col("f_overall_pair") & F.col("is_parent")
    free = F.col("_was") & ~whole & ~(F.col("f_overall_mark") | F.col("f_overall_pair") | F.col("lt") | F.col("stamp") | F.col("has_parent"))
    over, shell = free & F.col("edge_parent"), free & ~F.col("edge_parent") & F.col("beside")
    held = shell & ~F.col("is_parent") & ~F.col("continues")
    known = F.lower(F.coalesce("reason", F.lit(""))).rlike(KEPT_NESTED)
    d = d.withColumns({"_whole": whole | (shell & F.col("is_parent")), "_over": over, "_held": held, "_free": free & ~over & ~(shell & F.col("is_parent")) & ~held & ~known})
    d = rule(d, (3, 0), F.col("_whole"), INCLUDE, MAIN, "полный участок, не габарит", _own("вернул полный участок"))
    d = rule(d, (3, 0), F.col("_over"), INCLUDE, MAIN, "полный участок над размером до опоры", _own("вернул полный участок"))
    d = rule(d, (3, 0), F.col("_held"), None, SAME, "габарит рядом")
    return rule(d, (3, 0), F.col("_free"), INCLUDE, MAIN, "участок, не вложенный", _own("вернул участок")).drop("_was", "_whole", "_over", "_held", "_free")


def _no_length() -> Column:
    return F.col("f_handwheel") | F.col("f_insulation_thickness") | F.col("support_repeat") | F.col("stamp")


def restore_lengths(d: DataFrame) -> DataFrame:
    """What was called no length comes back, unless one of the reasons for it holds."""
    held = _no_length() | F.col("wheel") | (F.col("value_mm") <= 16) | F.col("small_repeat") | (F.col("f_near_plant_coord") & (F.col("value_mm") >= 9000))
    return rule(d, (4, 0), _is(OTHER) & ~held, INCLUDE, MAIN, "размер участка", _own("вернул длину"))


def take_openings(d: DataFrame) -> DataFrame:
    """Pieces at an opening are lengths, unless an overall, a stamp or another reason holds, or they are nested in a parent or as an offset."""
    held = _no_length() | F.col("f_overall_mark") | F.col("f_overall_pair") | F.col("lt") | (F.col("value_mm") <= 16)
    held = held | (_is(NESTED) & (F.col("f_nested_offset") | F.col("has_parent")))
    role = F.when(F.col("role") == "other", "branch").otherwise(F.coalesce("role", F.lit(MAIN)))
    return rule(d, (5, 0), F.col("opening") & _is(OTHER, OPEN, NESTED) & ~held, INCLUDE, role, "отверстие/врезка/съёмный", _own("отверстие в сумму"))


def resolve_shells(d: DataFrame) -> DataFrame:
    """Included candidates that surround one they mention, in order: a parent of others nests that one, any other itself.

    A row that an earlier one has nested does nothing. The fold runs over the few rows of a sheet that have a target, with the state of
    their targets, and gives who nested whom.
    """
    state = F.struct("ord", "cid", "value_mm", F.col("target.ord").alias("t_ord"), F.col("target.cid").alias("t_cid"), F.col("target.value_mm").alias("t_value"), "is_parent")
    w = Window.partitionBy("sheet_no")
    steps = F.sort_array(F.collect_list(F.when(_is(INCLUDE) & ~F.col("continues") & F.col("target").isNotNull(), state)).over(w))
    free = F.collect_set(F.when(_is(INCLUDE) & ~F.col("f_overall_mark"), F.col("ord"))).over(w)
    d = d.withColumns({"_steps": steps, "_free": free})
    done = lambda out, o: F.exists(out, lambda x: x["ord"] == o)

    def entry(o, by, by_cid, by_value, inner):
        return F.struct(o.alias("ord"), by.alias("by"), by_cid.alias("cid"), by_value.alias("value_mm"), F.lit(inner).alias("inner"))

    def step(out, s):
        may = F.array_contains(F.col("_free"), s["t_ord"]) & (s["t_value"] < s["value_mm"]) & ~done(out, s["t_ord"])
        own = F.array_append(out, entry(s["ord"], s["ord"], s["t_cid"], s["t_value"], False))
        other = F.array_append(out, entry(s["t_ord"], s["ord"], s["cid"], s["value_mm"], True))
        return F.when(done(out, s["ord"]), out).when(~s["is_parent"], own).when(may, other).otherwise(out)

    fold = F.aggregate("_steps", F.array().cast("array<struct<ord:int,by:int,cid:string,value_mm:int,inner:boolean>>"), step)
    d = d.withColumn("_hit", F.get(F.filter(fold, lambda x: x["ord"] == F.col("ord")), 0)).drop("_steps", "_free")
    hit, inner = F.col("_hit").isNotNull(), F.coalesce(F.col("_hit.inner"), F.lit(False))
    said = F.when(inner, _text(F.col("cid"), " внутри ", F.col("_hit.cid"))).otherwise(_text(F.col("cid"), " габарит рядом с ", F.col("_hit.cid")))
    log = F.array_append("log", F.struct(F.lit(6).alias("pass"), F.col("_hit.by").alias("at"), F.lit(0).alias("sub"), said.alias("text")))
    reason = F.when(inner, _text("внутри ", F.col("_hit.cid"), "=", F.col("_hit.value_mm"))).otherwise(_text("габарит рядом с ", F.col("_hit.cid")))
    new = {"decision": F.lit(NESTED), "role": F.when(inner, PART).otherwise(SAME), "reason": reason, "log": log}
    return d.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()}).drop("_hit")


def restore_coordinates(d: DataFrame) -> DataFrame:
    """A shorter length that was left out for the coordinate beside it comes back."""
    role = F.when(F.col("role").isin(SAME, "other"), MAIN).otherwise(F.col("role"))
    when = _is(OTHER, NESTED) & ~F.col("f_overall_mark") & ~F.col("f_overall_pair") & (F.col("value_mm") < 8000) & F.col("f_near_plant_coord") & F.coalesce("reason", F.lit("")).rlike(COORDINATE)
    return rule(d, (7, 0), when, INCLUDE, role, "длина, рядом координата", _own("не координата"))


def restore_twins(d: DataFrame) -> DataFrame:
    """A nested candidate without a parent comes back if it mentions a twin of like length."""
    when = _is(NESTED) & ~F.col("f_overall_mark") & ~F.col("f_overall_pair") & ~F.col("f_nested_offset") & ~F.col("has_parent") & F.col("twin").isNotNull()
    role = F.when(F.col("role") == SAME, MAIN).otherwise(F.col("role"))
    return rule(d, (8, 0), when, INCLUDE, role, _text("два прогона с ", F.col("twin.cid")), _text(F.col("cid"), " два прогона с ", F.col("twin.cid")))


def restore_orphans(d: DataFrame) -> DataFrame:
    """A nested candidate comes back if its reason names only smaller values, or if none of the larger values beside it counts. All look at one state."""
    w = Window.partitionBy("sheet_no")
    d = d.withColumns({"_values": F.collect_set("value_mm").over(w), "_counted": F.collect_set(F.when(_is(INCLUDE), F.col("value_mm"))).over(w)})
    reason = F.coalesce("reason", F.lit(""))
    cited = F.transform(F.regexp_extract_all(reason, F.lit("[0-9]+"), F.lit(0)), lambda n: n.try_cast("long"))
    smaller = F.contains(F.lower(reason), F.lit(INSIDE)) & (F.size(cited) > 0) & ~F.exists(cited, lambda n: n >= F.col("value_mm"))
    larger = F.filter(F.array_intersect(F.transform("nums", lambda n: n.try_cast("int")), F.col("_values")), lambda n: n > F.col("value_mm"))
    orphan = (F.size(larger) > 0) & ~F.arrays_overlap(larger, "_counted")
    when = _is(NESTED) & ~F.col("f_overall_mark") & ~F.col("f_overall_pair") & ~F.col("lt") & ~F.col("f_nested_offset") & (F.coalesce("role", F.lit("")) != PART)
    d = d.withColumns({"_smaller": when & smaller, "_orphan": when & ~smaller & orphan}).drop("_values", "_counted")
    role = F.coalesce("role", F.lit(MAIN))
    d = rule(d, (9, 0), F.col("_smaller"), INCLUDE, role, "не вложен в меньшее", _own("вернул в сумму"))
    return rule(d, (9, 0), F.col("_orphan"), INCLUDE, role, "родитель не в сумме", _own("вернул в сумму")).drop("_smaller", "_orphan")


def cover_marks(d: DataFrame) -> DataFrame:
    """An overall mark counts if its chain of pieces (parts, covers) doesn't cover it, and then the pieces don't; else they do. Nested marks stay.

    A piece of several uncovered overalls goes to the first.
    """
    covered = F.coalesce("covers", F.lit(False))
    d = d.withColumn("_mark", F.col("f_overall_mark") & ~F.col("has_parent"))
    pieces = F.when(F.col("_mark") & ~covered, F.transform("parts", lambda p: F.struct(F.col("ord").alias("ord"), F.col("cid").alias("cid"), p["part_ord"].alias("part"))))
    d = d.withColumn("_over", F.flatten(F.collect_list(pieces).over(P.sheet())))
    d = d.withColumn("_over", F.array_min(F.transform(F.filter("_over", lambda p: p["part"] == F.col("ord")), lambda p: F.struct(p["ord"].alias("ord"), p["cid"].alias("cid")))))
    d = rule(d, (10, -1), F.col("_mark") & covered & _is(INCLUDE), NESTED, SAME, "цепочка закрывает участок", _own("габарит, цепочка полная"))
    d = rule(d, (10, -1), F.col("_mark") & ~covered & ~_is(INCLUDE), INCLUDE, MAIN, "полный размер, цепочка не закрывает", _own("полный размер"))
    piece = F.col("_over").isNotNull() & _is(INCLUDE)
    log = F.array_append("log", F.struct(F.lit(10).alias("pass"), F.col("_over.ord").alias("at"), F.col("ord").alias("sub"), _text(F.col("cid"), " опора в ", F.col("_over.cid")).alias("text")))
    new = {"decision": F.lit(NESTED), "role": F.lit(PART), "reason": _text("опора, ", F.col("_over.cid"), " не закрыт"), "log": log}
    return d.withColumns({k: F.when(piece, v).otherwise(F.col(k)) for k, v in new.items()}).drop("parts", "covers", "_mark", "_over")


def cover_overalls(d: DataFrame, parts: DataFrame, cover: DataFrame) -> DataFrame:
    """The same for pieces and covers from tables, as lines.chain_parts and lines.chain_cover give them."""
    on = ["sheet_no", "ord"]
    p = parts.groupBy(*on).agg(F.collect_list(F.struct("part_ord", "part_mm")).alias("parts"))
    return cover_marks(d.join(p, on, "left").join(cover.select(*on, "covers"), on, "left"))


def take_ambiguous(d: DataFrame) -> DataFrame:
    """What is still open counts, unless it is known to be no length."""
    held = _no_length() | F.col("wheel") | (F.col("value_mm") <= 16)
    return rule(d, (11, 0), _is(OPEN) & ~held, INCLUDE, MAIN, "принят как длина", _own("из сомнения в сумму"))


def chain(d: DataFrame) -> DataFrame:
    """All passes on rows with facts, parts and covers."""
    d = take_openings(restore_lengths(restore_nested(nest_offsets(row_rules(d)))))
    return take_ambiguous(cover_marks(restore_orphans(restore_twins(restore_coordinates(resolve_shells(d))))))


def correct(c: DataFrame, write=lambda d: d) -> DataFrame:
    """Candidates of whole sheets after the chain; ``write`` may make a table of them.

    Rows are shuffled by sheet once: relations, facts and chains of pieces are columns that each row reads off its sheet.
    """
    d = L.with_relation(L.judged(R.facts(c)))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["part_mm"])
    d = d.withColumns({"edge": F.when(F.col("relation.score") >= L.SURE, F.col("relation.parent_ord")), "covers": F.when(F.size("parts") > 0, L.covers(total, F.col("value_mm")))}).drop("relation")
    return write(chain(known(d)))


def notes(d: DataFrame) -> DataFrame:
    """sheet_no, note: what the chain did to a sheet, in order; sheets that it left alone have no row."""
    g = d.groupBy("sheet_no").agg(F.sort_array(F.flatten(F.collect_list("log"))).alias("log")).filter(F.size("log") > 0)
    return g.select("sheet_no", F.concat(F.lit("авто: "), F.array_join("log.text", ", ")).alias("note"))
