"""Rules and figures on small sheets, with the expected values written out."""

from pyspark.sql import functions as F

from lengthloom.operators import audit
from lengthloom.operators import guards as Q
from lengthloom.operators import features as X
from lengthloom.operators import lines as L
from lengthloom.operators import pairs as P

FLAGS = ("f_overall_mark", "f_handwheel", "f_insulation_thickness", "f_near_plant_coord", "f_pipe_opening", "f_nested_offset", "f_overall_pair", "f_stamp")


def sheet(spark, *rows):
    """rows: ord, value_mm, x, nearby, decision, the flags that hold, and role=... and reason=..."""
    data = []
    for o, v, x, near, d, *more in rows:
        given = dict(m.split("=", 1) for m in more if "=" in m)
        data.append((1, o, f"D{o}", v, float(x), 0.0, 1.0, 0.0, near, d, given.get("role"), given.get("reason"), *(f in more for f in FLAGS)))
    c = spark.createDataFrame(data, "sheet_no int, ord int, cid string, value_mm int, x double, y double, dir_x double, dir_y double, nearby string, decision string, role string, reason string, " + ", ".join(f"{f} boolean" for f in FLAGS))
    return c.withColumns({"nums": F.regexp_extract_all("nearby", F.lit("[0-9]+"), F.lit(0)), "lt": P.beside_lt()})


def edges(spark, *pairs):
    return spark.createDataFrame([(1, o, p, 0.9) for o, p in pairs], "sheet_no int, ord int, parent_ord int, score double")


def with_facts(spark, c, *pairs):
    return Q.facts(c, P.pair_table(c), edges(spark, *pairs))


def decided(spark, c, e):
    d = Q.facts(c, P.pair_table(c), e)
    return {r["ord"]: r["decision"] for r in Q.restore_nested(Q.nest_offsets(Q.row_rules(d))).collect()}


def after(spark, rule, c, *pairs):
    """ord -> (decision, role, reason, log texts) after one pass."""
    return {r["ord"]: (r["decision"], r["role"], r["reason"], [e["text"] for e in r["log"]]) for r in rule(with_facts(spark, c, *pairs)).collect()}


def test_overlaps(spark):
    c = sheet(spark, (1, 1000, 0, "О7 | 1400", "include"), (2, 1400, 10, "", "include"), (3, 3000, 500, "9000", "include"), (4, 9000, 510, "", "include"), (5, 500, 900, "1250 | F2b", "include"), (6, 1250, 905, "", "include"))
    assert {(r["ord"], r["flag"]) for r in P.overlap_flags(c).collect()} == {(1, "nested_offset"), (4, "overall_pair"), (5, "nested_offset")}


def test_support_marks(spark):
    texts = ["О12", "1 | о3", "f7", "П4", "xО4", "12 | Ф9"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"] for r in d.filter(F.col("t").rlike(P.SUPPORT)).collect()} == {"О12", "1 | о3", "f7", "12 | Ф9"}
    assert {r["t"] for r in d.filter(F.col("t").rlike(P.SUPPORT_TAG)).collect()} == {"О12", "1 | о3", "f7", "П4", "12 | Ф9"}


def test_larger_of_a_pair(spark):
    alone = sheet(spark, (1, 9000, 0, "", "include", "f_overall_pair"), (2, 3000, 500, "", "include"))
    assert decided(spark, alone, edges(spark)) == {1: "exclude_nested", 2: "include"}
    # with a part of its own it is a whole run: it counts, whatever it was, and a coordinate beside it changes nothing
    run = sheet(spark, (1, 9000, 0, "", "exclude_nested", "f_overall_pair", "f_near_plant_coord"), (2, 3000, 500, "", "include"))
    assert decided(spark, run, edges(spark, (2, 1))) == {1: "include", 2: "exclude_nested"}


def test_lt_makes_an_overall(spark):
    c = sheet(spark, (1, 2500, 0, "12 | lt", "include"), (2, 2499, 900, "LT", "include"), (3, 4000, 1800, "BOLT", "include"))
    assert decided(spark, c, edges(spark)) == {1: "exclude_nested", 2: "include", 3: "include"}


def test_parts_named_beside_a_run(spark):
    c = sheet(spark, (1, 4000, 0, "700", "include"), (2, 700, 500, "", "include", "f_nested_offset"), (3, 800, 900, "4000", "include"))
    assert [r["ord"] for r in P.run_parents(c, edges(spark)).collect()] == [1]
    assert P.run_parents(c, edges(spark, (1, 3))).collect()[0]["ord"] == 3
    # a sure parent makes a nested offset too: 1 is named by 3, which lies in 2
    plain = sheet(spark, (1, 4000, 0, "", "include"), (2, 900, 500, "", "include"), (3, 800, 900, "4000", "include"))
    assert sorted(r["ord"] for r in P.run_parents(plain, edges(spark, (3, 2))).collect()) == [1, 2] and P.run_parents(plain, edges(spark)).count() == 0


def test_nested_candidates_continue_nothing(spark):
    c = sheet(spark, (1, 600, 0, "", "include"), (2, 1200, 40, "", "include"), (3, 6000, 300, "", "include"))
    assert sorted(r["ord"] for r in P.sequential(c, edges(spark)).collect()) == [1, 2]
    assert [r["ord"] for r in P.sequential(c, edges(spark, (1, 3))).collect()] == [2]


def test_plant_coordinates(spark):
    rows = [("Z+ 37329", 10, True), ("z37329", 10, True), ("X 1234567", 10, False), ("Y8999", 10, False), ("Z 24100", 24100, False), ("Z 24100 | X 9000", 24100, True), ("AZ 37329", 10, False), (None, 10, False)]
    d = spark.createDataFrame(rows, "nearby string, value_mm int, want boolean")
    assert [r["got"] for r in d.select(X.near_plant_coord().alias("got")).collect()] == [w for _, _, w in rows]


def test_weights(spark):
    rows = [(100, "", [], "include", False, 1.0), (100, "400 | a250", ["nested_offset"], "exclude_nested", True, 8 * 2 * 3 * 1.2), (2000, None, ["overall_pair", "handwheel"], "not_length", False, 5 * 3.5 * 1.6 * 1.8), (25, "100", ["support_repeat"], "include", None, 2.5 * 3 * 2)]
    d = spark.createDataFrame(rows, "value_mm int, nearby string, flags array<string>, decision string, locked boolean, want double").withColumn("reviewed_by_human", F.lit(None).cast("boolean"))
    assert [round(r["w"], 9) for r in d.select(X.weight().alias("w")).collect()] == [round(r[-1], 9) for r in rows]


def test_features(spark):
    c = spark.createDataFrame([(1, 1, 300, 0.0, 0.0, "О5 | 840 | z+ DN50", ["handwheel"], 2.5, 0.5), (1, 2, 1200, 95.0, 0.0, None, None, None, None)], "sheet_no int, ord int, value_mm int, x double, y double, nearby string, flags array<string>, dist_to_line double, parallel_score double")
    a, b = sorted((r.asDict() for r in X.features(c, edges(spark, (1, 2))).collect()), key=lambda r: r["ord"])
    assert len(a) == 30
    assert (a["n_near"], a["nested_ratio"], a["support_mark"], a["has_z"], a["has_dn"], a["f_handwheel"], a["has_parent"], a["parent_ratio"], a["parent_dist_norm"], a["dist_to_line"]) == (3.0, 0.357142857, 1.0, 1.0, 1.0, 1.0, 1.0, 0.25, 0.5, 2.5)
    assert (b["value"], b["n_near"], b["has_larger_near"], b["f_handwheel"], b["has_parent"], b["parent_dist_norm"], b["parallel_score"]) == (1200.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_audit(spark):
    saved = spark.createDataFrame([(1, 1, 10, "include"), (1, 1, 10, "include"), (1, 2, 21, "maybe"), (1, 9, 5, None), (2, 1, 1, "include")], "sheet_no int, id int, value_mm int, decision string")
    hits = spark.createDataFrame([(1, 1, 10, 2, 1.5, 20), (1, 2, 20, 7, 0.5, None), (1, 3, None, 1, None, 11), (1, 3, None, 1, None, 11), (3, 1, 1, None, None, None)], "sheet_no int, id int, value_mm int, parent_id int, geometry_confidence double, parent_value_mm int")
    assert sorted((r["sheet_no"], r["id"] or 0, r["problem"]) for r in audit.problems(saved, hits).collect()) == [
        (1, 1, "confidence"), (1, 1, "duplicate_saved"), (1, 2, "class"), (1, 2, "parent"), (1, 2, "value"), (1, 3, "duplicate_hits"), (1, 3, "missing"), (1, 3, "no_value"), (1, 3, "parent_value"), (1, 9, "extra"), (2, 0, "no_hits"), (3, 0, "no_saved"),
    ]


def test_each_row_rule_says_what_it_did(spark):
    same, inc = "overall_same_run", "include"
    c = sheet(
        spark, (1, 300, 0, "", inc, "f_overall_mark"), (2, 300, 900, "", "exclude_nested", "f_overall_mark"), (3, 2600, 1800, "LT", inc), (4, 310, 2700, "", "ambiguous", "f_handwheel"), (5, 310, 3600, "", inc),
        (6, 320, 4500, "", inc, "f_insulation_thickness"), (7, 330, 5400, "1 МПа", inc), (8, 340, 6300, "", "ambiguous", "f_stamp"), (9, 9500, 7200, "", inc, "f_near_plant_coord"), (10, 16, 8100, "", inc), (11, 350, 9000, "ItemCode", "exclude_nested"),
        (12, 310, 9900, "врезка", inc), (13, 20, 10800, "", inc), (14, 20, 11700, "", inc), (15, 20, 12600, "", "ambiguous"), (16, 100, 13500, "", inc), (17, 100, 14400, "", inc), (18, 100, 15300, "", "ambiguous"),
    )
    got = after(spark, Q.row_rules, c)
    assert got[1] == ("exclude_nested", same, "метка Н.О.", ["D1 габарит Н.О."]) and got[2] == ("exclude_nested", same, "метка Н.О.", [])
    assert got[3] == ("exclude_nested", same, "габарит LT", ["D3 габарит LT"])
    assert got[4] == ("not_length", "valve", "штурвал", ["D4 штурвал"]) and got[5] == ("not_length", "valve", "штурвал", ["D5 штурвал"])
    assert got[6][:3] == ("not_length", "other", "толщина изоляции") and got[7] == ("not_length", "bom", "штамп/спецификация", ["D7 штамп"]) and got[8][1] == "bom"
    assert got[9] == ("not_length", "other", "координата узла", ["D9 координата"]) and got[10] == ("not_length", "other", "номер позиции", ["D10 не длина"])
    assert got[11] == ("exclude_nested", None, None, []) and got[12] == (inc, None, None, [])
    assert [got[i][2] for i in (13, 14, 15)] == ["повтор мелкого"] * 3 and got[16] == ("not_length", "support_offset", "повтор опоры", ["D16 опора"]) and got[18][0] == "ambiguous"


def test_nested_offsets_name_their_parent(spark):
    c = sheet(spark, (1, 300, 0, "", "include"), (2, 900, 500, "", "include"), (3, 200, 900, "", "exclude_nested", "f_nested_offset"), (4, 250, 1500, "", "ambiguous", "f_nested_offset", "f_overall_mark"), (5, 270, 2000, "", "not_length", "f_nested_offset"))
    got = after(spark, Q.nest_offsets, c, (1, 2))
    assert got[1] == ("exclude_nested", "support_offset", "внутри D2=900", ["D1 внутри D2"]) and got[3] == ("exclude_nested", "support_offset", "размер до опоры", [])
    assert got[4][0] == "ambiguous" and got[5][0] == "not_length" and got[2] == ("include", None, None, [])


def test_what_brings_a_nested_row_back(spark):
    nes = "exclude_nested"
    c = sheet(
        spark, (1, 900, 0, "", nes), (2, 300, 300, "", nes), (3, 700, 900, "", nes, "reason=Полный размер"), (4, 700, 1800, "", nes, "f_overall_mark"), (5, 2600, 2700, "LT", nes), (6, 710, 3600, "°C", nes),
        (7, 9000, 4500, "", nes), (8, 900, 4510, "", "include"), (9, 720, 6000, "", nes), (10, 9000, 7000, "", nes), (11, 4000, 7010, "", "include"),
    )
    got = after(spark, Q.restore_nested, c, (2, 1))
    assert got[1] == ("include", "main", "полный участок над размером до опоры", ["D1 вернул полный участок"]) and got[2][0] == nes
    assert [got[i] for i in (3, 4, 5, 6)] == [(nes, None, r, []) for r in ("Полный размер", None, None, None)]
    assert got[7] == (nes, "overall_same_run", "габарит рядом", []) and got[9] == ("include", "main", "участок, не вложенный", ["D9 вернул участок"])
    assert got[10][0] == "include"  # it surrounds a neighbour that continues it


def test_openings(spark):
    """Each condition alone holds an opening back."""
    o = "f_pipe_opening"
    held = [("f_handwheel",), ("f_insulation_thickness",), ("f_overall_mark",), ("f_overall_pair",), ("f_stamp",)]
    rows = [(i, 400 + i, i * 900, "", "not_length", o, *h) for i, h in enumerate(held, 1)]
    rows += [(6, 2600, 9000, "LT", "not_length", o), (7, 406, 9900, "", "exclude_nested", o, "f_nested_offset"), (8, 407, 10800, "", "exclude_nested", o), (9, 16, 11700, "", "not_length", o), (10, 990, 12600, "", "include")]
    rows += [(11, 420, 13500, "", "not_length", o, "role=other"), (12, 421, 14400, "1 | Врезка", "ambiguous"), (13, 422, 15300, "", "not_length", o, "f_nested_offset", "role=valve"), (14, 423, 16200, "", "not_length")]
    got = after(spark, Q.take_openings, sheet(spark, *rows), (8, 10))
    assert all(got[i][0] != "include" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 14))
    assert got[11] == ("include", "branch", "отверстие/врезка/съёмный", ["D11 отверстие в сумму"]) and got[12][1] == "main" and got[13][1] == "valve"


def test_shells(spark):
    c = sheet(spark, (1, 9000, 0, "900", "include"), (2, 900, 10, "", "include"), (3, 1000, 20, "", "include"), (4, 9000, 5000, "900", "include"), (5, 900, 5010, "", "include"), (6, 9000, 9000, "900", "include"), (7, 900, 9010, "", "include", "f_overall_mark"))
    got = after(spark, Q.resolve_shells, c, (3, 4), (8, 6))
    assert got[1] == ("exclude_nested", "overall_same_run", "габарит рядом с D2", ["D1 габарит рядом с D2"]) and got[4][0] == "include"
    assert got[5] == ("exclude_nested", "support_offset", "внутри D4=9000", ["D5 внутри D4"]) and got[7][0] == "include" and got[6][0] == "include"


def test_reasons_that_rules_read(spark):
    nes = "exclude_nested"
    c = sheet(spark, (1, 500, 0, "", nes, "f_near_plant_coord", "reason=Z+ рядом", "role=other"), (2, 500, 900, "", "not_length", "f_near_plant_coord", "reason=рядом Координата Z"), (3, 500, 1800, "", nes, "f_near_plant_coord", "reason=z"), (4, 8000, 2700, "", nes, "f_near_plant_coord", "reason=z+"))
    got = after(spark, Q.restore_coordinates, c)
    assert got[1] == ("include", "main", "длина, рядом координата", ["D1 не координата"]) and got[2][:2] == ("include", None) and got[3][0] == got[4][0] == nes
    c = sheet(spark, (1, 500, 0, "", nes, "reason=Внутри 300 и 20"), (2, 500, 900, "", nes, "reason=внутри D3=840"), (3, 500, 1800, "840", nes), (4, 840, 2700, "", "not_length"), (5, 600, 3600, "840", nes, "role=support_offset"), (6, 500, 4500, "", nes, "reason=рядом 300"), (7, 500, 5400, "600", nes, "role=bom"))
    got = after(spark, Q.restore_orphans, c)
    assert got[1] == ("include", "main", "не вложен в меньшее", ["D1 вернул в сумму"]) and got[2][0] == nes and got[6][0] == nes and got[5][0] == nes
    assert got[3] == ("include", "main", "родитель не в сумме", ["D3 вернул в сумму"]) and got[7][:2] == ("include", "bom")


def test_twins_come_back(spark):
    c = sheet(spark, (1, 2000, 0, "2400", "exclude_nested", "role=overall_same_run"), (2, 2400, 100, "", "include"), (3, 2000, 900, "2400", "exclude_nested", "f_nested_offset"))
    got = after(spark, Q.restore_twins, c)
    assert got[1] == ("include", "main", "два прогона с D2", ["D1 два прогона с D2"]) and got[3][0] == "exclude_nested"


def test_overalls_and_their_pieces(spark):
    c = sheet(spark, (1, 2000, 0, "", "exclude_nested", "f_overall_mark"), (2, 500, 50, "2000", "include"), (3, 400, 100, "2000", "include"))
    c = c.withColumns({"line": F.lit(None).cast("int"), **{k: F.lit(0.0) for k in ("x1", "y1", "x2", "y2", "offset")}})
    d, parts = with_facts(spark, c), L.chain_parts(P.pair_table(c))
    got = {r["ord"]: (r["decision"], r["reason"], [e["text"] for e in r["log"]]) for r in Q.cover_overalls(d, parts, L.chain_cover(parts)).collect()}
    assert got == {1: ("include", "полный размер, цепочка не закрывает", ["D1 полный размер"]), 2: ("exclude_nested", "опора, D1 не закрыт", ["D2 опора в D1"]), 3: ("exclude_nested", "опора, D1 не закрыт", ["D3 опора в D1"])}
    note = Q.notes(Q.cover_overalls(d, parts, L.chain_cover(parts))).first()
    assert note["note"] == "авто: D1 полный размер, D2 опора в D1, D3 опора в D1"
    full = sheet(spark, (1, 900, 0, "", "include", "f_overall_mark"), (2, 500, 50, "900", "include"), (3, 400, 100, "900", "include")).withColumns({"line": F.lit(None).cast("int"), **{k: F.lit(0.0) for k in ("x1", "y1", "x2", "y2", "offset")}})
    parts = L.chain_parts(full)
    got = {r["ord"]: r["decision"] for r in Q.cover_overalls(with_facts(spark, full), parts, L.chain_cover(parts)).collect()}
    assert got == {1: "exclude_nested", 2: "include", 3: "include"}


def test_pieces_lie_on_the_overalls_line(spark):
    """A piece in the band that lies far beside the overall's own line doesn't count; the larger of a pair may be a seed, but no piece."""
    c = sheet(spark, (1, 2000, 0, "", "include", "f_overall_mark"), (2, 500, 50, "2000", "include"), (3, 400, 100, "2000", "include", "f_overall_pair"), (4, 300, 900, "", "include"))
    c = c.withColumns({"line": F.when(F.col("ord") == 1, 1), "x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + 120, "y2": F.col("y"), "offset": F.lit(0.0)})
    assert [r["part_ord"] for r in L.chain_parts(c).collect()] == [2]
    free = c.withColumn("line", F.lit(None).cast("int"))
    assert sorted(r["part_ord"] for r in L.chain_parts(free).collect()) == [2, 4]


def test_overalls_have_no_parts(spark):
    """Each of overall pair, LT and opening alone bars a parent; an overall pair bars a child by neighbours."""
    def scores(child=(), parent=(), near=""):
        c = sheet(spark, (1, 2000, 0, "2600 | О5", "include", *child), (2, 2600, 60, f"2000{near}", "include", *parent))
        c = c.withColumns({"line": F.col("ord"), "x1": F.col("x"), "y1": F.lit(0.0), "x2": F.col("x1") + 100, "y2": F.lit(0.0), "offset": F.col("ord") * 10.0})
        r = L.pairs(c).first()
        return r["geo"] > 0, r["text"] > 0

    assert scores() == (True, True)
    assert scores(parent=("f_overall_pair",)) == scores(parent=("f_overall_mark",)) == scores(parent=("f_pipe_opening",)) == scores(near=" | LT") == (False, False)
    assert scores(child=("f_overall_pair",)) == (True, False)
