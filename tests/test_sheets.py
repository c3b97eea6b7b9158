"""Nested text of a page, reasons, candidates and what a page says of itself, with the expected values written out."""

from lengthloom.operators import sheets as S

PAGES = "sheet_no long, width double, height double, blocks array<struct<type:int,lines:array<struct<dir:array<double>,spans:array<struct<text:string,bbox:array<double>,size:double>>>>>>"


def page(spark, *runs, sheet=1, width=1000.0, height=1000.0):
    """runs: text, x, y; a line each."""
    lines = [(None, [(t, [x - 5.0, y - 2.0, x + 5.0, y + 2.0], 9.0)]) for t, x, y in runs]
    return S.spans(spark.createDataFrame([(sheet, width, height, [(0, lines)])], PAGES))


def said(spark, *runs):
    return [r["reason"] for r in S.reasons(S.with_nearby(page(spark, *runs))).orderBy("span").collect()]


def test_nested_text_becomes_runs(spark):
    d = spark.createDataFrame([(1, 100.0, 100.0, [(1, [([1.0, 0.0], [("image", [0.0] * 4, 1.0)])]), (0, [([0.0, 1.0], [(" 300 ", [0.0, 0.0, 10.0, 4.0], None), (" ", [0.0] * 4, 1.0), (None, None, None)]), (None, [("b", [2.0, 2.0, 4.0, 8.0], 7.0)]), (None, None)])]), (2, 1.0, 1.0, None)], PAGES)
    got = [tuple(r)[3:] for r in S.spans(d).orderBy("span").collect()]
    assert got == [((1, 0, 0), "300", 5.0, 2.0, [0.0, 0.0, 10.0, 4.0], 0.0, [0.0, 1.0]), ((1, 1, 0), "b", 3.0, 5.0, [2.0, 2.0, 4.0, 8.0], 7.0, [1.0, 0.0])]


def test_reasons_by_text(spark):
    runs = ["X 120", "z+4500", "Z+ 4500", "DN 50", "О12а", "F7B", "<12>", "текст", "16", "17", "y12b"]
    assert said(spark, *((t, 100.0, 10.0 + 70 * i) for i, t in enumerate(runs))) == ["coordinate_xyz"] * 3 + ["nominal_diameter", "support_tag", "support_tag", "item_balloon", None, "bom_or_weld_index", "candidate", None]


def test_reasons_by_place(spark):
    assert said(spark, ("300", 680, 500), ("300", 679, 500), ("300", 100, 860), ("300", 100, 859), ("300", 1001, 500)) == ["materials_spec", "candidate", "title_block", "candidate", "candidate"]


def test_the_table_of_cut_lengths(spark):
    """It begins at its header's left edge, a fiftieth of the page further left, and ends above the stamp; its header has other spaces."""
    assert said(spark, ("300", 474, 500), ("300", 476, 500), ("300", 560, 387), ("300", 560, 389), ("ДЛИНЫ ОТРЕЗКОВ", 500, 400), ("300", 600, 919), ("300", 600, 921), ("длины отрезков", 10, 10)) == ["candidate", "cut_lengths_table", "candidate", "cut_lengths_table", None, "cut_lengths_table", "title_block", None]
    assert said(spark, ("ДЛИНЫ ОТРЕЗКОВ", 900, 400), ("300", 619, 500), ("300", 621, 500)) == [None, "candidate", "cut_lengths_table"]


def test_reasons_by_words_beside(spark):
    got = said(spark, ("300", 100, 100), ("ItemCode", 154, 100), ("300", 100, 300), ("Гидр.", 100, 354), ("300", 300, 100), ("ItemCode", 356, 100), ("12", 100, 500), ("ItemCode", 100, 510), ("°C", 100, 505))
    assert got == ["cut_lengths_table", None, "title_block", None, "candidate", None, "cut_lengths_table", None, None]


def test_candidates_are_numbered_and_hinted(spark):
    d = S.candidates(S.reasons(S.with_nearby(page(spark, ("12", 10, 10), ("300", 100, 100), ("Штурвал", 110, 100), ("300", 120, 100), ("400", 300, 300), ("врезка DN", 310, 300), ("СМ. узел", 320, 300), ("500", 100, 600), ("ЗАГЛУШКА, ВРЕЗКА", 100, 610)))))
    got = [(r["ord"], r["value_mm"], r["nearby"], r["hint"]) for r in d.orderBy("ord").collect()]
    assert got == [(1, 300, "Штурвал | 300", "near_valve_handwheel"), (2, 300, "300 | Штурвал", "near_valve_handwheel"), (3, 400, "врезка DN | СМ. узел", "dimension_candidate|near_endpoint|pipe_opening"), (4, 500, "ЗАГЛУШКА, ВРЕЗКА", "dimension_candidate")]


def test_meta(spark):
    d = page(spark, ("ab1_0345", 1, 1), ("Лист 1 из 2", 1, 2), ("Q_12", 1, 3), ("A B2_ 777", 1, 4), ("лист 3 из 12", 1, 5), ("Страница 4", 1, 6), ("5 исходного", 1, 7)).unionByName(page(spark, ("текст", 1, 1), sheet=2))
    assert sorted(map(tuple, S.meta(d).collect())) == [(1, "AB2_777", 3, 12, "5 исходного"), (2, "UNKNOWN_2", None, None, "")]
