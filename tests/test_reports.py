"""What is told about jobs, on small rows with written-out results."""

import glob

import pytest
from pyspark.sql import functions as F

from lengthloom.operators import evaluation as E
from lengthloom.operators import reports as T


def test_names_stamps_flags(spark):
    names = {"a/b/plan.v2.pdf": "plan.v2", " x .pdf": "x", ".pdf": "pdf", "": "pdf", None: "pdf", 'q<1>:"|?*\\.pdf': "q_1_", "..": "pdf", "ж" * 90 + ".pdf": "ж" * 80, "plain": "plain"}
    d = spark.createDataFrame([(k, v) for k, v in names.items()], "f string, want string")
    assert [(r.f, r.got) for r in d.select("f", T.slug(F.col("f")).alias("got")).collect()] == list(names.items())
    kept = {"job 1": True, "": False, None: False, "a..b": False, "a/b": False, "a\\b": False}
    d = spark.createDataFrame([(k,) for k in kept], "f string")
    assert [r[0] for r in d.select(T.safe(F.col("f"))).collect()] == list(kept.values())
    d = spark.createDataFrame([("b,a|b,,",), ("",), (None,), ("|x",)], "t string")
    assert [r[0] for r in d.select(T.flags(F.col("t"))).collect()] == [["a", "b"], [], [], ["x"]]
    assert spark.sql("select timestamp'2026-01-02 03:04:05' as t").select(T.stamp(F.col("t"))).first()[0] == "2026-01-02 03:04"


def test_costs(spark):
    rows = [("a", "GPT-4o-mini", "api", 3, 1_000_000, 1_000_000, 2), ("b", "gpt-4o:free", "api", 1, 10, 10, 1), ("c", None, None, 2, 1_000_000, 0, 0), ("d", "gemini-2.5-pro", "replay", 9, 0, 0, 4), ("e", "gpt-4o", "groq", 1, 10, 10, 1)]
    d = spark.createDataFrame(rows, "job string, model string, provider string, calls long, sent long, got long, pages long")
    got = {r.job: (r.calls, r.usd, r.calls_per_page, r.usd_per_page) for r in T.job_costs(d).collect()}
    assert got == {"a": (3, 12.5, 1.5, 6.25), "b": (1, 0.0, 1.0, 0.0), "c": (2, 0.3, 2.0, 0.3), "d": (0, 0.0, 0.0, 0.0), "e": (1, 0.0, 1.0, 0.0)}
    assert T.job_costs(d.limit(0)).count() == 0


SHEETS = "job string, sheet_no long, line_id string, length_mm long, status string, formula string"


def test_summary_and_page_of_a_job(spark, tmp_path):
    d = spark.createDataFrame([("j", 2, "<A&B>", 1500, "ok", "1000 + 500 = 1500 мм"), ("j", 1, None, 300, "review", None), ("k", 5, "x", None, None, "")], SHEETS)
    heads = spark.createDataFrame([("j", "q'.pdf", "2026-01-02 03:04")], "job string, pdf string, updated string")
    told = {r.job: r.text for r in T.summaries(d, heads).collect()}
    assert told == {
        "j": "PDF: q'.pdf\nПосчитано: 2026-01-02 03:04\nЛистов: 2\nСумма: 1800 мм = 1.800 м\nok: 1, review: 1",
        "k": "PDF: \nПосчитано: \nЛистов: 1\nСумма: 0 мм = 0.000 м\nok: 0, review: 0",
    }
    page = {r.job: r.html for r in T.pages(d, heads).collect()}
    first, second = page["j"].index("<td>1</td>"), page["j"].index("<td>2</td>")
    assert first < second and "&lt;A&amp;B&gt;" in page["j"] and "q&#x27;.pdf" in page["j"] and "<A&B>" not in page["j"]
    assert "<td>итого</td><td>1800</td><td>1.800</td>" in page["j"] and "<title>длины</title>" in page["k"]
    T.write_pages(T.pages(d, heads), f"{tmp_path}/pages")
    (file,) = glob.glob(f"{tmp_path}/pages/job=j/part-*")
    assert open(file, encoding="utf-8").read() == page["j"] + "\n"
    assert T.pages(d.limit(0), heads).count() == T.summaries(d.limit(0), heads).count() == 0


def test_lists_labels_and_captions(spark):
    c = spark.createDataFrame([(1, 2, "D2", 50, None, None, "include"), (1, 1, "D1", 840, "main", "r", "include"), (1, 3, "D3", 7, None, None, None), (1, 4, "D4", 9, None, None, "odd"), (1, 5, "D5", 6, None, None, "not_length")], "sheet_no long, ord int, cid string, value_mm int, role string, reason string, decision string")
    r = T.status_lists(c).first()
    assert [[x.cid for x in r[k]] for k in ("included", "ambiguous", "excluded")] == [["D1", "D2"], ["D3", "D4"], ["D5"]] and r.included[0].role == "main"
    assert [x[0] for x in c.select(T.label(F.col("decision"))).collect()] == ["в сумму", "в сумму", None, "odd", "не длина"]
    s = spark.createDataFrame([(1, 840, "ok", "9" * 200)], "sheet_no long, length_mm long, status string, formula string")
    assert tuple(T.captions(s).first()) == (1, "840 мм = 0.840 м  [ok]", "9" * 180)


def test_prompts_quote_neighbours_in_part(spark):
    c = spark.createDataFrame([(1, 2, 50, "h", "n" * 300), (1, 1, 840, None, None)], "sheet_no long, ord int, value_mm int, hint string, nearby string")
    meta = spark.createDataFrame([(1, "LC")], "sheet_no long, line_id string")
    assert T.prompts(c, meta).first().text == "Лист 1, линия LC\n- D1: 840 мм; ; рядом: \n- D2: 50 мм; h; рядом: " + "n" * 160
    draft = spark.createDataFrame([(1, 1, "include", None), (1, 2, "ambiguous", "why")], "sheet_no long, ord int, decision string, reason string")
    assert T.prompts(c, meta, draft).first().text == "Лист 1, линия LC\n- D1: include / \n- D2: ambiguous / why\n- D1: 840 мм; ; рядом: \n- D2: 50 мм; h; рядом: " + "n" * 120


def test_replay_takes_saved_sheets_and_names_a_lost_one(spark):
    saved = spark.createDataFrame([("j", 1, "a"), ("j", 2, "b"), ("k", 1, "c")], "job string, sheet_no long, doc string")
    wanted = spark.createDataFrame([("j", 1), ("k", 1), ("k", 1)], "job string, sheet_no long")
    assert sorted(r.doc for r in T.replayed(wanted, saved).collect()) == ["a", "c"]
    with pytest.raises(FileNotFoundError, match="1 sheets .* 7 of j"):
        T.replayed(wanted.union(spark.createDataFrame([("j", 7)], "job string, sheet_no long")), saved)
    files = spark.createDataFrame([("j", 1, "b.json"), ("j", 1, "a.json"), ("k", 1, "z.json")], "job string, sheet_no long, path string")
    assert sorted(map(tuple, T.first_files(files).collect())) == [("j", 1, "a.json"), ("k", 1, "z.json")]


def test_two_ways_to_choose_a_threshold(spark):
    # at 0.5 all six rows are accepted and five right; at 0.8 three, all right
    rows = [("include", "include", 0.9)] * 2 + [("not_length", "not_length", 0.85)] + [("include", "include", 0.6)] * 2 + [("exclude_nested", "include", 0.6)]
    d = spark.createDataFrame(rows, "y string, pred string, conf double")
    assert tuple(E.choose_threshold(d, (0.5, 0.8), 0.9).first())[:3] == (0.8, 0.5, 1.0)
    assert tuple(E.choose_threshold(d, (0.5, 0.8), 0.8, ("coverage", "accuracy")).first())[:3] == (0.5, 1.0, round(5 / 6, 9))
    assert E.choose_threshold(d, (0.5, 0.8), 0.99, ("coverage", "accuracy")).first()["threshold"] == 0.8
