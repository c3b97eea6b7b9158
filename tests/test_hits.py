"""Documents of sheets: written, read, corrected, confirmed; what doesn't change keeps its file."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from lengthloom.operators import lines as L
from lengthloom.session import kept
from lengthloom.sources import hits as H


def files(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/job=*/sheet_no=*/*.json")}


def hit(i, value, x, y=0.0, **more):
    return {"id": f"D{i}", "value_mm": value, "x": float(x), "y": float(y), **more}


def docs(spark, *rows):
    """rows: job, sheet_no, hits."""
    return spark.createDataFrame([{"job": j, "sheet_no": n, "line_id": f"S{n}", "width": 1191.0, "height": 842.0, "relations_version": 1, "candidates": h} for j, n, h in rows], H.HITS)


def decided(spark, *rows):
    return spark.createDataFrame([{"job": j, "sheet_no": n, "line_id": f"S{n}", "items": [dict(zip(("id", "decision", "role", "reason", "value_mm"), i)) for i in items], "notes": notes, "locked": locked, "reviewed_by_human": None} for j, n, items, notes, locked in rows], H.DECISIONS)


def test_defaults_and_scaling(spark):
    d = docs(spark, ("a", 1, [hit(1, 300, 100, 80), {"id": None}, hit(3, 16, 820, 10), hit(4, 40, 10, 730), hit(5, 50, 860, 200, nearby="1 МПа"), hit(6, 60, 10, 10, nearby="12 | lt", flags=["stamp_or_bom", "handwheel"])])).withColumns({"width": F.lit(2382.0), "height": F.lit(0.0)})
    got = {r["ord"]: r for r in H.candidates(d).collect()}
    assert (got[1]["x"], round(got[1]["y"], 6), got[1]["sheet_no"]) == (50.0, round(80 / (1521 / 842), 6), "a/1")
    assert (got[2]["cid"], got[2]["value_mm"], got[2]["x"], got[2]["nearby"], got[2]["flags"], got[2]["direction"], got[2]["axis"], got[2]["bbox"], got[2]["ends"], got[2]["line"]) == ("", 0, 0.0, "", [], [1.0, 0.0], [1.0, 0.0], [-5.0, -5.0, 5.0, 5.0], [0.0] * 4, None)
    assert [got[i]["f_stamp"] for i in range(1, 7)] == [False, False, False, False, True, True] and got[6]["f_handwheel"] and not got[6]["lt"]
    wide = docs(spark, ("a", 1, [hit(1, 300, 811, 500), hit(2, 300, 10, 725), hit(3, 300, 858, 269), hit(4, 300, 809, 724)]))
    assert [r["f_stamp"] for r in H.candidates(wide).orderBy("ord").collect()] == [True, True, True, False]


def test_round_trip(spark, tmp_path):
    h = hit(1, 300, 10.04, 20.06, nearby="x", local_hint="h", flags=["b", "a"], bbox=[1.239, 2.0, 3.0, 4.0], direction=[0.12345678, 1.0], dim_line_id="L1", dist_to_line=1.23456, parallel_score=0.98765, dim_endpoints=[[1.119, 2.0], [3.0, 4.0]], dim_axis=[0.0, 1.0], dim_offset=7.65432, parent_id="D2", relation_kind="n", geometry_confidence=0.87654, parent_value_mm=900, parent_dist=5.678)
    d = docs(spark, ("a", 1, [h, hit(2, 900, 5)]), ("a", 2, []))
    once = H.documents(H.candidates(d), d)
    H.save(once, f"{tmp_path}/hits")
    back = H.read(spark, f"{tmp_path}/hits", H.HITS)
    got = {r["sheet_no"]: r.asDict(True) for r in back.collect()}
    assert got[2]["candidates"] == []
    r = got[1]["candidates"][0]
    assert (r["x"], r["y"], r["flags"], r["bbox"][0], r["direction"][0], r["dist_to_line"], r["parallel_score"], r["dim_endpoints"], r["dim_offset"], r["geometry_confidence"], r["parent_dist"]) == (10.0, 20.1, ["a", "b"], 1.24, 0.123457, 1.235, 0.9877, [[1.12, 2.0], [3.0, 4.0]], 7.654, 0.877, 5.68)
    again = H.documents(H.candidates(back), back)
    assert sorted(map(str, again.collect())) == sorted(map(str, back.select(again.columns).collect()))


def test_missing_boxes_are_those_of_the_nearest_number(spark):
    d = docs(spark, ("a", 1, [hit(1, 300, 100, 100), hit(2, 300, 200, 100, bbox=[0.0] * 4), hit(3, 41, 100, 100)]))
    spans = spark.createDataFrame([("a/1", " 300 ", 103.0, 100.0, [1.0] * 4, [0.0, 1.0]), ("a/1", "300", 90.0, 100.0, [2.0] * 4, [1.0, 0.0]), ("a/1", "3000", 100.0, 100.0, [3.0] * 4, [1.0, 0.0]), ("b/1", "300", 100.0, 100.0, [4.0] * 4, [1.0, 0.0])], "sheet_no string, text string, x double, y double, bbox array<double>, direction array<double>")
    got = [(r["bbox"], r["direction"]) for r in H.candidates(d, spans).orderBy("ord").collect()]
    assert got == [([1.0] * 4, [0.0, 1.0]), ([0.0] * 4, [0.0, 1.0]), ([95.0, 95.0, 105.0, 105.0], [1.0, 0.0])]


def test_only_changed_sheets_are_written(spark, tmp_path):
    found = docs(
        spark, ("a", 1, [hit(1, 300, 100), hit(2, 900, 300)]), ("a", 2, [hit(1, 300, 100, flags=["handwheel"]), hit(2, 500, 400)]), ("b", 1, [hit(1, 12, 100)]), ("b", 2, [hit(1, 12, 100)]), ("b", 3, [hit(1, 700, 100)]),
    )
    items = decided(
        spark, ("a", 1, [("D1", "include", "main", "ok", 300), ("D2", "include", None, None, 900)], None, None), ("a", 2, [("D2", "ambiguous", "main", "?", 500), ("D1", "include", None, None, 300), ("D9", "include", None, "gone", 1)], ["first"], False),
        ("b", 1, [("D1", "include", None, None, 12)], None, True), ("b", 2, [("D1", "include", None, None, 12)], None, None), ("b", 4, [("D1", "ambiguous", None, None, 7)], None, None),
    )
    path = f"{tmp_path}/decisions"
    H.save(items, path)
    before = files(path)
    assert len(before) == 5
    new = kept(H.relabel(H.read(spark, path, H.DECISIONS), found, kept))
    assert sorted((r["job"], r["sheet_no"]) for r in new.collect()) == [("a", 2), ("b", 2)]
    H.save(new, path)
    after = files(path)
    same = {p for p in before if before[p] == after.get(p)}
    assert {tuple(p.split("/")[-3:-1]) for p in same} == {("job=a", "sheet_no=1"), ("job=b", "sheet_no=1"), ("job=b", "sheet_no=4")} and len(after) == 5
    got = {(r["job"], r["sheet_no"]): r for r in H.read(spark, path, H.DECISIONS).collect()}
    assert [tuple(i)[:4] for i in got["a", 2]["items"]] == [("D2", "include", "main", "принят как длина"), ("D1", "not_length", "valve", "штурвал"), ("D9", "include", None, "gone")]
    assert got["a", 2]["notes"] == ["first", "авто: D1 штурвал, D2 из сомнения в сумму"] and got["a", 2]["line_id"] == "S2"
    assert got["b", 2]["items"][0]["reason"] == "номер позиции" and got["b", 1]["items"][0]["decision"] == "include" and got["b", 1]["locked"]
    # a second run finds nothing to do, but for the locked sheet, if it is asked to
    again = H.read(spark, path, H.DECISIONS)
    assert H.relabel(again, found, kept).count() == 0
    forced = H.relabel(again, found, kept, ignore_locked=True).collect()
    assert [(r["job"], r["sheet_no"], r["locked"], r["items"][0]["decision"]) for r in forced] == [("b", 1, True, "not_length")]


def test_confirm(spark, tmp_path):
    path = f"{tmp_path}/decisions"
    H.save(decided(spark, ("a", 1, [("D1", "include", None, None, 12)], None, None), ("a", 2, [("D1", "include", None, None, 12)], None, None)), path)
    before = files(path)
    H.save(kept(H.confirm(H.read(spark, path, H.DECISIONS), "a", 2)), path)
    got = {r["sheet_no"]: (r["locked"], r["reviewed_by_human"], r["items"][0]["id"]) for r in H.read(spark, path, H.DECISIONS).collect()}
    assert got == {1: (None, None, "D1"), 2: (True, True, "D1")} and sum(before[p] == files(path).get(p) for p in before) == 1
    H.save(kept(H.confirm(H.read(spark, path, H.DECISIONS), "a", 2, False)), path)
    assert {r["locked"] for r in H.read(spark, path, H.DECISIONS).collect()} == {None}
    with pytest.raises(ValueError):
        H.confirm(H.read(spark, path, H.DECISIONS), "a", 3)


def test_lines_of_hits_give_relations(spark):
    """Decoded hits have all that the relations by lines read."""
    ends = {"dim_endpoints": [[100.0, 0.0], [200.0, 0.0]], "dim_line_id": "L2", "dim_offset": 20.0}
    d = docs(spark, ("a", 1, [hit(1, 300, 110, nearby="О5", dim_line_id="L1", dim_endpoints=[[100.0, 0.0], [150.0, 0.0]], dim_offset=10.0), hit(2, 900, 160, **ends)]))
    r = L.sure_relations(H.candidates(d), kept).collect()
    assert [(x["sheet_no"], x["ord"], x["parent_ord"], x["score"]) for x in r] == [("a/1", 1, 2, 1.0)]


def test_relations_are_refreshed(spark, tmp_path):
    """Only sheets whose relations change are written; a flag is added, never taken away."""
    ends = {"dim_endpoints": [[100.0, 0.0], [200.0, 0.0]], "dim_line_id": "L2", "dim_offset": 20.0, "dim_axis": [1.0, 0.0], "direction": [1.0, 0.0]}
    child = hit(1, 300, 110, nearby="О5", local_hint="a", flags=["handwheel"], dim_line_id="L1", dim_endpoints=[[100.0, 0.0], [150.0, 0.0]], dim_offset=10.0)
    path = f"{tmp_path}/hits"
    H.save(docs(spark, ("a", 1, [child, hit(2, 900, 160, **ends)]), ("a", 2, [hit(1, 40, 5, flags=["nested_offset"])])), path)
    first = kept(H.refresh(H.read(spark, path, H.HITS), kept))
    H.save(first, path)
    got = {r["sheet_no"]: [h.asDict() for h in r["candidates"]] for r in H.read(spark, path, H.HITS).collect()}
    a, b = got[1]
    assert (a["parent_id"], a["parent_value_mm"], a["relation_kind"], a["geometry_confidence"], a["parent_dist"], a["flags"], a["local_hint"]) == ("D2", 900, "nested_in", 1.0, 50.0, ["handwheel", "nested_offset"], "a|nested_offset")
    assert (b["parent_id"], b["relation_kind"], b["geometry_confidence"], b["flags"]) == (None, "", 0.0, []) and got[2][0]["flags"] == ["nested_offset"]
    before = files(path)
    second = kept(H.refresh(H.read(spark, path, H.HITS), kept))
    assert second.count() == 0
    H.save(second, path)
    assert files(path) == before
