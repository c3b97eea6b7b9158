"""Files written and read again."""

import glob
import json
import os

from lengthloom.sources import files


def test_decisions_of_a_folder(spark, tmp_path):
    for job, no, items in (("j1", 3, [{"id": "D1", "decision": "include", "value_mm": 840}, {"id": "D2", "decision": "ambiguous"}]), ("j2", 11, [])):
        os.makedirs(tmp_path / job / "raw")
        (tmp_path / job / "raw" / f"sheet_{no:02d}.json").write_text(json.dumps({"line_id": "A_100", "items": items, "locked": no == 3}, indent=1))
    rows = files.read_decisions(spark, f"{tmp_path}/*/raw/sheet_*.json").orderBy("pos").collect()
    assert [(r.job, r.sheet_no, r.id, r.decision, r.value_mm, r.locked) for r in rows] == [("j1", 3, "D1", "include", 840, True), ("j1", 3, "D2", "ambiguous", None, True)]


def test_jobs_newest_first_without_broken_ones(spark, tmp_path):
    records = {"old": {"id": "old", "sheets": [{"sheet_no": 1, "length_mm": 5, "status": "ok"}, {"sheet_no": 2, "length_mm": 7, "status": "review"}]}, "new": {"total_mm": 9}}
    for i, (name, r) in enumerate(records.items()):
        os.makedirs(tmp_path / name)
        (tmp_path / name / "metrics.json").write_text(json.dumps(r))
        os.utime(tmp_path / name / "metrics.json", (1e9 + i * 100, 1e9 + i * 100))
    os.makedirs(tmp_path / "bad")
    (tmp_path / "bad" / "metrics.json").write_text("{broken")
    rows = files.read_jobs(spark, f"{tmp_path}/*/metrics.json").collect()
    assert [(r.id, r.pages, r.total_mm, r.ok, r.review) for r in rows] == [("new", 0, 9, 0, 0), ("old", 2, 12, 1, 1)]


def test_report_of_lengths(spark, tmp_path):
    d = spark.createDataFrame([(10, 300, "300 = 300 мм", "ok"), (2, 1950, "1950 = 1950 мм", "review"), (7, 0, "", "error")], "sheet_no long, length_mm long, formula string, status string")
    files.write_lengths(d, f"{tmp_path}/out")
    parts = [open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{tmp_path}/out/part-*"))]
    assert all(p.startswith("\ufeff" + ";".join(files.HEADING)) for p in parts if p)
    body = [line for p in parts for line in p.splitlines()[1:]]
    assert body == ["2;;1950;1,950;1950 = 1950 мм;review;", "7;;0;0,000;;error;", "10;;300;0,300;300 = 300 мм;ok;", ";итого;2250;2,250;;;"]


def test_examples_and_index(spark, tmp_path):
    d = spark.createDataFrame([("a", [1, 2], None)], "id string, flags array<int>, note string")
    files.write_examples(d, f"{tmp_path}/x")
    assert [tuple(r) for r in spark.read.schema(d.schema).json(f"{tmp_path}/x/jsonl").collect()] == [("a", [1, 2], None)]
    assert spark.read.csv(f"{tmp_path}/x/csv", sep=";", header=True).first().flags == "[1,2]"
    index = spark.createDataFrame([("a", 1, True), ("b", 2, False)], "id string, total long, latest boolean")
    job = spark.createDataFrame([("b", 5)], "id string, total long")
    assert sorted(map(tuple, files.upsert(index, job).collect())) == [("a", 1, False), ("b", 5, True)]


def test_json_in_an_answer(spark):
    d = spark.createDataFrame([('text ```json\n{"a": 1}\n``` end',), ('so {"a": {"b": 2}} it is',), ("none",)], "t string")
    assert [r[0] for r in d.select(files.embedded_json(d.t)).collect()] == ['{"a": 1}', '{"a": {"b": 2}}', ""]
