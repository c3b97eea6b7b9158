"""The rules of whole sheets on arrays give what they give as columns of Spark, and in blocks what they give at once."""

import random

import pytest

from lengthloom import arrays
from lengthloom.operators import marks as M
from lengthloom.operators import pairs as P
from lengthloom.plans import registry, runs, saved
from lengthloom.sources import adapters as A

NAMES = "sheet_no long, ord int, value_mm int, x double, y double, dir_x double, dir_y double, f_overall_mark boolean, f_handwheel boolean, f_insulation_thickness boolean, f_near_plant_coord boolean, f_pipe_opening boolean, f_stamp boolean, has_support boolean, note string, role string, reason string, decision string, cid string"
TEXTS = (*A.BESIDE, "²О5", "О7а", "xО5", "<7>", "1950", "300 | 650", "99999999999999999999", "lt", "", None, None, "́О5", "ЗАГЛУШКА, ВРЕЗКА", "рабочая температура 20°C")


def rows(seed: int, sheets: list[int], gaps: float):
    """Candidates of sheets of these sizes; a share of their fields is null."""
    r = random.Random(seed)
    some = lambda v: None if r.random() < gaps else v
    for s, n in enumerate(sheets):
        for o in range(1, n + 1):
            even = r.random() < 0.7
            flags = [some(r.random() < p) for p in (0.15, 0.08, 0.08, 0.15, 0.12, 0.05, 0.4)]
            place = [some(100.0 + 20 * r.randrange(7)), some(100.0 + 15 * r.randrange(5)), some(float(even)), some(float(not even))]
            told = [r.choice(TEXTS), r.choice(A.ROLES), r.choice(A.REASONS), r.choice((*A.DECISIONS, "include", "include", None))]
            yield (s, o, some(r.choice(A.VALUES)), *place, *flags, *told, f"D{o}")


def on_arrays(d, rules, schema: str) -> list[tuple]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    batches = d.orderBy("sheet_no").toArrow().to_batches(max_chunksize=37)
    return sorted((tuple(r.values()) for b in arrays.judge(iter(batches), rules, kinds) for r in b.to_pylist()), key=repr)


def flat(v):
    return tuple(flat(x) for x in (v.values() if isinstance(v, dict) else v)) if isinstance(v, dict | list | tuple) else v


SCHEMA = "sheet_no bigint, ord int, was struct<decision:string,role:string,reason:string>, decision string, role string, reason string, log array<struct<pass:int,at:int,sub:int,text:string>>"


def _logged(c):
    return runs.decided(c).select("sheet_no", "ord", "was", *runs.SAVED, "log")


def test_arrays_give_what_columns_give(spark, monkeypatch):
    given = [*rows(1, [1, 2, 3, 7, 7, 30, 5, 6, 7, 7] * 6, 0.0), *((s + 100, *r) for s, *r in rows(2, [1, 4, 7, 7, 12, 25] * 8, 0.08))]
    d = spark.createDataFrame(given, NAMES).repartition(2, "sheet_no").sortWithinPartitions("sheet_no", "ord").cache()
    want = sorted((flat(r.asDict(recursive=True)) for r in _logged(d).collect()), key=repr)
    assert len({(r[2], r[3:6]) for r in want}) > 20
    monkeypatch.setattr(arrays, "ROWS", 100)
    whole = [flat(r) for r in on_arrays(d, _logged, SCHEMA)]
    assert whole == want
    monkeypatch.setattr(arrays, "PAIRS", 16)
    assert [flat(r) for r in on_arrays(d, _logged, SCHEMA)] == want


def test_training_rows_are_those_of_columns(spark, monkeypatch):
    from pyspark.sql import functions as F

    given = [*rows(3, [1, 3, 7, 7, 20, 6] * 6, 0.0), *((s + 100, *r) for s, *r in rows(4, [2, 7, 9, 15] * 6, 0.05))]
    d = spark.createDataFrame(given, NAMES).withColumn("held_out", F.col("sheet_no") % 5 == 0).repartition(2, "sheet_no").sortWithinPartitions("sheet_no", "ord").cache()
    want = sorted((flat(r.asDict(recursive=True)) for r in saved.learned(d).collect()), key=repr)
    assert any(r[-1] is not None for r in want)
    monkeypatch.setattr(arrays, "ROWS", 100)
    assert [flat(r) for r in on_arrays(d, saved.learned, f"sheet_no bigint, ord int, held_out boolean, decision string, {saved.SHOWN}")] == want


@pytest.mark.parametrize("name", ["guard_decisions", "guard_full", "guard_notes", "relabeled_items"])
def test_larger_tables_run_on_arrays(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Exchange") == 1 and "collect_set" not in plan


@pytest.mark.parametrize("p", [P.SUPPORT, P.SUPPORT_TAG, P.BALLOON, M.PARTS_TABLE, M.TITLE, M.OPENING, r"(^|\|)\s*LT\s*($|\|)"])
def test_patterns_are_those_of_java(spark, p):
    texts = [t for t in TEXTS if t is not None] + ["О5", "а́О5", "_О5", "5О5", "⓪О5", "Ⅷо5", "ⓐО5", " фП12а ", "| О5А|", "LT ", "x | LT", "съёмных́ участок", "СЪЕМН² УЧАСТОК", "stub", "STUB²", "Поз. №", "МПА", "гидр."]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    want = {r[0]: r[1] for r in d.selectExpr("t", f"t rlike r'{p}'").collect()}
    assert {t: arrays.pattern(p)(t).search(t) is not None for t in texts} == want
