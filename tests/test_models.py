"""Models kept and served, splits by group, manifests."""

import json

import pytest
from pyspark.sql import functions as F

from lengthloom.operators import classes, models, splits
from lengthloom.sources import files

KINDS = ("include", "exclude_nested", "not_length")


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float(i % 3 == 0), float(i % 3 == 1) if i % 5 else None, KINDS[i % 3] if i % 7 else "ambiguous", 1.0) for i in range(600)]
    return spark.createDataFrame(data, "id int, a double, b double, y string, w double").cache()


def fitted(kind, rows):
    if kind == "forests_v1":
        return models.fit_forests(rows, ["a", "b"], "y", "w", trees=4)
    if kind == "linear_v1":
        return models.fit_linear(rows, ["a", "b"], "y", "w")
    c = classes.fit_cascade(rows, ["a", "b"], "y", "w")
    return models.Cascade(c.names, c.linear, c.forest)


@pytest.mark.parametrize("kind", ["forests_v1", "linear_v1", "cascade_v2"])
def test_a_kept_model_decides_as_before(spark, rows, tmp_path, kind):
    model = fitted(kind, rows)
    models.save(model, spark, f"{tmp_path}/model")
    again = models.load(spark, f"{tmp_path}/model")
    assert type(again) is type(model) and again.names == ["a", "b"]
    d = rows.select("id", "a", "b", F.lit("old").alias("reason"))
    first, second = ({r["id"]: r.asDict() for r in models.decide(d, m).collect()} for m in (model, again))
    assert first == second and len(first) == 600
    right = [r for i, r in first.items() if i % 5 and r["decision"] == KINDS[i % 3]]
    assert len(right) == 480 and {r["role"] for r in right if r["decision"] == "include"} == {"main"} and {r["role"] for r in right if r["decision"] != "include"} == {"other"}
    assert all(r["reason"].startswith({"forests_v1": "forests×5 0.", "linear_v1": "linear ", "cascade_v2": "cascade "}[kind]) or r["reason"].startswith("forests×5 1.") for r in first.values())


def test_unsure_classes_are_ambiguous(rows):
    linear, cascade = fitted("linear_v1", rows), fitted("cascade_v2", rows)
    assert {r["pred"] for r in linear.classify(rows, 1.01).collect()} == {"ambiguous"}
    got = cascade.classify(rows, 1.01).first()
    assert got["pred"] == "ambiguous" and got["why"].startswith("cascade unsure ") and "/" in got["why"]


def test_without_a_model_every_row_counts(spark, rows, tmp_path):
    assert models.load(spark, f"{tmp_path}/none") is None
    got = models.decide(rows, None).select("decision", "role", "reason").distinct().collect()
    assert [tuple(r) for r in got] == [("include", "main", "draft without a model")]


def test_an_unknown_kind_is_an_error(spark, tmp_path):
    spark.createDataFrame([("boosted", ["a"], [])], "kind string, names array<string>, parts array<string>").write.json(f"{tmp_path}/m/head")
    with pytest.raises(ValueError):
        models.load(spark, f"{tmp_path}/m")


def test_features_must_not_show_the_label(rows):
    for fit in (models.fit_forests, models.fit_linear):
        with pytest.raises(ValueError):
            fit(rows, ["a", "decision"], "y", "w")
        with pytest.raises(ValueError):
            fit(rows.limit(50), ["a"], "y", "w")


def test_overfitting(spark):
    d = lambda pairs: spark.createDataFrame(pairs, "y string, pred string")
    right = d([(k, k) for k in KINDS])
    assert models.overfitting(right, right) == (0.0, True)
    gap, ok = models.overfitting(right, d([(k, "include") for k in KINDS]))
    assert round(gap, 6) == round(1 - 0.5 / 3, 6) and not ok


def test_folds_and_parts(spark):
    d = spark.createDataFrame([(f"g{i}" if i else None, j) for i in range(103) for j in range(1 + i % 3)], "grp string, row int")
    got = {r["grp"]: r["fold"] for r in splits.folds(d, "grp", 5).collect()}
    sizes = [sum(f == k for f in got.values()) for k in range(5)]
    assert len(got) == 103 and sizes == [21, 21, 21, 20, 20]
    assert got == {r["grp"]: r["fold"] for r in splits.folds(d.repartition(7), "grp", 5).collect()} != {r["grp"]: r["fold"] for r in splits.folds(d, "grp", 5, seed=8).collect()}
    parts = [r["part"] for r in splits.three_way(d, "grp").collect()]
    assert {p: parts.count(p) for p in set(parts)} == {"test": 16, "validation": 16, "train": 71}
    few = [r["fold"] for r in splits.folds(d.filter("grp in ('g1', 'g2')"), "grp", 5).collect()]
    assert sorted(few) == [0, 1] and splits.folds(d.filter("row > 9"), "grp", 5).count() == 0
    ranks = sorted(r["rank"] for r in splits.ranked(d, "grp", 1).collect())
    assert ranks == list(range(103))


def test_manifests(spark, tmp_path):
    for i, m in enumerate(({"job": "a", "total": 6, "holdout_test_pages": {"t1": [2, 3], "t2": [6, 9]}, "training_sheets": [1, 2]}, {"job": "b", "test_sets": {"t": [1]}}, {"job": "c", "total": 0})):
        (tmp_path / f"m{i}.json").write_text(json.dumps(m, indent=1))
    m = files.read_manifests(spark, str(tmp_path), total=3)
    assert sorted(map(tuple, files.training_pages(m).collect())) == [("a", 1), ("a", 4), ("a", 5), ("b", 2), ("b", 3)]
    used = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("b", 1), ("c", 1)], "job string, page int")
    assert sorted(map(tuple, files.holdout_leaks(used, m).collect())) == [("a", "t1", 3), ("b", "t", 1)]
