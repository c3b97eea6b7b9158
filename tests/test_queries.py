"""Every query of the engine against its SQL."""

import pytest

from lengthloom.operators import classes
from lengthloom.plans import registry, saved
from lengthloom.session import ship

from .oracle_check import both


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    ship(spark)
    got, want = both(spark, registry.queries()[name], registry.oracle_sql()[name], "/root/testdata/sf0.001")
    assert got[1] == want[1]
    assert got[0] == want[0]


def test_every_query_has_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == saved.WITHOUT_SQL
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_too_few_rows_are_refused(spark):
    rows = spark.createDataFrame([(1.0, "include", 1.0)] * 5, "x double, y string, w double")
    with pytest.raises(ValueError):
        classes.fit_cascade(rows, ["x"], "y", "w")


def test_models_learn_what_can_be_learned(spark):
    kinds = ("include", "exclude_nested", "not_length")
    rows = spark.createDataFrame([(i, float(i % 3 == 0), float(i % 3 == 1) if i % 5 else None, kinds[i % 3] if i % 7 else "ambiguous", 1.0) for i in range(600)], "id int, a double, b double, y string, w double")
    model = classes.fit_cascade(rows, ["a", "b"], "y", "w")
    got = model.classify(rows).collect()
    assert len(got) == 600 and all(r["pred"] in (kinds[r["id"] % 3], "ambiguous") for r in got if r["id"] % 5)
    assert all(r["pred"] == "include" for r in got if r["id"] % 3 == 0)
    assert all(r["pred"] == "ambiguous" for r in model.classify(rows, 1.01).collect())


def test_every_candidate_gets_a_class(spark):
    ship(spark)
    got = registry.queries()["cascade_classes"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert {r["pred"] for r in got} <= {"include", "exclude_nested", "not_length", "ambiguous"} and all(r["pred"] == r["linear"] == r["forest"] for r in got if r["pred"] != "ambiguous")
