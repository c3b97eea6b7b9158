"""What one task holds of the candidates doesn't grow with the input."""

from lengthloom import session
from lengthloom.sources import adapters as A


def test_partitions_follow_the_files(spark, monkeypatch):
    lines = A.table(spark, "/root/testdata/sf0.01", "lineitem")
    want = A.candidates(lines).select("sheet_no", "ord", "value_mm").collect()
    monkeypatch.setattr(session, "TASK_BYTES", 1 << 16, raising=False)
    d = A.candidates(lines)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and d.rdd.getNumPartitions() > 4
    assert sorted(d.select("sheet_no", "ord", "value_mm").collect()) == sorted(want)
    assert A.candidates(lines.limit(10).cache()).count() == 10


def test_names_of_folders_may_hold_spaces(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "TASK_BYTES", 1 << 12)
    A.table(spark, "/root/testdata/sf0.001", "lineitem").write.parquet(f"{tmp_path}/a b%c/lineitem.parquet")
    lines = A.table(spark, f"{tmp_path}/a b%c", "lineitem")
    assert A.candidates(lines).count() == lines.count()


def test_partitions_follow_the_rows_of_tightly_packed_files(spark, monkeypatch, tmp_path):
    """Copies of the same lines pack into few bytes: their rows count, too."""
    monkeypatch.setattr(session, "TASK_ROWS", 1000, raising=False)
    lines = A.table(spark, "/root/testdata/sf0.01", "lineitem").limit(1).crossJoin(spark.range(20000)).drop("id")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    d = A.candidates(A.table(spark, str(tmp_path), "lineitem"))
    assert d.rdd.getNumPartitions() == 20 and d.count() == 20000
