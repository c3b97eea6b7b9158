"""Whitening against a dense computation in one piece, and its hard cases."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lengthloom.llm import queries, whitening


def dense(vectors, components=16):
    """(n, deviations, eigenvalues, V) of lattice points, by exact fractions and one dense product."""
    points = sorted(set(vectors))
    n, d = len(points), len(points[0])
    s = [sum(p[i] for p in points) for i in range(d)]
    c = np.array([[float(Fraction(n * p[i] - s[i], n)) for i in range(d)] for p in points])
    v = sum(np.outer(r, r) for r in c) / n
    return n, {p: sum((n * p[i] - s[i]) ** 2 for i in range(d)) for p in points}, np.linalg.eigvalsh(v)[::-1][:components], v, s


def check(got, vectors, components=16):
    """got: rows as dicts; vectors: id -> lattice point. Values up to the sign of each component."""
    n, deviation, e, v, s = dense(list(vectors.values()), components)
    e = e[e > e[0] * 1e-12]
    assert len(got) == len(vectors) * len(e)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert set(by) == {(i, k + 1) for i in vectors for k in range(len(e))}
    first = {p: i for i, p in vectors.items()}
    w = np.array([[by[i, k + 1]["whitened"] for k in range(len(e))] for i in first.values()])
    assert np.abs(w.T @ w / n - np.eye(len(e))).max() < 1e-8
    c = np.array([[float(Fraction(n * x - y, n)) for x, y in zip(p, s, strict=True)] for p in first])
    u, *_ = np.linalg.lstsq(c, w * np.sqrt(e), rcond=None)  # the components themselves
    if len(c) > len(c[0]):
        assert np.abs(v @ u - u * e).max() < 1e-7 * e[0]
    assert len({(r["component"], r["explained"]) for r in got}) == len(e) and len({r["identity_error"] for r in got}) == 1
    for (i, k), r in by.items():
        assert (r["n"], r["deviation"]) == (n, deviation[vectors[i]])
        assert r["explained"] == pytest.approx(e[k - 1] / np.trace(v), rel=1e-9) and r["identity_error"] < 1e-9
        assert r["whitened"] == by[first[vectors[i]], k]["whitened"]  # copies agree


def test_query_equals_dense_whitening(spark):
    got = [r.asDict() for r in queries.queries()["op13_two_pass_whitening"](spark, "/root/testdata/sf0.001").collect()]
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    check(got, {r["vec_id"]: tuple(int(np.floor(64.0 * c)) + 1_000_000 for c in r["embedding"]) for r in rows})


def test_hard_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=3)], "v") for i in range(40)]
    rows += [(100, None, "v"), (101, [1.0, None, 2.0], "v"), (102, [float("nan"), 0.0, 1.0], "v"), (103, [0.0, float("inf"), 1.0], "v"), (104, [], "v")]
    rows += [(i, rows[0][1], "v") for i in range(200, 260)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").repartition(5)
    got = [r.asDict() for r in whitening.whiten(d, "vec_id", whitening.lattice(F.col("embedding")), 2).collect()]
    good = {i: tuple(int(np.floor(64 * c)) + 1_000_000 for c in v) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()}
    check(got, good, 2)


def test_repeated_rows_null_ids_and_other_lengths(spark):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [5.0, -2.0]), (4, [0.5, 0.25]), (5, [1.0]), (6, [2.0]), (7, [9.0, 9.0, 9.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, v array<float>"), "vec_id", whitening.lattice(F.col("v"))).collect()
    two, one = [r for r in got if r["vec_id"] in (None, 3, 4)], [r for r in got if r["vec_id"] in (5, 6)]
    assert len(two) == 8 and {r["n"] for r in two} == {3} and sum(r["vec_id"] is None for r in two) == 4
    assert sorted(abs(r["whitened"]) for r in one) == pytest.approx([1, 1]) and {r["n"] for r in one} == {2}
    assert len(got) == 10  # a length with one vector has no variance


def test_sums_are_exact_beyond_64_bits(spark):
    rows = [(1, [2.0**60, 0.0]), (2, [-(2.0**60), 1.0]), (3, [1e300, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", whitening.lattice(F.col("v"))).collect()
    assert {r["deviation"] for r in got} == {None} and {r["n"] for r in got} == {3} and all(np.isfinite(r["whitened"]) for r in got)
    x = np.array([[2**61 + 10**6, 5], [7, 2**40]], np.int64)
    assert whitening.differences(x, 10, [3, 4]).tolist() == [[10 * int(a) - 3, 10 * int(b) - 4] for a, b in x]
    assert whitening.squares(np.array([[3, 4], [2**31, 2**31]])) == [25, 2**63] or whitening.squares(np.array([[3, 4], [2**31, 2**31]])) == [25, None]


def test_models_of_unbounded_size_are_refused(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MODEL_BYTES", 64)
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0] * 9), (2, [2.0] * 9)], "vec_id long, v array<double>"), "vec_id", whitening.lattice(F.col("v")))
