"""Embedding whitening: exact integer sums, centred products by GEMM merged in a tree, LAPACK's eigh, a broadcast projection."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Rows that a task turns into a matrix at once, and bytes of it at most.
ROWS, BYTES = 4096, 8_000_000
#: Bytes of all models (products and components of each vector length) that the driver holds and sends.
MODEL_BYTES = 256_000_000
#: Whole numbers beyond it would leave 64 bits once the offset is added; entries are held to it.
FAR = 1 << 61


def lattice(vector: Column, scale: int = 64, offset: int = 1_000_000) -> Column:
    """floor(scale * c) + offset of every entry as array<long>; null for null vectors and those with null or non-finite entries.

    Entries so large that the result would leave 64 bits count as plus or minus 2^61 before the offset.
    """
    e = vector.cast("array<double>")
    bad = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(e, lambda c: F.floor(F.greatest(F.lit(-float(FAR)), F.least(F.lit(float(FAR)), c * scale))) + F.lit(offset))
    return F.when(~F.coalesce(bad, F.lit(True)), whole)


def _matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a list<long> column by length: (row numbers, matrix), at most ROWS rows and BYTES bytes each."""
    lists = batch.column(column)
    offsets = np.asarray(lists.offsets, np.int64)
    values, sizes = lists.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        step = max(1, min(ROWS, BYTES // (8 * max(int(d), 1))))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            yield some, values[offsets[some][:, None] + np.arange(d)]


def _sums(points: DataFrame) -> DataFrame:
    """(dim, at, n, s): rows and the exact sum of each entry, for every vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        rows: dict[int, int] = {}
        for batch in batches:
            for some, x in _matrices(batch, 0):
                d = x.shape[1]
                high, low = x >> 32, x & 0xFFFFFFFF  # neither sum leaves 64 bits
                s = [int(h) * (1 << 32) + int(w) for h, w in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]
                total[d] = total.get(d, 0) + np.array(s, object)
                rows[d] = rows.get(d, 0) + len(some)
        dims = sorted(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([d for d in dims for _ in range(d)], pa.int32()), pa.array([i for d in dims for i in range(d)], pa.int32()), pa.array([rows[d] for d in dims for _ in range(d)], pa.int64()), pa.array([Decimal(int(v)) for d in dims for v in total[d]], pa.decimal128(38, 0))],
            names=["dim", "at", "n", "s"],
        )

    parts = points.select("x").mapInArrow(run, "dim int, at int, n long, s decimal(38,0)")
    return parts.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))


def differences(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - s, exactly: 64-bit integers where nothing can leave them, else Python's."""
    most = max(int(np.abs(x).max(initial=0)), 1)
    if 2 * n * most < 1 << 63 and max((abs(v) for v in s), default=0) < 1 << 62:
        return x * np.int64(n) - np.array(s, np.int64)
    return x.astype(object) * n - np.array(s, object)


def squares(d: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly; None beyond 64 bits."""
    most = max(abs(int(d.max(initial=0))), abs(int(d.min(initial=0))))
    if d.dtype != object and most * most * max(d.shape[1], 1) < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    sums = [sum(int(v) ** 2 for v in row) for row in d]
    return [v if v < 1 << 63 else None for v in sums]


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """x - s / n to double precision, from the exact difference."""
    return (differences(x, n, s) / n).astype(np.float64)


def _products(points: DataFrame, means: dict, project: dict | None = None, depth: int = 3) -> dict[int, np.ndarray]:
    """For each length, the sum of outer products of the centred rows (or of their projections), merged in a tree of tasks.

    A task makes one row a length, whatever its rows; the projections get a last entry of ones, so that their sums come too.
    """
    sent = points.sparkSession.sparkContext.broadcast((means, project))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, project = sent.value
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for some, x in _matrices(batch, 0):
                d = x.shape[1]
                if d not in means:
                    continue
                c = centred(x, *means[d])
                if project is not None:
                    c = np.column_stack([c @ project[d], np.ones(len(some))])
                g = c.T @ c
                total[d] = total[d] + g if d in total else g
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([g.astype("<f8").tobytes() for g in total.values()], pa.binary())], names=["dim", "g"])

    def add(a: dict, b: dict) -> dict:
        for d, g in b.items():
            a[d] = a[d] + g if d in a else g
        return a

    def read(a: dict, row) -> dict:
        g = np.frombuffer(row["g"], "<f8")
        return add(a, {row["dim"]: g.reshape(round(len(g) ** 0.5), -1)})

    out = points.select("x").mapInArrow(run, "dim int, g binary").rdd.treeAggregate({}, read, add, depth)
    sent.unpersist()
    return out


def eigen(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; none that double precision can't tell from 0."""
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    k = int(np.count_nonzero(e[:components] > max(e[0], 0) * len(e) * np.finfo(float).eps * 4)) if len(e) else 0
    return e[:k], u[:, :k]


def whiten(df: DataFrame, vec_id: str, x: Column, components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: every row on the leading components of its table.

    x: array<long>. The fit list has each distinct vector once; equal vectors are merged before the shuffle, so a hot one
    costs a row a task. A first pass over the list sums entries as exact integers, a second one the outer products of centred
    rows (task by task as a matrix product, merged in a tree), LAPACK gives the eigenvectors, and their projection is sent to
    all rows. A third pass takes the covariance of the whitened list itself: identity_error is its largest absolute distance from the
    identity. Vectors of another length are a list of their own. The driver holds and sends one model a length, of length x
    length numbers, and refuses to when all of them would exceed MODEL_BYTES: it doesn't grow with the rows.

    Null x (a null vector, or one with entries that lattice() refuses) and empty vectors give no rows; null ids and repeated rows
    are rows like others. Components whose variance is 0 to double precision have no whitened values and are left out, so
    a list of one vector gives no rows, and one of few vectors or dimensions fewer than ``components`` a row. A deviation
    beyond 64 bits is null. Other columns of df don't matter, whatever their names. An empty table gives no rows.
    """
    rows = C.keep(df.select(F.col(vec_id).alias("vec_id"), x.alias("x")).filter(F.col("x").isNotNull() & (F.size("x") > 0)))
    points = C.keep(rows.select("x").distinct())
    lengths = [r[0] for r in points.select(F.size("x")).distinct().limit(MODEL_BYTES // 8).collect()]
    if sum(8 * d * d for d in lengths) > MODEL_BYTES:
        raise ValueError("vectors of so many or so great lengths have models beyond MODEL_BYTES")
    means: dict[int, tuple[int, list[int]]] = {}
    for r in _sums(points).orderBy("dim", "at").collect():  # a row for each entry of a model
        means.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))
    models, project = {}, {}
    for d, g in _products(points, means).items():
        v = g / means[d][0]
        e, u = eigen(v, components)
        models[d] = [e / np.trace(v) if len(e) else e, 0.0]
        project[d] = u / np.sqrt(e)
    for d, g in _products(points, means, project).items():
        n, k = means[d][0], project[d].shape[1]
        mean = g[:k, k] / n
        models[d][1] = float(np.abs(g[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max(initial=0))
    sent = df.sparkSession.sparkContext.broadcast({d: (*means[d], project[d], *models[d]) for d in models})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for some, x in _matrices(batch, 1):
                n, s, w, explained, error = model[x.shape[1]]
                k, m = w.shape[1], len(some)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(some[each])), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), pa.array(squares(differences(x, n, s)), pa.int64()).take(pa.array(each)), pa.array((centred(x, n, s) @ w).ravel()), pa.array(np.tile(explained, m), pa.float64()), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("vec_id", vec_id)


def query(spark, sf_dir: str) -> DataFrame:
    """The embeddings in 64ths, on 16 components."""
    return whiten(C.table(spark, sf_dir, "embeddings"), "vec_id", lattice(F.col("embedding")))
