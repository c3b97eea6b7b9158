"""Near-duplicate embeddings against all pairs, the graphs themselves, and hard cases."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lengthloom.llm import hnsw, neardup, queries


def brute(rows, threshold=0.95):
    """Counter of (id, n_links, component_id, kept) over all pairs."""
    good = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, root = {i: set() for i in range(len(rows))}, list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(good):
        for j in good[:n]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(a) == len(b) and (a / np.linalg.norm(a)) @ (b / np.linalg.norm(b)) >= threshold:
                links[i].add(j)
                links[j].add(i)
                root[top(i)] = top(j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(k)
    out = Counter()
    for i, (k, _) in enumerate(rows):
        named = [x for x in ids[top(i)] if x is not None]
        c = min(named) if named else None
        out[k, len(links[i]), c, c == k] += 1
    return out


def planted(seed, n=900, d=24, groups=40):
    """Random directions, groups of near copies, exact copies and scaled ones."""
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=d) for _ in range(n)]
    for g in range(groups):
        x += [x[g] + rng.normal(size=d) * rng.choice([0.02, 0.2, 0.3]) for _ in range(int(rng.choice([1, 2, 60 if g == 0 else 5])))]
    x += [x[3]] * 50 + [x[4] * 7.0]
    return [(int(i), [float(np.float32(c)) for c in v]) for i, v in zip(rng.permutation(len(x)), x, strict=True)]


def result(d):
    return Counter(tuple(r) for r in neardup.near_duplicates(d, "vec_id", F.col("embedding")).select("vec_id", "n_links", "component_id", "kept").collect())


def test_links_equal_all_pairs(spark):
    rows = planted(1)
    assert result(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)) == brute(rows)


def test_many_graphs_and_blocks_give_the_same(spark, monkeypatch):
    """Small graphs, blocks and parts of components; vectors in few directions, so that cells are far apart and dense."""
    for name, value in (("SHARD", 256), ("BLOCK", 64), ("PART", 16), ("TURN", 2)):
        monkeypatch.setattr(neardup, name, value)
    rng = np.random.default_rng(5)
    ends = np.eye(8)
    rows = [(i, [float(np.float32(c)) for c in ends[i % 8 if i % 3 else 0] * 3 + rng.normal(size=8) * 0.28]) for i in range(1200)]
    got, want = result(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), brute(rows)
    both = sum((got & want).values())
    assert both >= 0.99 * len(rows)
    assert sum(r[1] * m for r, m in got.items()) >= 0.99 * sum(r[1] * m for r, m in want.items())


def test_query_equals_all_pairs(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = Counter(tuple(r) for r in queries.queries()["op11_small_world_graphs"](spark, "/root/testdata/sf0.001").select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == brute(rows)


def test_hard_rows(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (None, [1.0, 0.0]), (None, None), (8, [2.0, 0.0]), (9, [1e-200, 1e-205]), (10, [1e300, 0.0]), (11, [1.0]), (12, [-3.0]), (13, [0.5]), (None, [0.0, -1.0]), (14, [0.0, 1.0]), (14, [0.0, 1.0])]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, component_id string, node int")
    assert result(d) == brute([(k, {9: [1.0, 1e-5], 10: [1.0, 0.0]}.get(k, v)) for k, v in rows])


def test_a_graph_finds_neighbours():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.build(x)
    assert [len(layer) for layer in g.layers][0] == 3000 and all(len(a) > len(b) or len(b) == 1 for a, b in zip(g.layers, g.layers[1:]))
    for layer in g.layers:
        for i, links in enumerate(layer.tolist()):
            mine = [p for p in links if p >= 0]
            assert len(set(mine)) == len(mine) and i not in mine and max(mine, default=0) < len(layer)
    width = hnsw.audited_width(g, 0.95, 0.95)
    found, score = hnsw.search(g, x[:500], width)
    exact = np.sort(x[:500] @ x.T, axis=1)[:, ::-1][:, :10]
    assert (np.sort(score, axis=1)[:, ::-1][:, :10] >= exact - 1e-5).mean() > 0.8
    assert (found == np.arange(500)[:, None]).any(axis=1).mean() > 0.95
    assert width < 3000


@pytest.mark.parametrize("n", [0, 1, 2, 17])
def test_small_graphs(n):
    x = np.eye(32, dtype=np.float32)[:n]
    g = hnsw.build(x)
    found, score = hnsw.search(g, x, 32)
    assert n == 0 or (np.sort(found, axis=1)[:, -n:] == np.arange(n)).all()
