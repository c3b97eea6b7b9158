"""Embedding near-duplicates: navigable small-world graphs per shard, audited beams, exact cosines, components of links."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import hnsw
from .components import components
from .jaccard import labels, whole_groups

#: Vectors of a graph, of a block of queries, and of a block of a component, at most; bytes of a graph's vectors.
SHARD, BLOCK, PART, BYTES = 32_768, 4096, 2048, 64_000_000
#: Centres of cells at most. Vectors of a cell that is denser than a graph are dealt to several graphs.
CENTRES = 4096
#: Blocks that meet a graph in one task at most, and tasks that are made before a task gets more than one block.
TURN, TASKS = 16, 24
#: Share of planted neighbours that a graph's beam has to find. Links are sought from both sides, so one pair in 400 is missed.
RECALL = 0.95
#: Products in single precision that may be links are computed again in double precision.
MARGIN = 1e-4


def _pack(x: np.ndarray) -> bytes:
    """Rows as bytes, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        small = x.astype("<f4")
    return small.tobytes() if (small == x).all() else x.astype("<f8").tobytes()


def _unpack(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<f8" if len(data) == 8 * rows * dim else "<f4").reshape(rows, dim).astype(np.float64)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.vstack([np.zeros((0, dim)), *(_unpack(b, 1, dim) for b in column.to_pylist())])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length; a power of two is taken out first, so that no square leaves the range of doubles."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _dealt(classes: DataFrame, dim: int, centres: np.ndarray) -> DataFrame:
    """(node, cell, v): each vector as bytes, in the cell of its nearest centre."""
    sent = classes.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.tidy("neardup")
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                b = whole.slice(a, 1024)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                cell = (unit(x) @ sent.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell, pa.int32()), pa.array([_pack(r) for r in x], pa.binary())], names=["node", "cell", "v"])

    return classes.select("node", "vector").mapInArrow(run, "node long, cell int, v binary")


GRAPH = "cell int, part int, ids binary, vectors binary, sizes array<long>, links binary, width int, radius double"
BLOCKS = "cell int, part int, block long, ids binary, vectors binary, cells array<int>"


def _build(dim: int, threshold: float, centres: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        C.tidy("neardup")
        table = table.sort_by("node")
        ids, cell, part = table["node"].to_numpy(), table["cell"][0].as_py(), table["part"][0].as_py()
        order = np.random.default_rng(len(ids)).permutation(len(ids))  # any order, but the same one in each attempt
        ids, x = ids[order], _matrix(table["v"], dim)[order]
        u = unit(x)
        g = hnsw.build(u.astype(np.float32))
        width = hnsw.audited_width(g, threshold, RECALL)
        radius = float(_angle(u, centres[cell : cell + 1]).max())
        return pa.Table.from_pydict({"cell": pa.array([cell], pa.int32()), "part": pa.array([part], pa.int32()), "ids": [ids.astype("<i8").tobytes()], "vectors": [_pack(x)], "sizes": pa.array([[len(links) for links in g.layers]], pa.list_(pa.int64())), "links": [b"".join(links.astype("<i4").tobytes() for links in g.layers)], "width": pa.array([width], pa.int32()), "radius": [radius]})

    return run


def _graph(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray, hnsw.Graph]:
    """(ids, unit vectors, graph) of a row of GRAPH."""
    ids = np.frombuffer(row["ids"], "<i8")
    u = unit(_unpack(row["vectors"], len(ids), dim))
    flat, layers, at = np.frombuffer(row["links"], "<i4"), [], 0
    for layer, n in enumerate(row["sizes"]):
        width = (hnsw.M if layer else hnsw.BOTTOM) + hnsw.SLACK
        layers.append(flat[at : at + n * width].reshape(n, width))
        at += n * width
    return ids, u, hnsw.Graph(u.astype(np.float32), layers)


def _blocks(graphs: DataFrame, dim: int, threshold: float, centres: np.ndarray, radii: np.ndarray, rows: int) -> DataFrame:
    """All vectors as queries, in blocks, with the cells that can hold a link: those of which the block's cone comes near."""
    sent = graphs.sparkSession.sparkContext.broadcast((centres, radii))
    reach = acos(threshold) + 1e-6 if threshold < 1 else 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radii = sent.value
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                x = _unpack(r["vectors"], len(ids), dim)
                for a in range(0, len(ids), rows):
                    u = unit(x[a : a + rows])
                    c = u.mean(axis=0, keepdims=True)
                    c = unit(c) if np.abs(c).max() > 0 else u[:1]
                    near = np.flatnonzero(_angle(c, centres)[0] <= radii + float(_angle(u, c).max()) + reach)
                    yield pa.RecordBatch.from_arrays([pa.array([r["cell"]], pa.int32()), pa.array([r["part"]], pa.int32()), pa.array([a // rows], pa.int64()), pa.array([ids[a : a + rows].tobytes()], pa.binary()), pa.array([_pack(x[a : a + rows])], pa.binary()), pa.array([near.tolist()], pa.list_(pa.int32()))], names=[f.split(" ")[0] for f in BLOCKS.split(", ")])

    return graphs.select("cell", "part", "ids", "vectors").mapInArrow(run, BLOCKS)


def _search(dim: int, threshold: float, centres: np.ndarray):
    """Blocks against one graph: a forest of the links found, each of a cosine that double precision confirms."""
    reach = (acos(threshold) if threshold < 1 else 0.0) + 1e-6

    def run(blocks: pa.Table, graph: pa.Table) -> pa.Table:
        C.tidy("neardup")
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row in graph.to_pylist():  # one
            ids, u, g = _graph(row, dim)
            for b in range(blocks.num_rows):
                mine = np.frombuffer(blocks["ids"][b].as_py(), "<i8")
                q = unit(_unpack(blocks["vectors"][b].as_py(), len(mine), dim))
                near = _angle(q, centres[row["to_cell"] : row["to_cell"] + 1])[:, 0] <= row["radius"] + reach
                mine, q = mine[near], q[near]
                found, score = hnsw.search(g, q.astype(np.float32), row["width"])
                i, j = np.nonzero(score >= threshold - MARGIN)
                p = found[i, j]
                ok = (np.einsum("ij,ij->i", q[i], u[p]) >= threshold) & (mine[i] != ids[p])
                i, p = mine[i[ok]], ids[p[ok]]
                every, at = np.unique(np.concatenate([i, p]), return_inverse=True)
                root = labels(len(every), at[: len(i)], at[len(i) :])
                some = np.flatnonzero(root != np.arange(len(every)))
                left.append(every[some])
                right.append(every[root[some]])
        return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})

    return run


def _found(classes: DataFrame, n: int, dim: int, threshold: float) -> DataFrame:
    """(a, b): links that the graphs find among classes of one length, as forests."""
    shard = max(256, min(SHARD, BYTES // (8 * dim)))
    block = max(64, min(BLOCK, shard // 4))
    first = classes.orderBy(F.xxhash64(F.lit("centre"), "node"), "node").limit(min(CENTRES, max(1, n // shard))).select("vector").collect()
    centres = unit(np.array([r[0] for r in first], np.float64).reshape(-1, dim))
    cells = C.keep(_dealt(classes, dim, centres))
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / shard).cast("long").alias("parts"))
    dealt = C.look_up(cells, parts, "cell", "node").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "node"), "parts").cast("int"))
    graphs = C.keep(dealt.select("cell", "part", "node", "v").groupBy("cell", "part").applyInArrow(_build(dim, threshold, centres), GRAPH))
    each = {r["cell"]: r for r in graphs.groupBy("cell").agg(F.max("radius").alias("radius"), F.count("*").alias("n")).collect()}  # a row a centre at most
    radii = np.array([each[c]["radius"] if c in each else -2 * pi for c in range(len(centres))])
    blocks = C.keep(_blocks(graphs, dim, threshold, centres, radii, block))
    pairs = blocks.count() * sum(r["n"] for r in each.values())
    turn = max(1, min(TURN, pairs // TASKS))
    turns = -(-blocks.count() // turn)
    spread = F.pmod(F.xxhash64("cell", "part", "block"), F.lit(turns))
    # A graph goes to as many tasks as its queries' blocks need, and a block to the graphs whose cones its own comes near.
    left = blocks.select(spread.alias("turn"), F.explode("cells").alias("cell"), "ids", "vectors")
    left = left.join(graphs.select("cell", "part"), "cell").select("cell", "part", "turn", "ids", "vectors")
    needed = left.select("cell", "part", "turn").distinct()
    right = needed.join(graphs, ["cell", "part"]).select(*(F.col(c).alias(f"to_{c}") for c in ("cell", "part", "turn")), *(x.split(" ")[0] for x in GRAPH.split(", ")[2:]))
    return left.groupBy("cell", "part", "turn").cogroup(right.groupBy("to_cell", "to_part", "to_turn")).applyInArrow(_search(dim, threshold, centres), "a long, b long")


def _counted(members: DataFrame, threshold: float) -> DataFrame:
    """(key, size, node, copies, dim, v) of the vectors of components -> (node, links, class_links): how many others, copies included, and how many
    other classes each is linked with. Every pair of a component is computed in double precision, block by block in large ones."""
    blocks = F.ceil(F.col("size") / F.lit(PART)).cast("int")
    d = members.withColumn("_n", blocks).withColumn("_at", F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("_n")).cast("int"))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    d = d.withColumns({"lo": F.least("_at", "_o"), "hi": F.greatest("_at", "_o"), "side": (F.col("_at") > F.col("_o")).cast("int")})
    d = d.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.tidy("neardup")
        for t, begin in whole_groups(batches, ["key", "lo", "hi"], 2 * PART):
            node, side, copies, dims = t["node"].to_numpy(), t["side"].to_numpy(), t["copies"].to_numpy(), t["dim"].to_numpy()
            two, end = t["lo"].to_numpy()[begin] != t["hi"].to_numpy()[begin], np.append(begin[1:], len(node))
            links, classes = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
            for g in range(len(begin)):
                rows = np.arange(begin[g], end[g])
                u = unit(_matrix(t["v"].slice(begin[g], len(rows)), int(dims[begin[g]])))
                left, right = (np.flatnonzero(side[rows] == s) for s in (0, 1)) if two[g] else (np.arange(len(rows)),) * 2
                for a in range(0, len(left), 512):
                    some = left[a : a + 512]
                    link = u[some] @ u[right].T >= threshold
                    if not two[g]:
                        link[np.arange(len(some)), some] = False
                    links[rows[some]] += link @ copies[rows[right]]
                    classes[rows[some]] += link.sum(axis=1)
                    if two[g]:
                        links[rows[right]] += copies[rows[some]] @ link
                        classes[rows[right]] += link.sum(axis=0)
            some = np.flatnonzero(classes)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(classes[some])], names=["node", "links", "class_links"])

    out = d.select("key", "lo", "hi", "side", "node", "copies", "dim", "v").mapInArrow(run, "node long, links long, class_links long")
    return out.groupBy("node").agg(F.sum("links").alias("links"), F.sum("class_links").alias("class_links"))


def near_duplicates(df: DataFrame, vec_id: str, vector: Column, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept: links are pairs of vectors with a cosine of at least ``threshold``.

    Equal vectors are one class (by a 128-bit hash) and enter once. Classes lie in cells by their nearest centre (a bounded
    sample of the vectors, one for each graph up to CENTRES), a cell in as many hierarchical navigable small-world graphs as it
    fills. Each graph widens its beam until it finds the share RECALL of neighbours planted at the threshold itself.
    Every vector then asks every graph, but for those whose cell is so far in angle that no link can exist. What is found is
    verified in double precision, goes on as forests, and gives components; in these every pair is computed, so n_links is
    exact for the component and the same from both sides. No row is made for a pair. component_id is the smallest vec_id that links
    reach, kept whether the row has it.

    Null, zero and empty vectors and those with null or non-finite entries link with nothing; so do vectors of different lengths.
    A null id is kept and never names a component unless all ids in it are null. Rows that repeat an id are vectors of their
    own; each that has its component's id is kept. Other columns don't matter, whatever their names. An empty table gives no rows.
    """
    e = vector.cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(~bad & F.exists(e, lambda x: x != 0), F.lit(False))
    d = df.select(F.col(vec_id).alias("id"), F.when(good, e).alias("vector"))
    d = C.keep(d.withColumn("same", F.when(F.col("vector").isNotNull(), F.struct(F.xxhash64("vector").alias("h"), F.xxhash64(F.lit("second"), "vector").alias("i")))))
    k = d.filter("same is not null").groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    k = C.keep(k.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("vector")}))
    found = d.sparkSession.createDataFrame([], "a long, b long")
    for r in k.groupBy("dim").count().collect():  # the lengths of vectors, one as a rule
        found = found.unionByName(C.keep(_found(k.filter(F.col("dim") == r["dim"]), r["count"], r["dim"], threshold)))
    near = components(found).withColumnRenamed("root", "key")
    near = C.look_up(near, near.groupBy("key").agg(F.count("*").alias("size")), "key", "id").withColumnRenamed("id", "node")
    near = C.keep(near.join(k.select("node", "copies", "dim", "vector"), "node"))
    counts = _counted(_as_bytes(near), threshold)
    c = k.select("same", "node", "rep", "copies").join(near.select("node", "key"), "node", "left").withColumn("key", F.coalesce("key", "node")).join(counts, "node", "left")
    least = c.groupBy("key").agg(F.min("rep").alias("component_id"))
    c = C.keep(c.join(least, "key").select("same", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = C.look_up(d.select("id", "same"), c, "same", "id")
    component = F.when(F.col("same").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _as_bytes(near: DataFrame) -> DataFrame:
    """near, with its vectors as bytes ``v``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                b = whole.slice(a, 1024)
                lists = b.column(5)
                off, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([_pack(flat[i:j]) for i, j in zip(off[:-1], off[1:], strict=True)], pa.binary())], names=[*b.schema.names[:5], "v"])

    return near.select("key", "size", "node", "copies", "dim", "vector").mapInArrow(run, "key long, size long, node long, copies long, dim int, v binary")


def query(spark, sf_dir: str) -> DataFrame:
    """All embeddings, whatever their labels, at a cosine of 0.95."""
    return near_duplicates(C.table(spark, sf_dir, "embeddings"), "vec_id", F.col("embedding"))
