"""Exact top-k search by inner product: shards by space, a KD-tree each, best-first over boxes, the kth score handed on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

LEAF = 64
#: Root boxes that meet a block of queries at once.
PACK = 256


@dataclass
class Cuts:
    """The top of a KD-tree: for each node the dimension it is cut in (-1 for a cell), the least value of its right side, its left
    child, which the right one follows, and the number of a cell; cells that follow each other lie side by side."""

    axis: np.ndarray
    value: np.ndarray
    child: np.ndarray
    cell: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        node = np.zeros(len(x), np.int64)
        while len(at := np.flatnonzero(self.axis[node] >= 0)):
            n = node[at]
            node[at] = self.child[n] + (x[at, self.axis[n]] >= self.value[n])
        return self.cell[node]


def space_cuts(x: np.ndarray, parts: float) -> Cuts:
    """Cuts at medians of the widest side, until a cell has one of ``parts`` equal shares of x, fewer than two leaves, or one vector only."""
    axis, value, child, cell = [-1], [0], [0], [0]
    stack, cells = [(0, np.arange(len(x)))], 0
    while stack:
        node, at = stack.pop()
        wide = x[at].max(axis=0) - x[at].min(axis=0)
        i = int(np.argmax(wide))
        if len(at) <= max(len(x) / parts, 2 * LEAF) or wide[i] == 0:
            cell[node], cells = cells, cells + 1
            continue
        c = np.sort(x[at, i])
        v = c[len(c) // 2] if c[len(c) // 2] > c[0] else c[np.searchsorted(c, c[0], "right")]
        axis[node], value[node], child[node] = i, v, len(axis)
        right = x[at, i] >= v
        stack += [(len(axis) + 1, at[right]), (len(axis), at[~right])]
        axis, value, child, cell = axis + [-1, -1], value + [0, 0], child + [0, 0], cell + [0, 0]
    return Cuts(np.array(axis), np.array(value), np.array(child), np.array(cell))


@dataclass
class Tree:
    """A KD-tree: rows in leaf order, and for each node its tight box, its rows and its two children (0 for a leaf)."""

    ids: np.ndarray
    x: np.ndarray
    child: np.ndarray  # nodes x 2
    rows: np.ndarray  # nodes x 2: begin and end
    low: np.ndarray
    high: np.ndarray


def kd_tree(ids: np.ndarray, x: np.ndarray) -> Tree:
    """Median splits along the widest side of the tight box, by rank, so ties split as well, down to LEAF rows."""
    order, rows, child, low, high = np.arange(len(x)), [(0, len(x))], [(0, 0)], [], []
    node = 0
    while node < len(rows):
        begin, end = rows[node]
        at = order[begin:end]
        low.append(x[at].min(axis=0))
        high.append(x[at].max(axis=0))
        if len(at) > LEAF:
            half = len(at) // 2
            order[begin:end] = at[np.argpartition(x[at, int(np.argmax(high[-1] - low[-1]))], half)]
            child[node] = (len(rows), len(rows) + 1)
            rows += [(begin, begin + half), (begin + half, end)]
            child += [(0, 0), (0, 0)]
        node += 1
    return Tree(ids[order], x[order], np.array(child), np.array(rows), np.array(low), np.array(high))


def best_first(q: np.ndarray, own: np.ndarray, floor: np.ndarray, tree: Tree, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Top k of each query among the rows of a tree: scores and ids of k columns, unused places with score -inf; leaves visited.

    A box bounds the inner product by its better corner. Each query keeps the nodes that it has reached but not opened, opens the
    one of the best bound, and stops when that is below its kth score so far, or below ``floor``, the kth score that it had
    in other shards; bounds that equal it are still opened, as ties go to smaller ids. All queries take a step at once;
    those that open the same leaf are scored together.
    """
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    bound = np.full((len(q), len(tree.child)), -np.inf)
    bound[:, 0] = plus @ tree.high[0] + minus @ tree.low[0]
    best, who = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    live, visited = np.arange(len(q)), 0
    while len(live):
        node = bound[live].argmax(axis=1)
        top = bound[live, node]
        on = (top >= np.maximum(best[live, k - 1], floor[live])) & (top > -np.inf)
        live, node = live[on], node[on]
        bound[live, node] = -np.inf
        inner = tree.child[node, 0] > 0
        at = live[inner]
        for side in range(2):
            c = tree.child[node[inner], side]
            bound[at, c] = (plus[at] * tree.high[c] + minus[at] * tree.low[c]).sum(axis=1)
        leaf, at = node[~inner], live[~inner]
        visited += len(at)
        by = np.argsort(leaf, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1) if len(by) else []:
            i, rows = at[part], slice(*tree.rows[leaf[part[0]]])
            s = q[i] @ tree.x[rows].T
            s[own[i][:, None] == tree.ids[rows][None, :]] = -np.inf
            s[s < floor[i][:, None]] = -np.inf
            s, ids = np.hstack([best[i], s]), np.hstack([who[i], np.broadcast_to(tree.ids[rows], (len(i), rows.stop - rows.start))])
            first = np.lexsort((ids, -s), axis=1)[:, :k]
            best[i], who[i] = np.take_along_axis(s, first, 1), np.take_along_axis(ids, first, 1)
    return best, who, visited


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, dim).astype(np.float64)


TREE = "dim int, shard long, ids binary, vectors binary, children binary, rows binary, low binary, high binary"
BLOCK = "dim int, block long, query_ids binary, queries binary, floors binary"
ASKED = "dim int, block long, shard long, nths binary, query_ids binary, queries binary, floors binary"
FOUND = "dim int, block long, nth int, query_id long, vec_id long, score long"


def _cuts(d: DataFrame, shard_rows: int, sample_values: int) -> dict[int, Cuts]:
    """Cuts for each length of vectors, from a sample of about ``sample_values`` values in all; lengths with few sampled rows have none."""
    values = d.agg(F.sum("dim")).first()[0] or 0
    rate = min(1.0, sample_values / max(values, 1))
    t = d.filter(C.uniform(F.xxhash64(F.lit("sample"), F.monotonically_increasing_id())) < rate).select("dim", "v").toArrow()
    dims = t["dim"].to_numpy()
    cuts = {}
    for dim in np.unique(dims).tolist():
        at = t["v"].filter(pa.array(dims == dim)).combine_chunks()
        if len(at) > 2 * LEAF and len(at) > shard_rows * rate:
            cuts[dim] = space_cuts(np.array(at.flatten(), np.int64).reshape(-1, dim), len(at) / (shard_rows * rate))
    return cuts


def _in_cells(d: DataFrame, cuts: dict[int, Cuts]) -> DataFrame:
    """d with the cell of each row; 0 where its length has no cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                if dim in cuts:
                    v = batch.column("v").filter(pa.array(dims == dim))
                    cell[dims == dim] = cuts[dim].place(np.array(v.flatten(), np.int64).reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return d.mapInArrow(run, "vec_id long, v array<bigint>, _q boolean, dim int, cell long")


def _dealt(d: DataFrame, shard_rows: int, block_rows: int) -> DataFrame:
    """Rows in cells with their shard and, for queries, their block.

    A cell with more rows than a shard has, such as one of many equal vectors, is dealt to several by hash. Cells that follow
    each other share a block while it has room.
    """
    w = Window.partitionBy("dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as cells, at most a few thousand
    up = lambda c, size: F.greatest(F.ceil(F.col(c) / size), F.lit(1)).cast("long")
    sizes = d.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.count_if("_q").alias("asked")).withColumns({"shards": up("n", shard_rows), "blocks": up("asked", block_rows)})
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    sizes = sizes.select("dim", "cell", "shards", "blocks", before("shards").alias("shard0"), F.floor(before("asked") / block_rows).alias("block0"))
    spread = F.xxhash64(F.monotonically_increasing_id())  # rows of a written table: repeated ones are dealt apart
    d = d.withColumn("_h", spread).join(sizes, ["dim", "cell"])
    return d.select("dim", "vec_id", "v", "_q", (F.col("shard0") + F.pmod("_h", "shards")).alias("shard"), (F.col("block0") + F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.col("blocks"))).alias("block"))


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest inner product that each query can have in each box."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def _boxes(roots, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards, lower and upper corners of a list of root boxes."""
    low, high = (np.frombuffer(b"".join(r[c] for r in roots), "<i8").reshape(-1, dim).astype(np.float64) for c in ("low", "high"))
    return np.array([r["shard"] for r in roots], np.int64), low, high


def _ranked(ask: DataFrame, roots: DataFrame) -> DataFrame:
    """dim, block, shard, place: for each block all shards of its length, from the one with the greatest sum of bounds on."""
    packs = roots.withColumn("pack", F.floor(F.col("shard") / PACK)).groupBy("dim", "pack").agg(F.collect_list(F.struct("shard", "low", "high")).alias("roots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, block, queries, roots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard, low, high = _boxes(roots, dim)
                total = _bounds(_matrix(queries, dim), low, high).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shard), dim), pa.int32()), pa.array(np.full(len(shard), block)), pa.array(shard), pa.array(total)], names=["dim", "block", "shard", "total"])

    totals = ask.join(packs, "dim").select("dim", "block", "queries", "roots").mapInArrow(run, "dim int, block long, shard long, total double")
    return totals.select("dim", "block", "shard", (F.row_number().over(Window.partitionBy("dim", "block").orderBy(F.desc("total"), "shard")) - 1).alias("place"))


def _reaching(ask: DataFrame, turn: DataFrame, roots: DataFrame) -> DataFrame:
    """For each block and shard of turn the queries that may still find something there: those whose kth score the shard's box reaches.

    What no query reaches goes before trees are joined.
    """
    packs = turn.join(roots, ["dim", "shard"]).withColumn("pack", F.floor(F.col("place") / PACK)).groupBy("dim", "block", "pack").agg(F.collect_list(F.struct("shard", "low", "high")).alias("roots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                q, own, floor = _matrix(r["queries"], r["dim"]), np.frombuffer(r["query_ids"], "<i8"), np.frombuffer(r["floors"])
                shard, low, high = _boxes(r["roots"], r["dim"])
                on = _bounds(q, low, high) >= floor[:, None]
                for i in np.flatnonzero(on.any(axis=0)):
                    nth = np.flatnonzero(on[:, i])
                    parts = (nth.astype("<i8"), own[nth], q[nth].astype("<i8"), floor[nth])
                    yield pa.RecordBatch.from_arrays([pa.array([r["dim"]], pa.int32()), pa.array([r["block"]]), pa.array([shard[i]]), *(pa.array([a.tobytes()], pa.binary()) for a in parts)], names=[x.split()[0] for x in ASKED.split(", ")])

    return packs.join(ask, ["dim", "block"]).select("dim", "block", "query_ids", "queries", "floors", "roots").mapInArrow(run, ASKED)


def _build(table: pa.Table) -> pa.Table:
    dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
    x = np.array(table["v"].combine_chunks().flatten(), np.int64).reshape(-1, dim)
    t = kd_tree(np.array(table["vec_id"].combine_chunks(), np.int64), x)
    parts = {n: [a.astype("<i8").tobytes()] for n, a in (("ids", t.ids), ("vectors", t.x), ("children", t.child), ("rows", t.rows), ("low", t.low), ("high", t.high))}
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": [shard], **parts})


def _block(table: pa.Table) -> pa.Table:
    ids = np.array(table["vec_id"].combine_chunks(), np.int64)
    x = np.array(table["v"].combine_chunks().flatten(), np.int64)
    return pa.table({"dim": pa.array([table["dim"][0].as_py()], pa.int32()), "block": [table["block"][0].as_py()], "query_ids": [ids.astype("<i8").tobytes()], "queries": [x.astype("<i8").tobytes()], "floors": [np.full(len(ids), -np.inf).tobytes()]})


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """Every (tree, queries of a block) of pairs: their best rows in that tree; nth is the query's place in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                q, own = _matrix(r["queries"], r["dim"]), np.frombuffer(r["query_ids"], "<i8")
                tree = Tree(np.frombuffer(r["ids"], "<i8"), _matrix(r["vectors"], r["dim"]), *(np.frombuffer(r[n], "<i8").reshape(-1, 2) for n in ("children", "rows")), _matrix(r["low"], r["dim"]), _matrix(r["high"], r["dim"]))
                best, who, _ = best_first(q, own, np.frombuffer(r["floors"]), tree, k)
                nth, place = np.nonzero(np.isfinite(best))
                n = len(nth)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["dim"]), pa.int32()), pa.array(np.full(n, r["block"]), pa.int64()), pa.array(np.frombuffer(r["nths"], "<i8")[nth], pa.int32()), pa.array(own[nth], pa.int64()), pa.array(who[nth, place], pa.int64()), pa.array(best[nth, place].astype(np.int64), pa.int64())], names=[x.split()[0] for x in FOUND.split(", ")])

    return pairs.select("dim", "block", "nths", "query_ids", "queries", "floors", "ids", "vectors", "children", "rows", "low", "high").mapInArrow(run, FOUND)


def _with_floors(blocks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Blocks with each query's kth score so far."""
    kth = found.groupBy("dim", "block", "nth").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") >= k)
    kth = kth.groupBy("dim", "block").agg(F.collect_list(F.struct("nth", "s")).alias("kth"))  # at most a block's queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = []
            for old, got in zip(batch.column(4), batch.column(5), strict=True):
                f = np.frombuffer(old.as_py()).copy()
                for x in got.as_py() or []:
                    f[x["nth"]] = x["s"]
                floors.append(f.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(floors, pa.binary())], names=batch.schema.names[:5])

    return blocks.join(kth, ["dim", "block"], "left").select("dim", "block", "query_ids", "queries", "floors", "kth").mapInArrow(run, BLOCK)


def top_k(df: DataFrame, vec_id: str, vector: Column, is_query: Column, k: int = 20, shard_rows: int = 8192, block_rows: int = 2048, sample_values: int = 4_000_000) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products with all other rows; ties go to smaller ids.

    vector: array<long>. Every row is in a KD-tree of about shard_rows rows. Shards are cells of space, cut as the top of one KD-tree
    would be on a sample of about sample_values values, which decides where rows lie and never what is found. Queries of
    neighbouring cells form blocks of about block_rows. Each block first searches the shard whose root box promises most, then
    the next 3, 12, 48 ...; the best k found so far go on to the next round as the bound that a box has to reach, and a shard whose root
    box no query of the block reaches is left out before its tree is read. Scores are exact while squared lengths stay below 2^53. Null
    ids, null vectors and vectors with null elements take no part; vectors of another length meet only their like. A query isn't its
    own candidate, by id; of rows that repeat an id and a vector one asks, and each is found. Other columns of df don't matter,
    whatever their names. Empty input gives no rows.
    """
    d = C.keep(df.select(F.col(vec_id).cast("long").alias("vec_id"), vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("_q")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", F.isnull), F.lit(False)) & (F.size("v") > 0)).withColumn("dim", F.size("v")))
    d = C.keep(_dealt(C.keep(_in_cells(d, _cuts(d, shard_rows, sample_values))), shard_rows, block_rows))
    trees = C.keep(d.select("dim", "shard", "vec_id", "v").groupBy("dim", "shard").applyInArrow(_build, TREE))
    ask = d.filter("_q").select("dim", "block", "vec_id", "v").dropDuplicates(["vec_id", "v"])
    ask = C.keep(ask.groupBy("dim", "block").applyInArrow(_block, BLOCK))
    corner = lambda c: F.substring(F.col(c), F.lit(1), F.col("dim") * 8).alias(c)
    roots = C.keep(trees.select("dim", "shard", corner("low"), corner("high")))
    order = C.keep(_ranked(ask, roots))
    most = order.agg(F.coalesce(F.max("place"), F.lit(-1))).first()[0]
    w = Window.partitionBy("dim", "block", "nth").orderBy(F.desc("score"), "vec_id")
    found, done, step = None, 0, 1
    while found is None or done <= most:
        turn = order.filter((F.col("place") >= done) & (F.col("place") < done + step))
        now = _reaching(ask if found is None else _with_floors(ask, found, k), turn, roots)
        got = _search(now.join(trees, ["dim", "shard"]), k)
        got = got if found is None else found.drop("rank").unionByName(got)
        found = C.keep(got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
        done, step = done + step, 3 if step == 1 else 4 * step
    return found.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 20, against all rows; components become floor(64 * x)."""
    e = F.col("embedding").cast("array<double>")
    whole = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.when(F.coalesce(whole, F.lit(True)), None).otherwise(F.transform(e, lambda x: F.floor(x * 64)))
    return top_k(C.table(spark, sf_dir, "embeddings"), "vec_id", v, F.col("vec_id") % 20 == 0)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""
