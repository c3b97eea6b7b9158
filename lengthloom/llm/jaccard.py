"""N-gram Jaccard join: MinHash bands propose pairs, Bayesian pruning drops hopeless ones, exact Jaccard decides."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

#: 40 bands of 4 values: a pair at 0.8 meets in a band but for 7e-10; 160 values for the pruning.
BANDS, ROWS = 40, 4
HASHES = BANDS * ROWS
#: Values that are compared between two looks at the posterior.
STEP = 16
#: Rows of a block; groups beyond it are compared block by block. Classes from which a component is verified by its buckets.
BLOCK, LARGE = 256, 2048
_M = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_A, _B = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_WEIGHTS = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted 64-bit hashes of a text's distinct n-word shingles; a text with fewer words is one shingle, one without none."""

    def __init__(self, n: int):
        self.n, self.words = n, {}

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        known, hash_of = self.words, xxhash.xxh3_64_intdigest
        if len(known) > 200_000:
            known.clear()
        out = []
        for w in text.encode().split():
            h = known.get(w)
            if h is None:
                h = known[w] = hash_of(w)
            out.append(h)
        a = np.array(out, np.uint64)
        k = min(self.n, len(a))
        if not k:
            return a
        h = a[: len(a) - k + 1].copy()
        for i in range(1, k):
            h = _stir(h) * _M + a[i : len(a) - k + 1 + i]
        return np.unique(_stir(h + np.uint64(k)))


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set: equal sets are one class."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def min_hashes(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 2048):
        out = np.minimum(out, _stir(s[at : at + 2048, None] * _A + _B).astype(np.uint32).min(axis=0))
    return out


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For 0, STEP, 2 STEP ... compared values: the fewest matches with which a pair may still reach the threshold.

    With a uniform prior, the posterior probability that similarity is at least t after m of n matches is that of at most m
    successes in n + 1 trials of probability t. Values are compared by their lowest byte, so t is raised by chance matches.
    """
    t = threshold + (1 - threshold) / 256
    out = [0]
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) of rows of sig are not dropped by the posterior, value by value."""
    live, m = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k in range(1, len(least)):
        c = slice((k - 1) * STEP, k * STEP)
        m = m + (sig[a[live], c] == sig[b[live], c]).sum(axis=1, dtype=np.int32)
        on = m >= least[k]
        live, m = live[on], m[on]
    return live


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component."""
    out = np.arange(n)
    while True:
        low = np.minimum(out[a], out[b])
        new = out.copy()
        for x in (a, b, out[a], out[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == out).all():
            return out
        out = new


def forest(n: int, a: np.ndarray, b: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what pairs of rows connect: a row goes to the first of its component on its own side, and that of side 1 to that of side 0.

    So a row of a large group, which meets every other block, has the same edge in each, and only the firsts of blocks differ.
    """
    on = np.unique(np.concatenate([a, b]))
    group = labels(n, a, b)[on] * 2 + side[on]
    _, at, first = np.unique(group, return_index=True, return_inverse=True)  # on is sorted, so the first index is the smallest row
    near = on[at]
    both = np.flatnonzero(group[at][1:] // 2 == group[at][:-1] // 2)
    rest = on != near[first]
    return np.concatenate([on[rest], near[both + 1]]), np.concatenate([near[first][rest], near[both]])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from a partition sorted by integer keys, with the begin of each group."""
    held: list[pa.RecordBatch] = []

    def cut(final: bool):
        nonlocal held
        t = pa.Table.from_batches(held).combine_chunks()
        k = np.column_stack([t[c].to_numpy() for c in keys])
        new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]).any(axis=1)))
        if not final:
            held = t.slice(int(new[-1])).to_batches()
            t, new = t.slice(0, int(new[-1])), new[:-1]
        return t, new

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            t, new = cut(False)
            if len(new):
                yield t, new
    if held:
        yield cut(True)


def _pairs(begin: np.ndarray, end: np.ndarray, side: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs inside groups; where ``two``, only those between the group's two blocks. In portions."""
    sizes = end - begin
    for s in np.unique(sizes[~two & (sizes > 1) & (sizes <= 64)]):
        at, (i, j) = begin[~two & (sizes == s)], np.triu_indices(int(s), 1)
        for k in range(0, len(at), max(1, 200_000 // len(i))):
            some = at[k : k + max(1, 200_000 // len(i)), None]
            yield (some + i).ravel(), (some + j).ravel()
    for g in np.flatnonzero(two | (sizes > 64)):
        rows = np.arange(begin[g], end[g])
        left, right = (rows[side[rows] == 0], rows[side[rows] == 1]) if two[g] else (rows, rows)
        for k in range(0, len(left), 256):
            a, b = np.repeat(left[k : k + 256], len(right)), np.tile(right, len(left[k : k + 256]))
            ok = slice(None) if two[g] else a < b
            yield a[ok], b[ok]


def _with_blocks(df: DataFrame, size: str) -> DataFrame:
    """Rows of a group, once in each pair of its blocks (one block, unless the group is large): lo, hi and the row's side."""
    n = F.ceil(F.col(size) / F.lit(BLOCK)).cast("int")
    d = df.withColumn("_n", n).withColumn("_at", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("_n")).cast("int"))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    d = d.withColumns({"lo": F.least("_at", "_o"), "hi": F.greatest("_at", "_o"), "side": (F.col("_at") > F.col("_o")).cast("int")}).drop("_n", "_at", "_o")
    return d


def _in_blocks(df: DataFrame, key: str, size: str) -> DataFrame:
    """The same, with the rows of a pair of blocks together."""
    return _with_blocks(df, size).repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi", "node")  # so forests of different buckets root in the same nodes


def candidate_edges(members: DataFrame, least: np.ndarray) -> DataFrame:
    """(key, node, sig, size) rows of band buckets -> edges (a, b) that connect all pairs which survive the pruning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.tidy("jaccard")
        for t, begin in whole_groups(batches, ["key", "lo", "hi"]):
            node, side = t["node"].to_numpy(), t["side"].to_numpy()
            two = t["lo"].to_numpy()[begin] != t["hi"].to_numpy()[begin]
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, y in _pairs(begin, np.append(begin[1:], len(node)), side, two):
                ok = surviving(sig, x, y, least)
                if len(ok):
                    i, j = forest(len(node), x[ok], y[ok], side)  # it says as much as all pairs
                    a.append(node[i])
                    b.append(node[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return _in_blocks(members, "key", "size").select("key", "lo", "hi", "side", "node", "sig").mapInArrow(run, "a long, b long").distinct()


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right], by products of incidence matrices."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, word, count = np.unique(np.concatenate(sets) if len(owner) else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared = count[word] > 1
    owner, word = owner[shared], word[shared]
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    by = np.argsort(word, kind="stable")
    owner, (_, word) = owner[by], np.unique(word[by], return_inverse=True)
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(word[-1]) + 1 if len(word) else 0, 4096):
        i = slice(*np.searchsorted(word, [at, at + 4096]))
        x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        o, c = owner[i], word[i] - at
        x[place_l[o[place_l[o] >= 0]], c[place_l[o] >= 0]] = 1
        y[place_r[o[place_r[o] >= 0]], c[place_r[o] >= 0]] = 1
        out += x @ y.T
    return out


def meet_first(left: np.ndarray, right: np.ndarray, band: int) -> np.ndarray:
    """For each pair of signatures, whether this band is the first on which they agree."""
    out = np.empty((len(left), len(right)), bool)
    for i, row in enumerate(left):
        agree = (row[None, : (band + 1) * ROWS] == right[:, : (band + 1) * ROWS]).reshape(len(right), band + 1, ROWS).all(axis=2)
        out[i] = agree[:, band] & ~agree[:, :band].any(axis=1)
    return out


def meeting(blocks: DataFrame, least: np.ndarray) -> DataFrame:
    """Of blocks of band buckets, (key, lo, hi, side, band, node) of the rows in a pair that survives and meets there first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.tidy("jaccard")
        for t, begin in whole_groups(batches, ["key", "lo", "hi"]):
            side, band = t["side"].to_numpy(), t["band"].to_numpy()
            two = t["lo"].to_numpy()[begin] != t["hi"].to_numpy()[begin]
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)
            on = np.zeros(len(side), bool)
            for x, y in _pairs(begin, np.append(begin[1:], len(side)), side, two):
                ok = surviving(sig, x, y, least)
                x, y = x[ok], y[ok]
                agree = (sig[x] == sig[y]).reshape(-1, BANDS, ROWS).all(axis=2)
                first = agree[np.arange(len(x)), band[x]] & (agree.argmax(axis=1) == band[x])
                on[x[first]] = on[y[first]] = True
            yield from t.select(["key", "lo", "hi", "side", "band", "node"]).filter(pa.array(on)).to_batches()

    return blocks.select("key", "lo", "hi", "side", "band", "node", "sig").mapInArrow(run, "key long, lo int, hi int, side int, band int, node long")


def exact_links(blocks: DataFrame, threshold: float) -> DataFrame:
    """(key, lo, hi, side, band, node, copies, sig, shingles) rows of blocks -> rows (node, other, links, class_links).

    Groups are candidate components (band is -1), in which every pair is decided by its exact Jaccard similarity, or buckets of
    a band, in which only pairs are that meet in no earlier band. Counts are given per node and block pair (other is
    null), and a forest of the links as (node, other), so no row is made for each of a group's pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.tidy("jaccard")
        for t, begin in whole_groups(batches, ["key", "lo", "hi"], 2 * BLOCK):
            node, side, copies = t["node"].to_numpy(), t["side"].to_numpy(), t["copies"].to_numpy().astype(np.float64)
            two, end = t["lo"].to_numpy()[begin] != t["hi"].to_numpy()[begin], np.append(begin[1:], len(node))
            sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
            band, sig = t["band"].to_numpy()[begin], t["sig"].to_pylist()
            n_links, n_classes = np.zeros(len(node)), np.zeros(len(node))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for g in range(len(begin)):
                rows = np.arange(begin[g], end[g])
                left, right = (rows[side[rows] == 0], rows[side[rows] == 1]) if two[g] else (rows, rows)
                if not len(left) or not len(right):
                    continue
                mine = [sets[r] for r in rows]
                both = intersections(mine, left - begin[g], right - begin[g]).astype(np.float64)
                size = np.array([len(s) for s in mine], np.float64)
                total = size[left - begin[g]][:, None] + size[right - begin[g]][None, :]
                link = both * (1 + threshold) >= threshold * total - 1e-9
                if band[g] >= 0:
                    x, y = (np.frombuffer(b"".join(sig[r] for r in side_), np.uint8).reshape(-1, HASHES) for side_ in (left, right))
                    link &= meet_first(x, y, int(band[g]))
                if not two[g]:
                    np.fill_diagonal(link, False)
                n_links[left] += link @ copies[right]
                n_classes[left] += link.sum(axis=1)
                if two[g]:
                    n_links[right] += copies[left] @ link
                    n_classes[right] += link.sum(axis=0)
                x, y = np.nonzero(link)
                i, j = forest(len(rows), left[x] - begin[g], right[y] - begin[g], side[rows])
                a.append(node[rows[i]])
                b.append(node[rows[j]])
            a, b, some = np.concatenate(a), np.concatenate(b), np.flatnonzero(n_classes)
            zero = np.zeros(len(a), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a, node[some]])), pa.array([*b.tolist(), *[None] * len(some)], pa.int64()), pa.array(np.concatenate([zero, n_links[some].astype(np.int64)])), pa.array(np.concatenate([zero, n_classes[some].astype(np.int64)]))],
                names=["node", "other", "links", "class_links"],
            )

    blocks = blocks.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    return blocks.select("key", "lo", "hi", "side", "band", "node", "copies", "sig", "shingles").mapInArrow(run, "node long, other long, links long, class_links long")


def _sketches(df: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.tidy("jaccard")
        shingle = Shingler(n)
        for batch in C.slices(batches, 1):
            node, sig, bands = [], [], []
            for t in batch.column(1):
                s = shingle(t.as_py() or "")
                m = min_hashes(s)
                node.append(set_id(s))
                sig.append(m.astype(np.uint8).tobytes())
                bands.append(_stir((m.reshape(BANDS, ROWS) * _WEIGHTS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _M).view(np.int64) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "node", "sig", "bands"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, node long, sig binary, bands array<long>")


def _sets(df: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.tidy("jaccard")
        shingle = Shingler(n)
        for batch in C.slices(batches, 0):
            sets = [shingle(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["found", "shingles"])

    return df.mapInArrow(run, "found long, shingles binary")


def jaccard_join(df: DataFrame, doc_id: str, text: Column, threshold: float = 0.8, words: int = 5, tolerance: float = 1e-8) -> DataFrame:
    """doc_id, class_id, n_links, n_class_links: links are pairs of whole texts with Jaccard >= threshold on word shingles.

    Texts with equal shingle sets (all copies among them) are one class and enter once. Classes that agree on a band of
    MinHash values are candidates; in each bucket pairs are compared a few values at a time and dropped when the posterior
    probability of reaching the threshold falls below ``tolerance``. What survives gives candidate components, and in these
    every pair is decided by exact set sizes; in a component of more than LARGE classes, which may be a long chain, only pairs
    that share a bucket are, each in the first band on which their signatures agree. No row is made for a pair: buckets and
    components give forests and counts, and large ones are compared block by block. class_id is the smallest doc_id that
    links reach from the document; n_links counts other documents (copies included), n_class_links other classes. Classes
    have 64-bit names: among 10^9 different sets two share one with a probability of 3 %.

    Null text is empty; texts without a word are copies of each other and link to nothing else. A null doc_id is kept and
    never names a class unless all ids in it are null. Rows that repeat a doc_id are documents of their own. Other columns
    of df don't matter, whatever their names. An empty table gives no rows.
    """
    docs = df.select(F.col(doc_id).alias("id"), text.alias("text"))
    d = C.keep(_sketches(docs, words))
    k = C.keep(d.groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    band = k.select("node", F.posexplode("bands").alias("band", "key"))
    full = C.keep(band.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))  # a table of its own, so that a hot bucket's join can be split
    members = band.join(full, "key").join(k.select("node", "sig"), "node")
    least = least_matches(threshold, tolerance)
    near = components(candidate_edges(members, least)).withColumnRenamed("root", "key")
    near = C.keep(C.look_up(near, near.groupBy("key").agg(F.count("*").alias("size")), "key", "id").withColumnRenamed("id", "node").join(k.select("node", "rep", "copies"), "node"))
    sets = _sets(docs.join(near.select(F.col("rep").alias("_r")).distinct(), F.col("id").eqNullSafe(F.col("_r")), "left_semi").select("text"), words).dropDuplicates(["found"])
    groups = _with_blocks(near.filter(F.col("size") <= LARGE).select("key", F.lit(-1).alias("band"), "node", "copies", F.lit(None).cast("binary").alias("sig"), "size"), "size").drop("size")
    large = near.filter(F.col("size") > LARGE).select("node", F.col("key").alias("_part"))
    if not large.isEmpty():
        shared = C.keep(band.join(full.select("key"), "key").join(large, "node").join(k.select("node", "sig"), "node").withColumn("key", F.xxhash64("key", "_part")).drop("_part"))
        buckets = C.look_up(shared, shared.groupBy("key").agg(F.count("*").alias("size")), "key", "node").filter("size > 1")
        active = meeting(_in_blocks(buckets, "key", "size"), least).join(k.select("node", "copies", "sig"), "node")
        groups = groups.unionByName(C.keep(active).select(*groups.columns))
    found = C.keep(exact_links(groups.join(sets, F.col("node") == F.col("found")).drop("found"), threshold))
    counts = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"), F.sum("class_links").alias("class_links"))
    root = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    c = k.select("node", "rep", "copies").join(root.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node")).join(counts, "node", "left")
    first = c.groupBy("root").agg(F.min("rep").alias("class_id"))
    c = c.join(first, "root").select("node", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("class_links", F.lit(0)).alias("n_class_links"))
    c = C.keep(c)
    return C.look_up(d.select(F.col("id").alias(doc_id), F.col("node").alias("_node")), c.withColumnRenamed("node", "_node"), "_node", doc_id).select(doc_id, "class_id", F.col("n_links").cast("long"), F.col("n_class_links").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(C.table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
