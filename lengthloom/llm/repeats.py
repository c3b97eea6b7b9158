"""Suffix-array de-duplication: bytes of later copies go, where an earlier document has the same string of some length."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of text in a block, and of all text for each part that strings are dealt to.
BLOCK_BYTES, PART_BYTES = 4 << 20, 8 << 20
#: Bytes of text in a bucket of the blocks' table; bytes of strings from which a part is decided in slices, and parts a slice after that.
BUCKET_BYTES, LARGE, SPREAD = 32 << 20, 16 << 20, 16
_M = np.uint64(0x9E3779B97F4A7C15)
ROW = "block long, part long, kind int, n long, a binary, b binary"
TEXTS, KEYS, SHARED, STRINGS, PLACES, CUTS = range(6)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings, put together from strings of 1, 2, 4 ... bytes."""
    out, done, size, power, part = None, 0, 1, _M, data.astype(np.uint64) + np.uint64(1)
    powers = {0: np.uint64(1)}
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                if out is None:
                    out = part[: len(part)].copy()
                else:  # the longer part first, what is there already after it
                    n = len(data) - done - size + 1
                    out = part[:n] * powers[done] + out[size : size + n]
                done += size
                powers[done] = powers[done - size] * power
            if done == k:
                return _stir(out)
            part = part[: len(part) - size] * power + part[size:]
            power, size = power * power, 2 * size


def window_keys(data: np.ndarray, length: int) -> np.ndarray:
    """A key for each ``length``-byte string of data: the least hash of the shorter strings inside it.

    Equal strings have equal keys, and neighbours mostly share theirs, so runs of equal keys are few.
    """
    k = length // 2
    v, width, size = _rolling(data, k), length - k + 1, 1
    while 2 * size <= width:
        v = np.minimum(v[: len(v) - size], v[size:])
        size *= 2
    return v if size == width else np.minimum(v[: len(v) - (width - size)], v[width - size :])


def runs(data: np.ndarray, sizes: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one key inside one text: key, text number, begin in data, and number of strings."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    key = _stir(window_keys(data, length) * _M) >> np.uint64(64 - bits)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(doc[: len(key)] == doc[length - 1 :])
    if not len(at):
        return none.astype(np.uint64), none, none, none
    key, doc = key[at], doc[at]
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
    return key[new], doc[new], at[new], np.diff(np.append(new, len(at)))


def _planes(x: np.ndarray) -> bytes:
    """Integers byte by byte: all lowest bytes, all second bytes and so on, which compress well."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def packed(x: np.ndarray) -> bytes:
    """Keys in rising order, as differences."""
    return _squeeze(_planes(np.diff(x.astype(np.int64), prepend=0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(_expand(data))).astype(np.uint64)


def suffix_order(data: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin ``at``, in the order of their first ``length`` bytes, equal ones by doc; and each one's lcp.

    lcp is the number of bytes that a suffix shares with the one before it, up to ``length``. Places whose order is still open
    are sorted by a few more bytes a round; groups that are seen to be equal up to ``length`` need no further round.
    """
    from numpy.lib.stride_tricks import sliding_window_view

    wide = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    words, whole = sliding_window_view(wide, 8), sliding_window_view(wide, length)
    order, lcp = np.arange(len(at)), np.zeros(len(at), np.int64)
    open_, group, done = order.copy(), np.zeros(len(at), np.uint64), 0
    while done < length and len(open_):
        take = min(length - done, (64 - int(group[-1]).bit_length()) // 8)
        key = words[at[order[open_]] + done].copy().view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - 8 * take)
        key |= (group << np.uint64(8 * take)) if take < 8 else np.uint64(0)
        by = np.argsort(key)
        order[open_], key = order[open_][by], key[by]
        same = key[1:] == key[:-1]
        apart = np.flatnonzero(~same & (group[1:] == group[:-1]))
        differ = key[apart + 1] ^ key[apart]
        lcp[open_[apart + 1]] = done + take - sum((differ >> np.uint64(8 * j) > 0).astype(np.int64) for j in range(take))
        done += take
        lcp[open_[1:][same]] = done
        tied = np.append(False, same) | np.append(same, False)
        group = np.cumsum(np.append(True, ~same))[tied]
        open_ = open_[tied]
        if done < length and len(open_):
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            size = np.diff(np.append(first, len(group)))
            first, equal = np.repeat(first, size), np.empty(len(open_), bool)
            for i in range(0, len(open_), 200_000):
                j = slice(i, i + 200_000)
                equal[j] = (whole[at[order[open_[j]]]] == whole[at[order[open_[first[j]]]]]).all(axis=1)
            begin = np.cumsum(size) - size
            settled = np.repeat(np.logical_and.reduceat(equal, begin), size)
            lcp[open_[1:][settled[1:] & (group[1:] == group[:-1])]] = length
            open_, group = open_[~settled], group[~settled]
        group = np.cumsum(np.append(False, group[1:] != group[:-1])).astype(np.uint64) if len(group) else group
    tied = lcp >= length
    if len(at) > 1:
        tied[:-1] |= tied[1:].copy()
    tied = np.flatnonzero(tied)
    if len(tied):
        by = np.lexsort((doc[order[tied]], np.cumsum(lcp[tied] < length)))
        order[tied] = order[tied][by]
    return order, lcp


def smaller_before(doc: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For each place, the bytes shared with the nearest place before it that has a smaller doc; less than ``least`` counts as 0.

    All places jump at once: where the place they look at is no smaller, so is all between it and its own smaller place.
    """
    at, shared = np.arange(len(doc)) - 1, lcp.copy()
    shared[:1] = 0
    live = np.flatnonzero(shared >= least)
    while len(live := live[doc[at[live]] >= doc[live]]):
        shared[live], at[live] = np.minimum(shared[live], shared[at[live]]), at[at[live]]
        live = live[shared[live] >= least]
    return np.where(shared >= least, shared, 0)


def previous_factors(data: np.ndarray, sizes: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest previous factors of a part's strings, one array after the other, and the size of each string's array.

    The factor of a begin is the longest string from there that also begins in a string of a smaller doc: the longer of
    those with the previous and the next smaller doc in suffix order, up to ``length``; less than that counts as 0. Only
    begins with ``length`` bytes after them count.
    """
    begin, count = np.cumsum(sizes) - sizes, np.maximum(sizes - length + 1, 0)
    at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    own = np.repeat(doc, count)
    order, lcp = suffix_order(data, at, own, length)
    ranked = own[order]
    before = smaller_before(ranked, lcp, length)
    after = smaller_before(ranked[::-1], np.append(0, lcp[:0:-1]), length)[::-1] if len(at) else before
    factor = np.empty(len(at), np.int64)
    factor[order] = np.maximum(before, after)
    return factor, count


def _ints(*columns) -> bytes:
    return _planes(np.concatenate([np.asarray(c, np.int64) for c in columns]))


def _from_ints(data: bytes, n: int) -> np.ndarray:
    return _from_planes(data).reshape(n, -1).T


def _rows(rows: list[tuple]) -> pa.Table:
    """Rows of ROW from (block, part, kind, n, a, b); n is the number of bytes in a before compression, where it matters."""
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({x.split()[0]: pa.array(c, k) for x, c, k in zip(ROW.split(", "), zip(*rows, strict=True) if rows else [()] * 6, types, strict=True)})


def _squeeze(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=5).compress(x)


def _expand(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(x) if x else b""


def _blocks(df: DataFrame) -> DataFrame:
    """Texts in blocks: a has them one after the other, b has for each its id, its bytes, and whether the id is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, texts, held
            b = _ints([i or 0 for i in ids], [len(t) for t in texts], [i is not None for i in ids])
            out = _rows([(number, 0, TEXTS, held, _squeeze(b"".join(texts)), b)]).to_batches()[0]
            number, ids, texts, held = number + 1, [], [], 0
            return out

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(i.as_py())
                texts.append((t.as_py() or "").encode())
                held += len(texts[-1])
                if held >= BLOCK_BYTES or len(texts) >= 50_000:
                    yield flush()
        if texts:
            yield flush()

    return df.mapInArrow(run, ROW)


def _load(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, sizes, known = _from_ints(b, 3).T
    return np.frombuffer(_expand(a), np.uint8), ids, sizes, known.astype(bool)


def _known_runs(a: bytes, b: bytes, length: int, bits: int):
    data, ids, sizes, known = _load(a, b)
    key, doc, begin, count = runs(data, sizes, length, bits)
    ok = known[doc]
    return data, ids, sizes, key[ok], doc[ok], begin[ok], count[ok]


def _keys(blocks: DataFrame, length: int, bits: int, parts: int) -> DataFrame:
    """For each block and part: the block's keys, and a bit for each that two of its documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, a, b in zip(batch["block"].to_pylist(), batch["a"], batch["b"], strict=True):
                _, ids, _, key, doc, _, _ = _known_runs(a.as_py(), b.as_py(), length, bits)
                who = np.unique(ids, return_inverse=True)[1][doc]
                order = np.lexsort((who, key))
                key, who = key[order], who[order]
                new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                many = np.zeros(len(new), bool)
                if len(new):
                    last = np.append(new[1:], len(key)) - 1
                    many = who[new] != who[last]
                key = key[new]
                part = (key % np.uint64(parts)).astype(np.int64)
                by = np.argsort(part, kind="stable")
                rows = []
                for x in np.split(by, np.flatnonzero(np.diff(part[by])) + 1) if len(by) else []:
                    rows.append((block, int(part[x[0]]), KEYS, 0, packed(key[x]), np.packbits(many[x]).tobytes()))
                if rows:
                    yield _rows(rows).combine_chunks().to_batches()[0]

    return blocks.mapInArrow(run, ROW)


def _shared(t: pa.Table) -> pa.Table:
    """Of a part's keys from all blocks: for each block, those that another block or two of its documents have."""
    blobs = [unpacked(x) for x in t["a"].to_pylist()]
    many = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(k)] for x, k in zip(t["b"].to_pylist(), blobs, strict=True)]
    key, many = np.concatenate(blobs), np.concatenate(many).astype(bool)
    order = np.argsort(key)
    k = key[order]
    new = np.append(True, k[1:] != k[:-1])
    begin = np.flatnonzero(new)
    good = (np.diff(np.append(begin, len(k))) > 1) | np.logical_or.reduceat(many[order], begin)
    ok = np.empty(len(k), bool)
    ok[order] = good[np.cumsum(new) - 1]
    rows, at = [], 0
    for block, x in zip(t["block"].to_pylist(), blobs, strict=True):
        some = x[ok[at : at + len(x)]]
        at += len(x)
        if len(some):
            rows.append((block, 0, SHARED, 0, packed(some), b""))
    return _rows(rows)


def _strings(length: int, bits: int, parts: int):
    def run(text: pa.Table, keys: pa.Table) -> pa.Table:
        """A block and its shared keys: the strings of shared runs, once for each content, by part; and all their places.

        A content goes on with the smallest id that has it in the block; places of larger ids are copies of it already.
        """
        if not keys.num_rows:
            return _rows([])
        data, ids, sizes, key, doc, begin, count = _known_runs(text["a"][0].as_py(), text["b"][0].as_py(), length, bits)
        shared = np.sort(np.concatenate([unpacked(x) for x in keys["a"].to_pylist()]))
        hit = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, key), len(shared) - 1)] == key)
        key, doc, begin, size = key[hit], ids[doc[hit]], begin[hit], count[hit] + length - 1
        whole, entries = data.tobytes(), {}
        entry = np.fromiter((entries.setdefault(whole[b : b + n], len(entries)) for b, n in zip(begin.tolist(), size.tolist(), strict=True)), np.int64, len(begin))
        least = np.full(len(entries), np.iinfo(np.int64).max)
        np.minimum.at(least, entry, doc)
        block = text["block"][0].as_py()
        first = np.zeros(len(entries), np.int64)
        first[entry[::-1]] = np.arange(len(entry))[::-1]
        part, content = (key[first] % np.uint64(parts)).astype(np.int64), list(entries)
        rows = [(block, 0, PLACES, 0, _squeeze(_ints(entry, begin, size, doc > least[entry])), b"")]
        by = np.argsort(part, kind="stable")
        for x in np.split(by, np.flatnonzero(np.diff(part[by])) + 1):
            rows.append((block, int(part[x[0]]), *_some_strings([content[j] for j in x.tolist()], x, least[x], np.zeros(len(x), np.int64))))
        return _rows(rows)

    return run


def _some_strings(content: list[bytes], entry: np.ndarray, doc: np.ndarray, offset: np.ndarray) -> tuple:
    """kind, n, a and b of a row of strings: each has its entry, its doc, its size, and where in the entry it begins."""
    data = b"".join(content)
    return STRINGS, len(data), _squeeze(data), _squeeze(_ints(entry, doc, [len(c) for c in content], offset))


def _decide(length: int, pass_on: bool = False):
    def run(t: pa.Table) -> pa.Table:
        """All strings of a part: what of each has an earlier factor, as ranges inside its entry, by block.

        With ``pass_on``, strings of ``length`` bytes that have none go on to other parts by their hash, to be held against those
        of the other slices.
        """
        data = np.frombuffer(b"".join(_expand(a) for a in t["a"].to_pylist()), np.uint8)
        infos = [_from_ints(_expand(b), 4) for b in t["b"].to_pylist()]
        of, info = np.repeat(np.arange(len(infos)), [len(x) for x in infos]), np.concatenate(infos)
        entry, doc, sizes, offset = info.T
        factor, count = previous_factors(data, sizes, doc, length)
        cut = factor >= length
        string = np.repeat(np.arange(len(sizes)), count)
        place = np.arange(len(cut)) - np.repeat(np.cumsum(count) - count, count)
        new = np.append(True, string[1:] != string[:-1])
        # runs of begins that go, inside a string
        lo = np.flatnonzero(cut & (new | ~np.append(False, cut[:-1])))
        hi = np.flatnonzero(cut & (np.append(new[1:], True) | ~np.append(cut[1:], False)))
        block, rows = t["block"].to_pylist(), []
        who = string[lo]
        x, y = offset[who] + place[lo], offset[who] + place[hi] + length
        by = np.searchsorted(of[who], np.arange(len(block) + 1))
        for n, (i, j) in enumerate(zip(by[:-1], by[1:], strict=True)):
            if i < j:
                rows.append((block[n], 0, CUTS, 0, _ints(entry[who[i:j]], x[i:j], y[i:j]), b""))
        if pass_on:
            left = np.flatnonzero(~cut)
            begin = (np.cumsum(sizes) - sizes)[string[left]] + place[left]
            slices, part = t["slices"][0].as_py(), t["part"][0].as_py()
            to = (_rolling(data, length)[begin] % np.uint64(slices * SPREAD)).astype(np.int64)
            text = data.tobytes()
            by = np.lexsort((to, of[string[left]]))
            edge = np.flatnonzero(np.diff(of[string[left]][by]) | np.diff(to[by])) + 1
            for z in np.split(by, edge) if len(by) else []:
                s = string[left[z]]
                rows.append((block[of[s[0]]], part << 24 | int(to[z[0]]), *_some_strings([text[b : b + length] for b in begin[z].tolist()], entry[s], doc[s], offset[s] + place[left[z]])))
        return _rows(rows)

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _finish(text: pa.Table, cuts: pa.Table) -> pa.Table:
    """A block with the places of its strings, and what goes of each: the result of its documents."""
    data, ids, sizes, known = _load(text["a"][0].as_py(), text["b"][0].as_py())
    change = np.zeros(len(data) + 1, np.int64)
    if places := text["places"][0].as_py():
        entry, begin, size, copy = _from_ints(_expand(places), 4).T
        cut = np.concatenate([_from_ints(x, 3) for x in cuts["a"].to_pylist()] or [np.zeros((0, 3), np.int64)])
        whole = np.flatnonzero(copy)
        np.add.at(change, begin[whole], 1)
        np.add.at(change, begin[whole] + size[whole], -1)
        rest = np.flatnonzero(copy == 0)
        rest = rest[np.argsort(entry[rest], kind="stable")]
        lo, hi = np.searchsorted(entry[rest], cut[:, 0]), np.searchsorted(entry[rest], cut[:, 0], "right")
        n = hi - lo
        at = begin[rest[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
        np.add.at(change, at + np.repeat(cut[:, 1], n), 1)
        np.add.at(change, at + np.repeat(cut[:, 2], n), -1)
    gone = np.cumsum(change[:-1]) > 0
    rows, at = [], 0
    for d, n, ok in zip(ids.tolist(), sizes.tolist(), known.tolist(), strict=True):
        g, x = gone[at : at + n], data[at : at + n]
        at += n
        kept = x[~g].tobytes() if g.any() else x.tobytes()
        rows.append((d if ok else None, n, int(g.sum()), int(np.count_nonzero(g[1:] & ~g[:-1]) + (n > 0 and bool(g[0]))), sha256(kept).hexdigest(), kept))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.table({x.split()[0]: pa.array(c, k) for x, c, k in zip(RESULT.split(", "), zip(*rows, strict=True), types, strict=True)})


def remove_repeats(df: DataFrame, doc_id: str, text: str, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every whole text.

    A byte goes if a ``length``-byte string over it also begins in a document with a smaller id; matches stay inside a text
    and are judged on the input. Texts are packed in blocks, in a table bucketed by block, so that they are shuffled once. The
    key of a string is the least hash inside it, so equal strings have equal keys, and strings with one key in a row are one
    run. Keys that two documents share are found by part of the key space; only runs with such keys go on to their part, each
    content once a block with its smallest id. The strings of a part are brought in suffix order; there the previous and next
    places of smaller documents give the longest previous factors, and begins whose factor reaches ``length`` go.

    A part with over LARGE bytes of strings is decided in slices of its blocks first; strings that no smaller document of their
    slice has meet those of the other slices, dealt by their hash. So a key or passage in very many blocks is bounded by the
    number of slices. A text is held whole by one task.

    Null text is empty. A null id is neither earlier nor later than another: its row comes back whole. Rows that repeat an id
    are one document in this sense, and keep what they share. An empty table gives no rows. Other columns of df don't matter,
    whatever their names.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, -(-total // PART_BYTES))
    tasks = int(min(parts, 20_000))
    buckets = int(min(max(8, -(-total // BUCKET_BYTES)), 100_000))
    bits = 8 * max(4, -(-(max(1, total // 13).bit_length() + 8) // 8))
    blocks = C.keep_by(_blocks(docs), "block", buckets)
    shared = _keys(blocks, length, bits, parts).repartition(tasks, "part").groupBy("part").applyInArrow(_shared, ROW)
    strings = C.keep_by(blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_strings(length, bits, parts), ROW), "block", buckets, dealt=True)
    ready = strings.filter(F.col("kind") == STRINGS)
    large = C.keep(ready.groupBy("part").agg(F.sum("n").alias("bytes")).filter(F.col("bytes") > LARGE).select("part", F.ceil(F.col("bytes") / LARGE).alias("slices")))
    some = not large.isEmpty()
    decided = (ready.join(large, "part", "left_anti") if some else ready).select(*(x.split()[0] for x in ROW.split(", "))).repartition(tasks, "part").groupBy("part").applyInArrow(_decide(length), ROW)
    if some:
        sliced = ready.join(large, "part").withColumn("slice", F.pmod(F.xxhash64("block"), "slices"))
        first = C.keep(sliced.repartition(tasks, "part", "slice").groupBy("part", "slice").applyInArrow(_decide(length, True), ROW))
        last = first.filter(F.col("kind") == STRINGS).repartition(tasks, "part").groupBy("part").applyInArrow(_decide(length), ROW)
        decided = decided.unionByName(first.filter(F.col("kind") == CUTS)).unionByName(last)
    ends = blocks.join(strings.filter(F.col("kind") == PLACES).select("block", F.col("a").alias("places")), "block", "left")
    return ends.groupBy("block").cogroup(decided.groupBy("block")).applyInArrow(_finish, RESULT).withColumnRenamed("doc_id", doc_id)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(C.table(spark, sf_dir, "documents"), "doc_id", "text").drop("kept")
