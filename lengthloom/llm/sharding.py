"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, ranges, overfull ranges subdivided."""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Bits of a key hash that choose an entry of the splitter table.
PREFIX = 12


def _unsigned(h: int) -> int:
    return h & (2**64 - 1)


def _table(values: dict[int, list], item: str) -> Column:
    """A constant array with 2^PREFIX entries: the items whose key hash has that prefix, and how many came before."""
    rows, before = [], 0
    for p in range(2**PREFIX):
        rows.append({"s": before, "b": values.get(p, [])})
        before += len(rows[-1]["b"])
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<s:int,b:array<{item}>>>")


def _by_prefix(items: list, key) -> dict[int, list]:
    out: dict[int, list] = {}
    for x in items:
        out.setdefault(_unsigned(key(x)) >> (64 - PREFIX), []).append(x)
    return out


def splitters(samples: list[tuple[int, int]], ranges: int) -> list[int]:
    """Upper ends (inclusive) of the ranges: quantiles of weighted key hashes, in unsigned order, without repeats."""
    samples = sorted(samples, key=lambda x: _unsigned(x[0]))
    total, cum, ends, j = sum(w for _, w in samples), 0, [], 1
    for h, w in samples:
        cum += w
        if cum * ranges >= j * total:
            ends.append(h)
            j = cum * ranges // total + 1
    return ends[:-1]


def assign(cells: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Shard of each (cell, bytes): neighbouring ranges go together, then overfull shards hand ranges to the emptiest.

    The list is bounded by the number of ranges, not by the data.
    """
    total, cum, out, load = max(1, sum(b for _, b in cells)), 0, {}, [0] * shards
    members: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for c, b in cells:
        s = min(shards - 1, (2 * cum + b) * shards // (2 * total))
        cum, out[c] = cum + b, s
        load[s] += b
        members[s].append((b, c))
    for m in members:
        m.sort()
    for _ in range(4 * len(cells)):
        hi, lo = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[hi] - load[lo]
        if gap * shards * 2000 <= total:
            break
        i = bisect_left(members[hi], (gap // 2 + 1, -1))  # the largest that closes no more than half of the gap
        i = i - 1 if i else 0
        if members[hi][i][0] >= gap or not members[hi][i][0]:
            break
        b, c = members[hi].pop(i)
        members[lo].insert(bisect_left(members[lo], (b, c)), (b, c))
        load[hi], load[lo], out[c] = load[hi] - b, load[lo] + b, lo
    return out


def shard_by_splitters(df: DataFrame, key: Column, identity: Column, size: str, shards: int = 24, per_shard: int = 128, per_range: int = 16) -> DataFrame:
    """Add shard (0 .. shards-1) and slot (gapless from 0 in each shard); shards get near equal sums of ``size``.

    Rows are ordered by the hash of ``key``; a row enters the sample in proportion to its size, and quantiles of the sample
    bound shards * per_shard ranges. Exact sums of the ranges follow. In a range of over twice the mean, every key with more
    than half the mean gets cells of its own, cut by the hash of ``identity``; what is left is cut by key, so equal keys stay
    together unless their group alone is overfull. Cells are dealt to shards by exact bytes.

    The driver sees the sample (about shards * per_shard * per_range numbers) and sums of the cells: both are bounded by
    these parameters, whatever the data. df is read five times: pass a written table if its columns are dear to compute.
    Null keys and identities hash like any value. Rows equal in every respect may trade slots. An empty table gives no rows.
    Other columns pass through; shard and slot are replaced, and names that begin with an underscore are reserved.
    """
    ranges = shards * per_shard
    d = df.withColumns({"_h": F.xxhash64(key), "_i": F.xxhash64(identity, key)})
    n, total = d.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if not n:
        return df.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    total = max(1, total)
    mean = total / ranges
    draws = F.floor(F.col(size) * F.lit(ranges * per_range / total) + C.uniform(F.xxhash64(F.lit("sample"), "_i")))
    sample = d.select("_h", draws.alias("w")).filter("w > 0").groupBy("_h").agg(F.sum("w").alias("w")).collect()
    ends = splitters([tuple(r) for r in sample], ranges)
    entry = F.element_at(_table(_by_prefix(ends, lambda x: x), "bigint"), (F.shiftrightunsigned("_h", 64 - PREFIX) + 1).cast("int"))
    d = d.withColumn("_r", entry["s"] + F.size(F.filter(entry["b"], lambda x: x < F.col("_h"))))

    sums = {r["_r"]: r["b"] for r in d.groupBy("_r").agg(F.sum(size).alias("b")).collect()}
    over = [r for r, b in sums.items() if b > 2 * mean]
    heavy = d.filter(F.col("_r").isin(over)).groupBy("_r", "_h").agg(F.sum(size).alias("b")).filter(F.col("b") > mean / 2).collect() if over else []
    light = {r: sums[r] - sum(x["b"] for x in heavy if x["_r"] == r) for r in over}
    own = _by_prefix([{"k": x["_h"], "c": max(1, -int(-x["b"] // mean))} for x in heavy], lambda x: x["k"])
    hot = F.element_at(_table(own, "struct<k:bigint,c:int>"), (F.shiftrightunsigned("_h", 64 - PREFIX) + 1).cast("int"))
    at = F.get(F.filter(hot["b"], lambda x: x["k"] == F.col("_h")), F.lit(0))
    cuts = F.coalesce(F.element_at(F.from_json(F.lit(json.dumps({str(r): max(1, -int(-b // mean)) for r, b in light.items()})), "map<string,int>"), F.col("_r").cast("string")), F.lit(1)) if over else F.lit(1)
    # A cell: a range, in it a key of its own or the rest, and a slice.
    d = d.withColumn("_own", at).withColumn("_cell", F.concat_ws("/", F.lpad(F.col("_r").cast("string"), 8, "0"), F.coalesce(F.col("_own.k"), F.lit(0)).cast("string"), F.lpad(F.when(F.col("_own").isNotNull(), F.pmod("_i", F.col("_own.c"))).otherwise(F.pmod(F.xxhash64("_h"), cuts)).cast("string"), 8, "0"))).drop("_own")

    spark, cells = df.sparkSession, sorted(d.groupBy("_cell").agg(F.sum(size).alias("b"), F.count("*").alias("n")).collect())
    shard_of, unit = assign([(c["_cell"], c["b"]) for c in cells], shards), -(-n // ranges)
    plan = spark.createDataFrame([(c["_cell"], shard_of[c["_cell"]], -(-c["n"] // unit)) for c in cells], "_cell string, shard int, _salts long")
    d = d.join(F.broadcast(plan), "_cell").withColumn("_salt", F.pmod(F.xxhash64("_i"), F.col("_salts"))).drop("_salts")
    counts, start, place = sorted(d.groupBy("shard", "_cell", "_salt").count().collect()), {}, []
    for s, c, x, k in counts:
        place.append((c, x, start.get(s, 0)))
        start[s] = start.get(s, 0) + k
    offsets = spark.createDataFrame(place, "_cell string, _salt long, _at long")
    w = Window.partitionBy("_cell", "_salt").orderBy("_i", size)
    return d.join(F.broadcast(offsets), ["_cell", "_salt"]).withColumn("slot", F.col("_at") + F.row_number().over(w) - 1).drop("_h", "_i", "_r", "_cell", "_salt", "_at")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes; copies of a text lie in one shard unless they alone overfill a range."""
    d = C.table(spark, sf_dir, "documents").select("doc_id", (C.n_bytes(F.col("text")) + 8).alias("size"), C.text_crc32(F.col("text")).alias("text_crc32"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_k"))
    out = shard_by_splitters(C.keep(d), F.col("_k"), F.struct("doc_id"), "size")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
