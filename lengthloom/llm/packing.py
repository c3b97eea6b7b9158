"""Packing: shortest-pack-first over the length histogram, patterns joined back to documents by rank."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

PIECE = "start long, length long, doc_tokens long, token_bytes binary"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary: printable Latin-1 stays, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


_encoders: dict = C.caches.setdefault("packing", {})


def encoder(path: str):
    """A byte-level BPE file of the tokenizers library, run by tiktoken: the same ids at about five times the speed."""
    import tiktoken

    if path in _encoders:
        return _encoders[path]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    back = byte_alphabet()
    ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed by the byte-level format
    _encoders[path] = tiktoken.Encoding("own", pat_str=words, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def tokenize(df: DataFrame, text: str, tokenizer: str, keep: list[str], end_id: int = 1, longest: int = 2048) -> DataFrame:
    """Pieces of whole texts: the ``keep`` columns, start, length, doc_tokens, token_bytes (little-endian unsigned 32-bit ids).

    Every text ends with end_id (a null or empty text is that id alone) and is cut every ``longest`` ids. A ``keep`` column
    that is named like a result is left out. Repeated rows are documents of their own. An empty table gives no rows.
    """
    keep = [c for c in dict.fromkeys(keep) if c not in ("start", "length", "doc_tokens", "token_bytes")]
    fields = [df.schema[c] for c in keep]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        C.tidy("packing")
        enc = encoder(tokenizer)
        for batch in batches:
            rows, start, length, tokens, data, held = [], [], [], [], [], 0
            texts = batch.column(batch.schema.get_field_index(text))
            for i in range(batch.num_rows):
                ids = np.append(enc.encode_to_numpy(texts[i].as_py() or "", allowed_special="all", disallowed_special=()), end_id).astype("<u4")
                for at in range(0, len(ids), longest):
                    part = ids[at : at + longest]
                    rows.append(i)
                    start.append(at)
                    length.append(len(part))
                    tokens.append(len(ids))
                    data.append(part.tobytes())
                    held += 4 * len(part)
                if held > 8 << 20 or i == batch.num_rows - 1:
                    kept = [batch.column(batch.schema.get_field_index(c)).take(pa.array(rows, pa.int64())) for c in keep]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(tokens, pa.int64()), pa.array(data, pa.binary())], names=[*keep, "start", "length", "doc_tokens", "token_bytes"])
                    rows, start, length, tokens, data, held = [], [], [], [], [], 0

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), PIECE])
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(pieces, schema)


def shortest_pack_first(histogram: dict[int, int], room: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns (count, [(length, how many), ...]) for the lengths of a histogram.

    Lengths come longest first; each goes into the pack that is shortest so far if it fits there, else it opens a pack.
    Packs alike are one entry with a count, so the work depends on the number of lengths, not of pieces.
    """
    packs: list[tuple[int, int, int, tuple]] = []  # used, order, count, content
    done, order = [], 0

    def put(used: int, count: int, content: tuple) -> None:
        nonlocal order
        order += 1
        heapq.heappush(packs, (used, order, count, content))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if packs and packs[0][0] + length <= room:
                used, _, count, content = heapq.heappop(packs)
                if count > left:
                    put(used, count - left, content)
                n = min(count, left)
                content = (*content[:-1], (length, content[-1][1] + 1)) if content[-1][0] == length else (*content, (length, 1))
                put(used + length, n, content)
                left -= n
            else:  # no pack has room: the next ones fill a new pack before another is opened
                each = room // length
                if left >= each:
                    done.append((left // each, ((length, each),))) if room - each * length == 0 else put(each * length, left // each, ((length, each),))
                if left % each:
                    put(left % each * length, 1, ((length, left % each),))
                left = 0
    return [(n, list(c)) for n, c in done + [(p[2], p[3]) for p in sorted(packs)]]


def pack(pieces: DataFrame, identity: list[str], room: int = 2048) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to ``room``; other columns pass through.

    The driver gets the histogram (at most ``room`` rows) and makes patterns of it. Rows of a length are numbered without a
    gap: a frequent length is split by the hash of ``identity``, each split is numbered by itself and starts where the one
    before it ended. A row's number picks its place among the places that the patterns have for that length. pieces is read
    three times: pass a written table. Columns named like the results are
    replaced; all others come back as they are, whatever their names. An empty table gives no rows; rows alike in all of
    ``identity`` may trade places.
    """
    pieces = pieces.drop("sequence_id", "offset")
    own = "_"  # begins no column of the caller's
    while any(c.startswith(own) for c in pieces.columns):
        own += "_"
    i, split, rank, p, n, splits, places, start = (own + x for x in ("i", "split", "rank", "p", "n", "splits", "places", "first"))
    hist = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if not hist:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}  # by length: first rank, first sequence, offset, how many each
    ranks, base = dict.fromkeys(hist, 0), 0
    for count, content in shortest_pack_first(hist, room):
        at = 0
        for length, k in content:
            ranges.setdefault(length, []).append((ranks[length], base, at, k))
            ranks[length] += count * k
            at += length * k
        base += count
    unit = max(1, min(1 << 20, -(-sum(hist.values()) // (2 * room))))  # rows of a split
    spark = pieces.sparkSession
    place = spark.createDataFrame([(k, -(-hist[k] // unit), x) for k, x in ranges.items()], f"length long, {splits} long, {places} array<struct<r:long,s:long,o:long,k:long>>")
    d = pieces.join(F.broadcast(place), "length").withColumn(i, F.xxhash64(*identity)).withColumn(split, F.pmod(i, F.col(splits)))
    first, begun = [], {}
    for length, part, count in sorted(d.groupBy("length", split).count().collect()):
        first.append((length, part, begun.get(length, 0)))
        begun[length] = begun.get(length, 0) + count
    d = d.join(F.broadcast(spark.createDataFrame(first, f"length long, {split} long, {start} long")), ["length", split])
    d = d.withColumn(rank, F.col(start) + F.row_number().over(Window.partitionBy("length", split).orderBy(i, *identity)) - 1)
    d = d.withColumn(p, F.element_at(F.filter(places, lambda x: x["r"] <= F.col(rank)), -1)).withColumn(n, F.col(rank) - F.col(f"{p}.r"))
    d = d.withColumns({"sequence_id": F.col(f"{p}.s") + F.floor(F.col(n) / F.col(f"{p}.k")), "offset": F.col(f"{p}.o") + F.col(n) % F.col(f"{p}.k") * F.col("length")})
    return d.select(*pieces.columns, F.col("sequence_id").cast("long"), F.col("offset").cast("long"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    d = tokenize(C.table(spark, sf_dir, "documents"), "text", tokenizer or default_tokenizer(), ["doc_id"])
    d = C.keep(d.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens"))
    return pack(d, ["doc_id", "start", "ids_crc32"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
