"""What the training-data operators share: words, hashes, and tables in the cluster's shared folder."""

from __future__ import annotations

import contextvars
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lengthloom.session import shared_dir

#: A word: a run of anything but the space and the five ASCII white-space controls.
WORD = r"[^\x20\x09-\x0D]+"

#: Worker caches by the operator that fills them; see tidy().
caches: dict[str, dict] = {}

_scratch: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end of the block, the tables that keep() wrote inside it in this thread: what reads them must be done by then."""
    paths: list[str] = []
    token = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(token)
        delete(spark, *paths)


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete tables in the shared folder."""
    for path in paths:
        name = path.rsplit("/", 1)[-1]
        if name.startswith("lengthloom_"):
            spark.sql(f"drop table if exists {name}")
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _note(path: str) -> None:
    paths = _scratch.get()
    if paths is not None:
        paths.append(path)


def keep(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors.

    Inside a scratch() block it is deleted at the end; else it stays until the folder is cleaned, as results may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lengthloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _note(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_by(df: DataFrame, key: str, buckets: int, dealt: bool = False) -> DataFrame:
    """keep(), as a table bucketed by key: grouping or joining it by the key needs no further shuffle.

    ``dealt``: the rows of a task belong to few buckets already, so that no shuffle comes before the write.
    """
    spark = df.sparkSession
    name = f"lengthloom_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    (df if dealt else df.repartition(buckets, key)).write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    _note(path)
    return spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def look_up(left: DataFrame, right: DataFrame, key: str, spread: str, salts: int = 64) -> DataFrame:
    """left, joined on key with right, which has one row a key; rows without a partner get nulls.

    right meets the distinct pairs of key and salt first, at most ``salts`` rows a key, and these meet left by both. So a key
    with a large share of left's rows is dealt to that many tasks by the hash of ``spread``, whatever the session's settings.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    found = left.select(key, "_salt").distinct().join(right, key, "left")
    return left.join(found, [key, "_salt"], "left").drop("_salt")


def n_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def uniform(h: Column) -> Column:
    """A 64-bit hash as a double strictly between 0 and 1."""
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def doc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, in slices of about ``size`` bytes of a text column, so that what a task holds is bounded by
    the longest text and not by the session's rows a batch."""
    for batch in batches:
        end = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(end // size)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def tidy(owner: str) -> None:
    """In a Python worker, at the start of an operator's task: drop other operators' caches and give freed memory back.

    Spark reuses workers, so what one operator leaves would count against the next one's memory.
    """
    import ctypes
    import gc

    for name, cache in caches.items():
        if name != owner:
            cache.clear()
    gc.collect()
    pa.set_memory_pool(pa.system_memory_pool())
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
