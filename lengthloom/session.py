"""What a session needs: the sources on every executor, and tables between steps in the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()

#: Bytes of input files, and rows, that one task holds after a shuffle; files may be packed tightly, so their bytes alone don't bound it.
TASK_BYTES, TASK_ROWS = 8 << 20, 300_000


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once an application; Spark puts the archive on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "lengthloom-sources.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(top, name), os.path.relpath(os.path.join(top, name), os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a session on this machine alone, as in a test, gets a new temporary folder; a cluster has to name one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def spread(table: DataFrame, d: DataFrame, key: str) -> DataFrame:
    """d, made of table, by key in a partition for each TASK_BYTES of the table's files or TASK_ROWS of its rows, so that what a task sorts doesn't grow with the input.

    Where spark.sql.shuffle.partitions has more, or the table lies in no files, Spark's own shuffle does.
    """
    spark, files = d.sparkSession, [unquote(f) for f in table.inputFiles()]
    if not files:
        return d
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]
    n = max(-(-size // TASK_BYTES), -(-table.count() // TASK_ROWS))  # rows are counted from the files' footers
    return d.repartition(n, key) if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else d


def kept(d: DataFrame) -> DataFrame:
    """d, written to the shared folder and read again: a short plan, and a table that outlives executors."""
    spark = d.sparkSession
    path = f"{shared_dir(spark)}/sheets-{uuid.uuid4().hex}"
    d.write.parquet(path)
    return spark.read.schema(d.schema).parquet(path)
