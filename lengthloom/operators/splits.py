"""Splits by group: every row of a group is on one side. Groups stand in the order of a seeded hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(d: DataFrame, group: str, seed: int) -> DataFrame:
    """group, rank (from 0) and total of the distinct groups of d; a null group is one, by the name of empty text.

    The hash's first three digits deal groups to 4096 buckets; a table of their sizes says where each begins, and groups are
    numbered inside theirs. So no window runs over all groups, let alone all rows.
    """
    name = F.coalesce(F.col(group).cast("string"), F.lit(""))
    g = d.select(group).distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))).withColumn("_b", F.substring("_h", 1, 3))
    w = Window.orderBy("_b")
    sizes = g.groupBy("_b").agg(F.count("*").alias("n")).select("_b", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begin"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", group)) - 1
    return g.join(sizes, "_b").select(group, (F.col("_begin") + inside).alias("rank"), "total")


def folds(d: DataFrame, group: str, k: int, seed: int = 7) -> DataFrame:
    """group, fold: k folds whose numbers of groups differ by one at most; the first ones are the larger."""
    size, more = F.floor(F.col("total") / k), F.col("total") % k
    wide = more * (size + 1)
    fold = F.when(F.col("rank") < wide, F.floor(F.col("rank") / (size + 1))).otherwise(more + F.floor((F.col("rank") - wide) / F.greatest(size, F.lit(1))))
    return ranked(d, group, seed).select(group, fold.cast("int").alias("fold"))


def three_way(d: DataFrame, group: str, test: float = 0.15, validation: float = 0.1765, seed: int = 7) -> DataFrame:
    """group, part: a share ``test`` of the groups, rounded up, then a share ``validation`` of the others, the rest for training."""
    held = F.ceil(F.col("total") * test)
    part = F.when(F.col("rank") < held, "test").when(F.col("rank") < held + F.ceil((F.col("total") - held) * validation), "validation").otherwise("train")
    return ranked(d, group, seed).select(group, part.alias("part"))
